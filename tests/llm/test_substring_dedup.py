import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from farmspark.llm import exchange, lm
from farmspark.llm import substring_dedup as sd
from farmspark.llm.shared import table


def brute(rows, n):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[k:k + n]) for _, w in words for k in range(len(w) - n + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k:k + n])] > 1:
                gone[k:k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in sd.dedup_substrings(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("window", [1, 2, 5, 6, 35])
def test_planted_repeats_at_every_offset(spark, window):
    rng = random.Random(window)
    words = [f"v{i}" for i in range(3000)]

    def fill(n):
        return [rng.choice(words) for _ in range(n)]
    passages = [fill(n) for n in (window - 1, window, window + 1, 2 * window, 3 * window + 4)]
    rows = []
    for i in range(60):
        text = fill(rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            text += p + fill(rng.randrange(0, 40))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(100, "same " * (3 * window)), (101, "ab ba " * 50), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs, window=window) == brute(rows, window)


def test_edge_documents(edge_docs, edge_rows, no_docs):
    short = edge_docs.where("length(text) < 10000 or text is null")
    rows = [r for r in edge_rows if len(r[1] or "") < 10_000]
    assert run(short, window=3) == brute(rows, 3)
    # the long texts repeat themselves and each other: nothing of them stays
    empty = hashlib.sha256(b"").hexdigest()
    got = [r for r in sd.dedup_substrings(edge_docs).collect() if r.n_words > 1000]
    assert len(got) == 2 and all(r.n_removed == r.n_words == 300_000 and r.kept_sha256 == empty for r in got)
    assert run(no_docs) == []


def test_chunks_are_bounded_in_bytes_and_dropped(spark):
    long = [(i, f"w{i} " * (20_000 + i)) for i in range(200)]  # long texts in a row
    rows = long + [(1000 + i, "a b c") for i in range(3000)] + [(9000, "x" * 9_000_000), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    before = {t.name for t in spark.catalog.listTables()}
    chunks, drop = exchange.chunk_table(docs, docs.doc_id, F.coalesce(docs.text, F.lit("")).alias("text"))
    size = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).collect()
    most = exchange.CHUNK_TEXT << exchange.CHUNK_BITS
    assert all(r.n == 1 or r.n <= 1 << exchange.CHUNK_BITS and r.b <= most for r in size) and sum(r.n for r in size) == len(rows)
    drop()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert run(docs.where("doc_id >= 1000"), window=3) == brute([r for r in rows if r[0] >= 1000], 3)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_no_more_buckets_than_spark_allows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert run(docs) == brute(rows, 35)
        assert lm.score_documents(docs).count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_kept_text(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a  b {p} c"), (2, f"{p} d")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in sd.dedup_substrings(docs, with_text=True).collect()} == {1: "a b c", 2: "d"}


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows, 35)
