import random

import numpy as np
import xxhash

from farmspark.llm import simhash


def plain(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints, distance):
    """Smallest id reachable over fingerprints within ``distance`` bits."""
    n = len(rows)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    best = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return [best.get(root(i)) for i in range(n)], len({root(i) for i in range(n)})


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_fingerprint():
    for t in ["", " ", "One two", "A b c", "a B c d e f g", "x " * 70_000, "é Ü ß a b"]:
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_anchors_cover_every_distance():
    rng = np.random.default_rng(0)
    for k in range(0, 8):
        widths = simhash.block_widths(k)
        assert sum(widths) == 64
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
        b = a.copy()
        for i in range(400):
            for bit in rng.choice(64, k, replace=False):
                b[i] ^= np.uint64(1 << int(bit))
        met = np.zeros(400, bool)
        shift = 0
        for w in widths:
            mask = np.uint64((1 << w) - 1)
            x, y = (v >> np.uint64(shift) & mask for v in (a, b))
            shift += w
            home, _ = simhash.anchors(x, w)
            assert (np.bitwise_count(home ^ x) <= 1).all()
            _, near = simhash.anchors(y, w)
            assert (np.bitwise_count(near ^ y[:, None]) <= 2).all()
            met |= (near == home[:, None]).any(axis=1)
        assert met.all(), k


def test_rows_match_brute_force(edge_docs, edge_rows, no_docs):
    got = simhash.near_dedup_rows(edge_docs).collect()
    prints = [plain(t) for _, t, _ in edge_rows]
    comp, groups = brute(edge_rows, prints, 3)
    exp = sorted(((r[0], p, c) for r, p, c in zip(edge_rows, prints, comp)), key=str)
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=str) == exp
    out = simhash.near_dedup(edge_docs)
    assert out.count() == groups and out.dtypes == edge_docs.dtypes and out.exceptAll(edge_docs).count() == 0
    assert simhash.near_dedup(no_docs).collect() == [] and simhash.near_dedup_rows(no_docs).collect() == []


def test_links_match_brute_force_in_dense_neighbourhoods(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            p = b
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    comp, _ = brute([(i,) for i in range(len(prints))], prints, 3)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(4)
    from farmspark.llm.components import components
    for limit in (4096, 3):  # the second cuts nearly every anchor into chunks
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        root = {r.node: r.component for r in components(simhash.links(frame)).collect()}
        groups, exp = {}, {}
        for i, p in enumerate(signed):
            groups.setdefault(root.get(p, p), set()).add(p)
            exp.setdefault(comp[i], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, exp.values()))
