import math
from fractions import Fraction

from farmspark.llm import mixing
from farmspark.llm.shared import table


def brute_targets(sizes):
    """Targets by sharing the excess again and again, in exact numbers."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        aim = {s: Fraction(3 * sizes[s]) if s in full else Fraction(rest * weight[s], w) for s in names}
        above = {s for s in names if s not in full and aim[s] > 3 * sizes[s]}
        if not above:
            return aim
        full |= above


def sizes(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + len((t or "").encode().split())
    return out


def test_targets_fill_up(spark):
    cases = [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 2}, {"a": 0, "b": 5}, {"x": 7},
             {"Z": 5, "a": 90, "é": 1, "zz": 4, None: 0}, {f"s{i:03d}": (i * 37) % 101 for i in range(200)}]
    for case in cases:
        frame = spark.createDataFrame(list(case.items()), "source string, source_size long").repartition(4)
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        exp = brute_targets(case)
        assert got.keys() == exp.keys()
        assert all(math.isclose(got[s], float(exp[s]), rel_tol=1e-12) for s in exp)


def test_jobs_do_not_grow_with_the_levels(spark):
    def jobs(case):
        group = f"levels-{len(case)}"
        spark.sparkContext.setJobGroup(group, group)
        frame = spark.createDataFrame(list(case.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        spark.sparkContext.setJobGroup("", "")
        exp = brute_targets(case)
        assert all(math.isclose(got[s], float(exp[s]), rel_tol=1e-12) for s in exp)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    # every source fills up at a level of its own
    assert jobs({f"s{i:02d}": 4 ** i for i in range(28)}) <= jobs({"a": 1, "b": 4, "c": 16}) + 2


def test_all_sources_full_below_rate_one(spark):
    frame = spark.createDataFrame([("a", 10), (None, 30)], "source string, source_size long")
    got = {r.source: (r.target, r.rate) for r in mixing.targets(frame, max_rate=0).collect()}
    assert got == {"a": (0.0, 0.0), None: (0.0, 0.0)}


def test_edge_documents(edge_docs, edge_rows, no_docs):
    rows = mixing.mix_counts(edge_docs).collect()
    own = sizes(edge_rows)
    exp = brute_targets(own)
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.source_size == own[r.source] and math.isclose(r.target, float(exp[r.source]), rel_tol=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 3
    mixed = mixing.mix(edge_docs)
    assert mixed.dtypes == edge_docs.dtypes and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).collect() == [] and mixing.mix_counts(no_docs).collect() == []
    # reruns agree, another seed does not
    again = sorted(map(str, mixing.mix_counts(edge_docs.repartition(5)).collect()))
    assert again == sorted(map(str, rows))


def test_taken_words_come_near_the_targets(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = mixing.mix_counts(docs).selectExpr("source", "target", "size * copies as taken", "size").toPandas()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) / by.target < 0.15).all()
    assert abs(by.taken.sum() / by.target.sum() - 1) < 0.02
    other = mixing.mix_counts(docs, seed=1).selectExpr("size * copies as taken").toPandas()
    assert (other.taken != rows.taken).any()
