import importlib.util
import inspect

import pytest

import __spark_entry__ as E
import corpus_pipeline as cp
from farmspark.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from farmspark.llm.shared import saved, table
from tests.conftest import SF_ORACLE, SF_SMALL
from tools.check_oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_queries()))
@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_queries_match_duckdb(spark, name, sf):
    assert compare(spark, sf, [name], verbose=False)[name][0] == "OK"


def test_every_operator_and_the_pipeline_are_registered():
    names = list(E.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.oracle_queries()) <= set(names)


def test_stages_take_and_return_documents(spark):
    docs = table(spark, SF_ORACLE, "documents")
    kinds = docs.dtypes
    labels = table(spark, SF_ORACLE, "labels")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    for k, (name, stage) in enumerate(cp.STAGES):
        assert len(inspect.signature(stage).parameters) == 3
        before, docs = docs, saved(stage(spark, docs, SF_ORACLE), name)
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            exp = {r.doc_id for r in toxicity.score_toxicity(before, labels).where("predicted = 0").collect()}
            assert set(now) == exp and len(now) == len(exp) < len(ids)
        elif name == "exact_dedup":
            assert set(now) == {r.doc_id for r in exact_dedup.dedup_rows(before).where("kept").collect()}
        elif name == "simhash_near_dedup":
            rows = simhash.near_dedup_rows(before).collect()
            assert sorted(now) == sorted({r.component_id for r in rows})
        elif name == "mix_sources":
            exp = {r.doc_id: r.copies for r in mixing.mix_counts(before).collect() if r.copies}
            assert {i: now.count(i) for i in set(now)} == exp
        else:
            assert sorted(now) == sorted(r.doc_id for r in packing.pack(before).collect())
        if k < len(cp.STAGES) - 1:
            assert docs.dtypes == kinds


def test_stages_survive_odd_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        own = docs
        for name, stage in cp.STAGES:
            own = saved(stage(spark, own, SF_SMALL), name)
        assert (own.count() == 0) == (docs is no_docs)


def test_run_gives_the_packed_mix(spark):
    rows = cp.run(spark, SF_SMALL)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_entry_guard_names_the_packages():
    assert E.HAVE_LLM and E.HAVE_PIPELINE and importlib.util.find_spec("farmspark.llm.queries")
