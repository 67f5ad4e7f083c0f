"""C-6 / C-7 moves that could leave the INT column against a sequential simulation."""

import random

import pytest

from farmspark.operators import changes as C

MOST = 2**31 - 1


def simulate(stock, moves):
    """seqs that fail, and the stock afterwards (None stays None)."""
    now = {i: [q for k, q in stock if k == i] for i in {k for k, _ in stock}}
    failed = set()
    for seq, kind, item, qty in sorted(moves):
        own = now[int(item)]
        d = int(qty) if kind == "receive" else -int(qty)
        if any(q is not None and not -MOST - 1 <= q + d <= MOST for q in own):
            failed.add(seq)
        else:
            now[int(item)] = [None if q is None else q + d for q in own]
    return failed, sorted((i, str(q)) for i, own in now.items() for q in own)


@pytest.mark.parametrize("case", ["few", "many", "all", "swing"])
def test_hot_item_against_simulation(spark, tables, monkeypatch, case):
    rng = random.Random(case)
    stock = [(1, 2_000_000_000), (2, 5), (3, None), (4, -2_147_000_000), (4, 2_147_000_000), (5, 0)]
    step = {"few": 1_000_000, "many": 50_000_000, "all": 1_500_000_000, "swing": 900_000_000}[case]
    moves = []
    for seq in range(3000):
        item = 1 if seq % 3 == 0 else rng.choice([2, 3, 4, 5])
        kind = "issue" if case == "swing" and seq % 2 else rng.choice(["issue", "receive"])
        moves.append((seq, kind, str(item), str(rng.randrange(step))))
    rng.shuffle(moves)
    t = tables(inventory=[(i, "a", "x", q, None, None) for i, q in stock])
    ch = spark.createDataFrame([(*m, "2024-01-01") for m in moves], "seq long, kind string, item_id string, qty string, date string")
    failed, after = simulate(stock, moves)
    for ranges in (C.STEPPED_RANGES, 0):
        monkeypatch.setattr(C, "STEPPED_RANGES", ranges)
        res = C.stock_changes(t, ch)
        assert {r.seq for r in res.rejects.collect()} == failed
        assert sorted((r.item_id, str(r.quantity)) for r in res.table.collect()) == after
    assert failed


def test_a_hot_item_is_spread_over_tasks(spark, tables, monkeypatch):
    dealt = []
    whole = C.B.materialized

    def seen(df, *a):
        out = whole(df, *a)
        if a == ("moves",):
            dealt.append(out[0])
        return out
    monkeypatch.setattr(C.B, "materialized", seen)
    t = tables(inventory=[(1, "a", "x", 0, None, None)])
    ch = spark.range(60_000).selectExpr("id as seq", "case when id % 2 = 0 then 'receive' else 'issue' end as kind", "'1' as item_id",
                                        "'100000' as qty", "'2024-01-01' as date")
    res = C.stock_changes(t, ch)
    assert res.rejects.count() == 0 and res.table.first().quantity == 0
    # the sizes of the moves add up beyond the column, but no range of them leaves it
    assert dealt and dealt[0].groupBy("_part").count().count() > 4
