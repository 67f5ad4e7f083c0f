"""C-16 worker sign-ups against a sequential simulation."""

import random

import pytest

from farmspark.operators import changes as C


def simulate(stored, requests):
    mobiles, mails = {m for _, _, _, m in stored}, {e for _, _, e, _ in stored}
    out = {}
    for seq, _, name, email, mobile in sorted(requests):
        if mobile is not None and mobile in mobiles:
            out[seq] = "Mobile number already exists"
        elif email is not None and email in mails:
            out[seq] = "Email already registered as a user"
        else:
            out[seq] = None
            mobiles.add(mobile)
            mails.add(email)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_workers_one_after_the_other(spark, tables, seed):
    rng = random.Random(seed)
    stored = [(i, f"n{i}", f"e{i}", f"m{i}") for i in range(3)]
    requests = [(i * 3 + 1, "worker", "x", rng.choice([None, *[f"e{k}" for k in range(12)]]),
                 rng.choice([None, *[f"m{k}" for k in range(12)]])) for i in range(60)]
    if seed == 0:  # a chain in which each request hangs on the one before
        requests = [(i, "worker", "x", f"e{10 + (i + 1) // 2}", f"m{10 + i // 2}") for i in range(1, 15)]
    rng.shuffle(requests)
    ch = spark.createDataFrame(requests, "seq long, kind string, name string, email string, mobile_no string")
    res = C.register_accounts(tables(worker=stored), ch, ("worker",))["worker"]
    exp = simulate(stored, requests)
    assert {r.seq: r.reason for r in res.rejects.collect()} == {s: r for s, r in exp.items() if r}
    got = [(r.seq, r.id) for r in res.accepted.orderBy("seq").collect()]
    assert got == [(s, 3 + i) for i, s in enumerate(sorted(s for s, r in exp.items() if not r))]


def test_a_request_that_fails_on_its_mail_reserves_nothing(spark, tables):
    ch = spark.createDataFrame([(1, "worker", "a", "e0", "m9"), (2, "worker", "b", "free", "m9")],
                               "seq long, kind string, name string, email string, mobile_no string")
    res = C.register_accounts(tables(worker=[(0, "n", "e0", "m0")]), ch, ("worker",))["worker"]
    assert [(r.seq, r.reason) for r in res.rejects.collect()] == [(1, "Email already registered as a user")]
    assert [r.seq for r in res.accepted.collect()] == [2]


@pytest.mark.parametrize("limit", [50_000, 3, 0])
@pytest.mark.parametrize("seed", range(2))
def test_components_and_rounds_agree(spark, tables, monkeypatch, limit, seed):
    monkeypatch.setattr(C, "COMPONENT_ROWS", limit)
    rng = random.Random(seed)
    # an e-mail that a third of the requests share, and small knots
    requests = [(i, "worker", "x", "hot" if i % 3 == 0 else rng.choice([None, f"e{rng.randrange(60)}"]),
                 rng.choice([None, f"m{rng.randrange(80)}"])) for i in range(1, 200)]
    rng.shuffle(requests)
    ch = spark.createDataFrame(requests, "seq long, kind string, name string, email string, mobile_no string")
    res = C.register_accounts(tables(worker=[(0, "n", "e0", "m0")]), ch, ("worker",))["worker"]
    exp = simulate([(0, "n", "e0", "m0")], requests)
    assert {r.seq: r.reason for r in res.rejects.collect()} == {s: r for s, r in exp.items() if r}


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_a_long_chain_settles_in_few_jobs(spark, tables, monkeypatch, order):
    n, seqs = 10_000, list(range(10_000))
    if order == "mixed":
        random.Random(1).shuffle(seqs)
    requests = [(seqs[i], "worker", "x", f"e{(i + 1) // 2}", f"m{i // 2}") for i in range(n)]
    written = []
    whole = C.B.materialized
    monkeypatch.setattr(C.B, "materialized", lambda df, *a: written.append(a) or whole(df, *a))
    monkeypatch.setattr("farmspark.plans.graph.materialized", lambda df, *a: written.append(a) or whole(df, *a))
    ch = spark.createDataFrame(requests, "seq long, kind string, name string, email string, mobile_no string")
    res = C.register_accounts(tables(worker=[]), ch, ("worker",))["worker"]
    exp = simulate([], requests)
    assert {r.seq for r in res.rejects.collect()} == {s for s, r in exp.items() if r}
    assert len(written) < 60
