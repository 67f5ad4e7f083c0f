import hashlib
import random
import re
from collections import defaultdict

from farmspark.llm.exact_dedup import CuckooFilter, DigestIndex, Shard, _best, dedup, dedup_rows


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_never_denies_live_keys_and_grows():
    f = CuckooFilter(buckets=4)
    for i in range(3000):
        f.insert(key(i))
    assert f.resizes > 0 and all(f.maybe(key(i)) for i in range(3000))
    for i in range(0, 3000, 2):
        f.delete(key(i))
    assert all(f.maybe(key(i)) for i in range(1, 3000, 2))
    # what is deleted is gone but for fingerprint collisions, and unknown keys are left alone
    assert sum(f.maybe(key(i)) for i in range(0, 3000, 2)) < 20
    f.delete(key("never"))
    assert sum(map(bool, f.table)) == 1500


def test_filter_survives_many_keys_of_one_fingerprint():
    f = CuckooFilter(buckets=4)
    keys = [bytes([0] * 6) + i.to_bytes(2, "big") + b"\x07\x07" + key(i)[10:] for i in range(40)]
    for k in keys:
        f.insert(k)
    assert all(map(f.maybe, keys))


def test_shard_evicts_and_counts():
    s, out = Shard(limit=4), []
    for i in [1, 2, 1, 3, 4, 5, 6, 1, 1]:
        out += s.insert(key(i), _best(False, i, i), 1)
    out += [s.take(d) for d in list(s.content)]
    n = defaultdict(int)
    for d, _, c in out:
        n[d] += c
    assert n == {key(1): 4, **{key(i): 1 for i in range(2, 7)}} and not any(s.filter.table)


def test_index_equals_a_dictionary_under_inserts_and_deletes():
    rng, f, live = random.Random(2), CuckooFilter(buckets=2), {}
    for step in range(20000):
        k = key(rng.randrange(3000))
        if rng.random() < 0.6 and k not in live:
            f.insert(k, step)
            live[k] = step
        elif rng.random() < 0.5:
            assert f.delete(k) == ([k, live.pop(k)] if k in live else None)
        else:
            assert f.find(k) == ([k, live[k]] if k in live else None)
    assert {e[0]: e[1] for e in f.entries()} == live and f.live == len(live) and f.resizes > 5


def test_hits_are_verified_against_whole_digests():
    # equal buckets and fingerprints, other digests
    keys = [key(0)[:10] + key(i)[10:] for i in range(8)]
    f = CuckooFilter()
    for i, k in enumerate(keys[:4]):
        f.insert(k, i)
    assert all(map(f.maybe, keys)) and f.find(keys[5]) is None and f.delete(keys[5]) is None
    assert [f.find(k) for k in keys[:4]] == [[k, i] for i, k in enumerate(keys[:4])]
    assert f.delete(keys[2]) == [keys[2], 2] and f.find(keys[2]) is None and f.find(keys[3]) == [keys[3], 3]


def test_a_hot_digest_leaves_a_bounded_index_a_few_times():
    s, out = Shard(limit=100), []
    for i in range(5000):
        out += s.insert(key(-1), _best(False, i, i), 1)
        out += s.insert(key(i), _best(False, i, i), 1)
    out += s.rows()
    hot = [e for e in out if e[0] == key(-1)]
    assert sum(e[2] for e in hot) == 5000 and len(hot) <= 5000 // 50 + 1 and min(e[1] for e in hot) == (False, 0, 0)
    assert sorted(e[0] for e in out if e[0] != key(-1)) == sorted(key(i) for i in range(5000))


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def test_rows_match_brute_force(edge_docs, edge_rows):
    got = dedup_rows(edge_docs).collect()
    exp, groups = expected(edge_rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str) == exp
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.digest for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_dedup_keeps_rows_as_they_are(edge_docs, no_docs, edge_rows):
    out = dedup(edge_docs)
    assert out.dtypes == edge_docs.dtypes and out.count() == expected(edge_rows)[1]
    assert out.exceptAll(edge_docs).count() == 0
    assert dedup(no_docs).collect() == [] and dedup_rows(no_docs).collect() == []


def test_index_insert_and_delete(spark):
    rows = [(bytearray(key(i % 7)), i, i) for i in range(30)]
    frame = spark.createDataFrame(rows, "digest binary, doc_id long, row long")
    index = DigestIndex.empty(spark, 3).insert(frame)
    live = {bytes(r.digest): (r.best_id, r.n) for r in index.content.collect()}
    assert live == {key(i): (i, len(range(i, 30, 7))) for i in range(7)}
    gone = spark.createDataFrame([(bytearray(key(2)),), (bytearray(key(2)),), (bytearray(key(99)),), (None,)], "digest binary")
    fewer = index.delete(gone)
    assert {bytes(r.digest) for r in fewer.content.collect()} == set(live) - {key(2)}
    again = fewer.insert(spark.createDataFrame([(bytearray(key(2)), 100, 100), (bytearray(key(3)), 1, 50)],
                                               "digest binary, doc_id long, row long"))
    now = {bytes(r.digest): (r.best_id, r.n) for r in again.content.collect()}
    assert now[key(2)] == (100, 1) and now[key(3)] == (1, live[key(3)][1] + 1)
    # the older index is still there
    assert index.content.count() == 7
