import random
import zlib

import numpy as np
import pytest

from farmspark.llm import packing
from farmspark.llm.wordpieces import TextIds
from tests.llm.conftest import texts


@pytest.fixture(scope="module")
def encoder():
    return TextIds(packing.word_path())


ODD = ["Héllo WORLD ’s it's 12ab ᴀ ́x é Σ ΑΣ a\x1cb <|endoftext|> x<|endoftext|>y ½ ² İ",
       "ß ñ÷× don't I'LL 3.14   nb sp", "aaaaaaaaa aaaa oooooo ÇÉ×", "a\u0085b c", "x" * 5000,
       "I'm we've they'd", "<|", "|>", "中文 字 かな", "🙂🙂 a🙂b", "\x00\x01", "--- *** !!?", "İstanbul ǅ ﬁ"]


def test_ids_equal_the_library(encoder, spark):
    from farmspark.llm.shared import table
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    own = [t or "" for t in texts() if t is None or len(t) < 10_000] + ODD + [r.text for r in rows]
    ids, bounds = encoder.ids([t.encode() for t in own])
    assert encoder.by_word
    for i, t in enumerate(own):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == encoder._library(t), t[:80]


def test_ids_equal_the_library_on_random_strings(encoder):
    rng = random.Random(1)
    signs = "aabbtthheeinan  \n\t.,'!<|>endoftext0123éÉñß÷×´`中🙂́ AZ"
    own = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    ids, bounds = encoder.ids([t.encode() for t in own])
    for i, t in enumerate(own):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == encoder._library(t), repr(t)


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers
    other = TextIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    ids, bounds = other.ids([b"Hello  world", b""])
    assert ids[:bounds[1]].tolist() == other._library("Hello  world") and bounds[2] == bounds[1]


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, open_bins=2)
    # bins with 4 and 2 places are open: the one with 2 closes for the third
    assert [fit.place(n) for n in (6, 8, 9, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]
    assert fit.open <= 2


def check(rows, size):
    """Pieces lie in their sequences without gaps or overlaps."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length >= 1
            at += length
        assert at <= size
    return by


def test_pack_whole_documents(edge_docs, no_docs, encoder):
    rows = packing.pack(edge_docs, with_ids=True).collect()
    check(rows, 2048)
    got = {}
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        got.setdefault((r.doc_id), []).append((r.start, r.piece, r.ids))
    exp = {}
    for r in edge_docs.select("doc_id", "text").collect():
        ids = [*encoder._library(r.text or ""), 0]
        exp.setdefault(r.doc_id, []).extend(
            (k * 2048, k, ids[k * 2048:(k + 1) * 2048]) for k in range(-(-len(ids) // 2048)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in exp.items()}
    assert packing.pack(no_docs).collect() == []


def test_pack_fills_sequences(spark):
    from farmspark.llm.shared import table
    rows = packing.pack(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    by = check(rows, 2048)
    total = sum(r.length for r in rows)
    assert len(by) <= 1.01 * total / 2048 + 1
    # only documents of more than 2048 ids are cut, into full pieces
    sizes = {}
    for r in rows:
        sizes.setdefault(r.doc_id, []).append((r.piece, r.length))
    for own in sizes.values():
        assert all(n == 2048 for _, n in sorted(own)[:-1])
