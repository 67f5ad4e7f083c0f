from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 9000}" for i in range(300_000))

#: names the operators use themselves, as columns of the caller
CLASHING = ["row", "digest", "keep_id", "chunk", "fold", "bucket", "score", "_score", "_key", "_n", "size", "target",
            "rate", "copies", "_copies", "piece", "start", "sequence_id", "spans", "fingerprint", "component_id", "n"]


def texts() -> list[str | None]:
    return [None, "", "   ", " \t\n\x0b\x0c\r ", "a", "a b", "a  b", "a\tb ", "Straße ÉÀ x", "a", "a", "b b b", "\x1c a\x00b",
            "token=abc123456 x", LONG, LONG, "the quick brown fox jumps", "the quick brown fox jumps", "é" * 50]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rows = []
    for i, t in enumerate(texts()):
        rows.append((i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or "")))
    rows += [rows[5], rows[5], (None, "a b", None, None, None), (None, None, None, None, None), (7, "other text of 7", "en", "src1", 3)]
    full = [(*r, *[f"x{k}" if k % 2 else None for k in range(len(CLASHING))]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + \
        ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    return [(r.doc_id, r.text, r.source) for r in edge_docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(19)] + [(None, 1, 1), (3, None, None), (4, 0, 1)],
                                 "doc_id long, quality int, toxic int")
