"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.shared import crc_fold, doc_text

FOLDS = 5


def held_out(id_col: str):
    """Whether a row is never learned from: crc32 of its id as text mod 5 is 0."""
    return crc_fold(id_col, FOLDS) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], list[int], dict[int, float]]:
    """(texts, labels, weight of each class) of at most ``per_class`` rows a class.

    Rows are chosen by a hash of their id among the labelled rows that are not
    held out and whose text has at most ``max_bytes`` bytes; texts are whole.
    The weights bring the classes back to their share of all labelled rows.  Of
    repeated labels the larger counts, of repeated rows the smallest text.
    """
    own = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
           .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")))
    share = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), doc_text(text_col).alias("text"))
            .where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "id")
            .groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").collect())
    have = {y: sum(r.y == y for r in rows) for y in (0, 1)}
    weights = {y: share[y] / have[y] for y in (0, 1) if have[y]}
    mean = sum(weights[r.y] for r in rows) / max(len(rows), 1) or 1.0
    return [r.text.encode() for r in rows], [r.y for r in rows], {y: w / mean for y, w in weights.items()}
