"""Comparing the rows of a bucket without holding an unbounded bucket.

A bucket of at most ``limit`` rows is one group.  A larger one is cut into
chunks by a hash of the row, and every pair of chunks is a group of its own, so
any two rows of the bucket still meet and no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["bucket", "chunk_a", "chunk_b"]


def chunk_pairs(rows: DataFrame, sizes: DataFrame, row_id: str, limit: int) -> DataFrame:
    """``rows`` (with a ``bucket``) of the buckets in ``sizes`` (bucket, n),
    dealt to groups (``GROUP``) and sorted by them within each partition."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / limit)).cast("int")
    own = F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int")
    dealt = (rows.join(sizes, "bucket").withColumn("parts", parts).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("chunk_a", F.least("own", "other")).withColumn("chunk_b", F.greatest("own", "other"))
             .drop("n", "parts", "other"))
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)


def whole_groups(batches, limit_rows: int = 200_000) -> Iterator[tuple[object, np.ndarray]]:
    """From batches sorted by ``GROUP``: (table of whole groups, group bounds)."""
    import pyarrow as pa

    held: list = []
    rows = 0

    def bounds(table) -> np.ndarray:
        change = np.zeros(table.num_rows + 1, bool)
        change[0] = change[-1] = True
        for c in GROUP:
            v = table.column(c).to_numpy()
            change[1:-1] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit_rows:
            table = pa.Table.from_batches(held)
            cut = bounds(table)
            if len(cut) > 2:
                yield table.slice(0, cut[-2]), cut[:-1]
                held = table.slice(cut[-2]).combine_chunks().to_batches()
                rows = table.num_rows - cut[-2]
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)
