"""Comparison of rows that share a key, without unbounded groups.

Keys with more than ``limit`` rows are split into blocks; every pair of blocks
becomes a group of its own, so a hot key is compared completely by many tasks
of bounded size.  Each row of a hot key is then copied once per block of its
key.  Tasks stream over groups that lie together in sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._storage import materialize

GROUP = ("_key", "_lo", "_hi")
HOT_KEYS = 1_000_000  # up to so many hot keys of 12 bytes go to all executors; more are joined by shuffling


def bounded_groups(rows: DataFrame, key: str, ident: Column, limit: int) -> DataFrame:
    """Add ``_key, _lo, _hi, _block``: the group of each row, at most about 2 * ``limit`` rows each.

    ``ident`` spreads the rows of a hot key over its blocks; rows that share it stay together.
    """
    hot = (
        rows.groupBy(F.col(key).alias("_hot_key"))
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
        .select("_hot_key", F.ceil(F.col("_n") / limit).cast("int").alias("_blocks"))
    )
    hot = materialize(hot, "hot-keys")
    if hot.count() <= HOT_KEYS:  # then rows are not shuffled for this join
        hot = F.broadcast(hot)
    joined = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = joined.withColumn("_block", F.pmod(F.xxhash64(ident, F.lit(11)), F.col("_blocks").cast("long")).cast("int"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.select(
        F.col(key).alias("_key"),
        F.least("_block", "_other").alias("_lo"),
        F.greatest("_block", "_other").alias("_hi"),
        *[c for c in rows.columns if c != key],
        "_block",
    )


def sorted_groups(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bring each group together in one partition, rows of a group adjacent."""
    dealt = rows.repartition(partitions, *GROUP) if partitions else rows.repartition(*GROUP)
    return dealt.sortWithinPartitions(*GROUP)


def group_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the group bounds; holds one batch and one group at most."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        bounds = _bounds(table)
        if len(bounds) > 2:
            cut = int(bounds[-2])
            yield table.slice(0, cut), bounds[:-1]
            rest = table.slice(cut)
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, _bounds(rest)


def _bounds(table: pa.Table) -> np.ndarray:
    """Starts of the groups, then the number of rows."""
    n = table.num_rows
    if n == 0:
        return np.array([0])
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in GROUP:
        v = table.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)


def small_pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j), i < j, within groups, as arrays, one distance j - i at a time."""
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    at = np.arange(bounds[-1])
    d = 1
    while len(at := at[at + d < ends[at]]):
        yield at, at + d
        d += 1


class Forest:
    """Union-find that keeps only links which join two trees."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.links: list[tuple] = []

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def link(self, a, b) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


MapInArrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
