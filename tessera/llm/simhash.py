"""SimHash near-duplicate detection by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a
point of the grid {0, 1, 2}^32.  The Manhattan distance of two points is at
most the Hamming distance of their fingerprints, and if fingerprints differ in
at most 3 bits then in one half of the segments their points are at Manhattan
distance at most 1.  Fingerprints are therefore joined over the grid cells of
either half and their neighbour cells, filtered by the Manhattan distance over
all segments, and verified exactly.  Nothing is lost at 3 or fewer bits.

Equal fingerprints are one node, so copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._buckets import Forest, bounded_groups, group_chunks, small_pairs, sorted_groups
from ._components import connected_components
from ._storage import materialize
from ._text import free_prefix, row_hash

LOW_BITS = 0x5555555555555555  # the low bit of every two-bit segment
HALF = 16  # segments in each half
MAX_BITS = 3  # the largest distance for which one half must be within 1


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles of a UTF-8 text, 0 if it has no word.

    XXH64 with seed 42 of each shingle, repeats included; a bit is 1 if more than half have it.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fp``: the fingerprint of each whole text as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def segment_counts(half: Column) -> Column:
    """The bit counts of the two-bit segments of a half fingerprint, each in its own two bits."""
    low = F.lit(LOW_BITS & 0xFFFFFFFF)
    return half.bitwiseAND(low) + F.shiftrightunsigned(half, 1).bitwiseAND(low)


def _cells(fps: DataFrame) -> DataFrame:
    """``cell, fp, probe``: both home cells of each fingerprint and the cells one step up from them."""
    right, left = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(segment_counts(right), segment_counts(left).bitwiseOR(F.lit(1 << 32)))).alias("home"))
    up = [
        F.when(F.shiftrightunsigned("home", 2 * i).bitwiseAND(F.lit(2)) == 0, F.col("home") + F.lit(1 << (2 * i)))
        for i in range(HALF)
    ]
    return halves.select("fp", "home", F.explode(F.array(F.col("home"), *up)).alias("cell")).where("cell is not null").select(
        "cell", "fp", (F.col("cell") != F.col("home")).alias("probe")
    )


def _compare(max_bits: int):
    low = np.uint64(LOW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_chunks(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            probe = table.column("probe").to_numpy(zero_copy_only=False)
            points = (fp & low) + ((fp >> np.uint64(1)) & low)
            forest = Forest()
            for i, j in small_pairs(bounds):
                keep = ~(probe[i] & probe[j])  # two probes need not be neighbours
                i, j = i[keep], j[keep]
                differ = points[i] ^ points[j]
                one = np.bitwise_count(differ & low)
                two = np.bitwise_count((differ >> np.uint64(1)) & ~differ & low)
                near = one + 2 * two <= max_bits  # Manhattan distance over all segments
                i, j = i[near], j[near]
                close = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                for a, b in zip(fp[i[close]].view(np.int64).tolist(), fp[j[close]].view(np.int64).tolist(), strict=True):
                    if a != b:
                        forest.link(a, b)
            ends = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, limit: int = 2048) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that join all which are within ``max_bits`` bits.

    Of each group that is compared only a spanning forest is returned: the reachable
    fingerprints are those of all links, without the quadratic number of links.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the grid cells find all links up to {MAX_BITS} bits only")
    rows = bounded_groups(_cells(fps.select("fp").distinct()), "cell", F.col("fp"), limit)
    return sorted_groups(rows).mapInArrow(_compare(max_bits), "a long, b long")


def _components(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``fp, least_id, component``: a row for each fingerprint, with the smallest fingerprint that it reaches."""
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    nodes = connected_components(fingerprint_links(prints, max_bits))
    comps = least.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    return materialize(comps, "fingerprint-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fp, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``max_bits`` bits, a row's own included.  Null and empty texts and texts without a word
    have fingerprint 0 and are linked like any other.  Rows with equal ids are kept; a null id
    never becomes a component's id unless all its ids are null.  Other columns are ignored.
    """
    prints = materialize(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    comps = _components(prints, id_col, max_bits)
    first = comps.groupBy(F.col("component").alias("c")).agg(F.min("least_id").alias("component_id"))
    by_fp = comps.join(first, F.col("component") == F.col("c")).select(F.col("fp").alias("_fp"), "component_id")
    by_fp = materialize(by_fp, "fingerprint-groups")
    return prints.join(by_fp, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Digest of :func:`near_duplicates` over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged: that of the smallest ``doc_id``, null last.

    Of rows with the same smallest id the one of the smallest row hash stays; of wholly equal rows
    one.  Ids, fingerprints and hashes decide; each text then moves once.
    """
    p = free_prefix(docs.columns, "_dedup_")
    i, h = f"{p}id", f"{p}hash"
    keyed = docs.withColumn(i, F.col("doc_id")).withColumn(h, row_hash(docs))
    # the id and the hash are carried as one struct through the fingerprinting
    prints = with_fingerprints(keyed.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(h).alias("hash")).alias("doc_id"), "text"))
    prints = materialize(prints, "fingerprints")
    comps = _components(prints, "doc_id", MAX_BITS)
    first = comps.groupBy("component").agg(F.min("least_id").alias("k")).select(F.col("k.id").alias("_id"), F.col("k.hash").alias("_hash"))
    # equal rows meet before the shuffle, so no number of copies is one task's work
    rows = keyed.dropDuplicates([i, h])
    return rows.join(first, F.col(i).eqNullSafe(F.col("_id")) & (F.col(h) == F.col("_hash")), "left_semi").select(*docs.columns)
