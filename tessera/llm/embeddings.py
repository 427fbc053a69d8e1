"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected at random to 8 dimensions, several times, and decoded
to the nearest point of the E8 lattice, the home cell of that table.  A vector
also probes the lattice neighbours (home plus a root) nearest to its projection.
Only ids travel to the cells, with 64 signs of random projections.  Vectors of a
cell whose signs differ in few places form a set; equal sets of different cells
are one, and only their members' vectors are fetched and compared by cosine in
double precision.

Equal vectors are one node.  Of each set only links that join it are returned;
connected components follow, and the links of each vector are then counted
inside its component, in blocks, which is exact for all its members.

The lattice grows finer with the largest label, so a vector meets about as many
strangers at any size; the number of tables follows from the share of simulated
pairs at the least cosine that meet (``recall``).  Signs miss such a pair with
probability ``MISS`` at most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import bounded_groups, group_chunks, small_pairs, sorted_groups
from ._components import connected_components
from ._storage import materialize

DIM = 8
BITS = 64
MISS = 1e-6  # of pairs at the least cosine whose signs differ in too many places
SMALL = 48  # rows of a cell up to which the pairs of many cells are compared at once


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(DIM), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(DIM)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=DIM) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: if the sum is odd, the worst rounded entry goes the other way."""
    p = np.rint(y)
    error = y - p
    odd = np.flatnonzero(p.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    p[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return p


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _cell_ids(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hashes of lattice points, mixed with a salt each."""
    h = salt.astype(np.uint64)
    for i in range(DIM):
        h = (h ^ (2 * points[..., i]).astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; the largest entry is brought to 1 first, against overflow."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cell_rows(units: np.ndarray, salts: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is a probe) of every home and probed cell."""
    n, dim = units.shape
    rows, cells, probe = [], [], []
    for t in range(tables):
        random = np.random.default_rng([seed, t, dim])
        basis, _ = np.linalg.qr(random.normal(size=(max(dim, DIM), DIM)))
        y = units @ basis[:dim] * (scale * np.sqrt(max(dim, DIM) / DIM)) + random.uniform(-1, 1, DIM)
        home = nearest_e8(y)
        order = np.argsort(-((y - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[order]], axis=1)
        salt = (salts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(t + 1)
        cells.append(_cell_ids(points, np.broadcast_to(salt[:, None], points.shape[:2])).ravel())
        rows.append(np.repeat(np.arange(n), probes + 1))
        probe.append(np.tile(np.arange(probes + 1) > 0, n))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(probe)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _by_width(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of equally long vectors."""
    widths = np.diff(np.append(column.offsets.to_numpy()[: len(column)], column.offsets.to_numpy()[len(column)]))
    for w in np.unique(widths):
        yield np.flatnonzero(widths == w)


def lattice(largest: int, least: float, probes: int, recall: float, seed: int) -> tuple[int, float]:
    """(tables, scale) for labels of up to ``largest`` vectors.

    Half a step of scale makes random pairs meet about a tenth as often; the tables make up for the near pairs it parts.
    """
    scale = 2.0 + 0.5 * max(0.0, math.log10(max(1, largest) / 50_000))
    random = np.random.default_rng([seed, 8])
    a, b = _unit(random.normal(size=(2000, 64))), random.normal(size=(2000, 64))
    b = _unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    n, trials = len(a), 4
    cells = [cell_rows(x, np.zeros(n, np.int64), trials, probes, scale, seed)[1].reshape(trials, n, probes + 1) for x in (a, least * a + math.sqrt(1 - least**2) * b)]
    meet = ((cells[0][..., :1] == cells[1]).any(axis=-1) | (cells[1][..., :1] == cells[0]).any(axis=-1)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, max(1e-4, float(meet)))))), scale


def most_signs(least: float) -> int:
    """Signs that may differ: more do with probability ``MISS`` at most for a pair at the least cosine."""
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    tail = 1.0
    for k in range(BITS + 1):
        tail -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if tail <= MISS:
            return k
    return BITS


def _signs(units: np.ndarray, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, 64, units.shape[1]]).normal(size=(units.shape[1], BITS))
    return np.packbits(units @ planes >= 0, axis=1).view(np.int64).ravel()


def _rows_of(nodes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                vectors = pa.concat_arrays([batch.column("vector")])
                for at in _by_width(vectors):
                    part = batch.take(pa.array(at))
                    units = _unit(_matrix(part.column("vector")))
                    rows, cells, probe = cell_rows(units, part.column("salt").to_numpy(), tables, probes, scale, seed)
                    ids, signs = part.column("id").to_numpy()[rows], _signs(units, seed)[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(ids), pa.array(signs), pa.array(probe)], ["cell", "id", "signs", "probe"])

    return nodes.mapInArrow(run, "cell long, id long, signs long, probe boolean")


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(odd)
    return h ^ (h >> np.uint64(29))


def _sets_of_cells(most: int):
    """Sets of two or more ids of a cell that signs link, named by a hash of their members."""

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b) <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_chunks(batches):
            ids, signs = table.column("id").to_numpy(), table.column("signs").to_numpy().view(np.uint64)
            home = ~table.column("probe").to_numpy(zero_copy_only=False)
            root = np.arange(len(ids))
            sizes = np.diff(bounds)
            small = sizes <= SMALL
            # rows of large cells stand alone here
            edges = np.unique(np.concatenate([bounds, np.flatnonzero(np.repeat(~small, sizes))]))
            some = [np.zeros((2, 0), np.int64)]
            for i, j in small_pairs(edges) if small.any() else ():
                near = (home[i] | home[j]) & differ(signs[i], signs[j])
                some.append(np.stack([i[near], j[near]]))
            i, j = np.concatenate(some, axis=1)
            while len(i):
                lower = np.minimum(root[i], root[j])
                if (lower == root[i]).all() and (lower == root[j]).all():
                    break
                np.minimum.at(root, i, lower)
                np.minimum.at(root, j, lower)
            for a, b in ((bounds[k], bounds[k + 1]) for k in np.flatnonzero(~small)):
                if home[a:b].any():
                    near = differ(signs[a:b, None], signs[None, a:b]) & (home[a:b, None] | home[None, a:b])
                    np.fill_diagonal(near, True)
                    root[a:b] = _smallest_linked(near, root[a:b])
            members = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            members = members[np.argsort(root[members], kind="stable")]
            if len(members):
                starts = np.flatnonzero(np.diff(root[members], prepend=-1))
                names = np.add.reduceat(_mixed(ids[members]), starts).view(np.int64)
                names = np.repeat(names, np.diff(np.append(starts, len(members))))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[members])], ["_key", "id"])

    return run


def _smallest_linked(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over the links ``near``."""
    root = ids.copy()
    while True:
        lower = np.where(near, root[None, :], root[:, None]).min(axis=1)
        if (lower == root).all():
            return root
        root = lower


def _join_sets(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_chunks(batches):
            ids = table.column("id").to_numpy()
            out: list[np.ndarray] = []
            for a, b in itertools.pairwise(bounds.tolist()):
                column = pa.concat_arrays(table.column("vector").slice(a, b - a).chunks)
                for at in _by_width(column):
                    if len(at) < 2:
                        continue
                    own = ids[a:b][at]
                    units = _unit(_matrix(column.take(pa.array(at))))
                    root = _smallest_linked(units @ units.T >= least, own)
                    joined = root != own
                    out.append(np.stack([own[joined], root[joined]], axis=1))
            links = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def _count_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_chunks(batches):
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            block, lo, hi = (table.column(c).to_numpy() for c in ("_block", "_lo", "_hi"))
            found = np.zeros(len(ids), np.int64)
            for a, b in itertools.pairwise(bounds.tolist()):
                column = pa.concat_arrays(table.column("vector").slice(a, b - a).chunks)
                for at in _by_width(column):
                    units = _unit(_matrix(column.take(pa.array(at))))
                    near = units @ units.T >= least
                    np.fill_diagonal(near, False)
                    own = block[a:b][at]
                    if lo[a] != hi[a]:  # pairs inside a block belong to the block's own group
                        near &= own[:, None] != own[None, :]
                    found[a:b][at] += near @ copies[a:b][at]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], ["id", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.93, recall: float = 0.995, probes: int = 4, seed: int = 7, limit: int = 512,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row.

    Vectors are compared only where labels are equal and not null and lengths are equal.  Null and
    empty vectors, zero vectors and those with null or non-finite entries link with nothing, nor do
    rows with a null id; they are kept as their own component.  Repeated rows count as links of each
    other.  Other columns are ignored.
    """
    vector = F.col(vector_col)
    valid = (
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull()
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("own"), F.col(label_col).alias("label"), vector.alias("vector"), F.coalesce(valid, F.lit(False)).alias("valid"))
    # equal vectors meet by a hash and are then compared; -0.0 and 0.0 are different here, which only makes one node more
    keyed = rows.withColumn("key", F.xxhash64("label", "vector"))
    nodes = (
        keyed.where("valid")
        .groupBy("key", "label", "vector")
        .agg(F.min("own").alias("id"), F.count("*").alias("copies"))
        .select("id", "key", "label", "vector", "copies", F.xxhash64("label", F.size("vector")).alias("salt"))
    )
    nodes = materialize(nodes, "vector-nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, scale = lattice(largest, least, probes, recall, seed)
    cells = _rows_of(nodes.select("id", "vector", "salt"), tables, probes, scale, seed)
    groups = sorted_groups(bounded_groups(cells, "cell", F.col("id"), limit))
    sets = groups.mapInArrow(_sets_of_cells(most_signs(least)), "_key long, id long").distinct()
    fetched = sets.join(nodes.select("id", "vector"), "id").select("_key", F.lit(0).alias("_lo"), F.lit(0).alias("_hi"), "id", "vector")
    comps = materialize(connected_components(sorted_groups(fetched).mapInArrow(_join_sets(least), "a long, b long")), "vector-components")
    members = nodes.join(comps, F.col("id") == F.col("node")).select("component", "id", "vector", "copies")
    counted = sorted_groups(bounded_groups(members, "component", F.col("id"), limit)).mapInArrow(_count_links(least), "id long, n long")
    linked = counted.groupBy("id").agg(F.sum("n").alias("others"))
    node_facts = (
        nodes.select("id", "key", "label", "vector", "copies")
        .join(comps.withColumnRenamed("node", "_node"), F.col("id") == F.col("_node"), "left")
        .join(linked.withColumnRenamed("id", "_linked"), F.col("id") == F.col("_linked"), "left")
        .select(
            F.col("key").alias("_key"), F.col("label").alias("_label"), F.col("vector").alias("_vector"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_n"), F.coalesce("component", "id").alias("_component"),
        )
    )
    facts = materialize(node_facts, "vector-facts")
    same = F.col("valid") & (F.col("key") == F.col("_key")) & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    out = keyed.join(facts, same, "left").select(
        F.col("own").alias(id_col), F.coalesce("_n", F.lit(0)).alias("n_links"), F.coalesce("_component", "own").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all rows of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in DuckDB, where all links are found by comparing all pairs of a label.
SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
