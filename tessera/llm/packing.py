"""Packing token sequences into bins by minimum bin slack.

For each bin a subset-sum dynamic program over the lengths that are left, held
as a bitset in an integer, finds the fullest combination that contains the
largest length; the combination is then removed.  Only the histogram of lengths
matters, and it has at most ``capacity`` entries, so equal bins are made
together: a combination is used as often as its lengths last, which are the bins
that one-by-one packing would make.  Pieces find their bin by their rank among
those of their length, counted in salted groups, so no length is one task's work.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._storage import materialize

CAPACITY = 1024
END = 2  # the id after each document
PER_SALT = 100_000  # pieces of one length that a task ranks, about
#: The pre-tokenisation pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder with the ids of the byte-level BPE tokenizer in a tokenizers JSON file.

    The file's own library gives the same ids at about a quarter of the speed; tests compare both.
    ``encode_ordinary`` takes strings of special tokens in a text as ordinary text; :func:`encode_text`
    gives them their ids, as the library does by default.
    """
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    # printable stand-ins of bytes in the file: printable Latin-1 stands for itself, the rest from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    specials = {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    for token in specials:
        ranks.pop(token.encode(), None)
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)


def encode_text(path: str):
    """A function from a text to its ids; strings of the file's added tokens are one id each."""
    e = encoder(path)
    specials = sorted(e.special_tokens_set)
    # a search for the strings is faster than the encoder's own, and few texts hold one
    return lambda text: e.encode(text, allowed_special="all") if any(x in text for x in specials) else e.encode_ordinary(text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, path: str | None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32``: the pieces of each text's ids with ``end`` after them.

    Texts are encoded whole; null is empty, which gives a piece of length 1.  Only ids longer than
    ``capacity`` are cut; then the first piece is the shorter one.  ``path`` is that of the tokenizer
    on the machines of the executors; where it is None they ask the installed vocabulary files.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_text(path or default_tokenizer())
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def _fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, with repeats, whose sum is the largest up to ``room``; larger lengths come first."""
    reach, steps = 1, []  # bit s: some combination has the sum s
    inside = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies at once
            k = min(k, left)
            more = (reach | reach << (k * length)) & inside
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            out += [length] * k
            best -= length * k
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths in a bin, number of such bins) for a histogram of lengths from 1 to ``capacity``."""
    left = {x: n for x, n in counts.items() if n > 0}
    bins = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        chosen = [largest, *_fullest(rest, capacity - largest)]
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        bins.append((sorted(chosen, reverse=True), times))
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, in a bin, first bin, offset): where the pieces of each length go by their rank."""
    out, next_rank, next_bin = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            out.append((x, next_rank.get(x, 0), k * times, k, next_bin, offset))
            next_rank[x] = next_rank.get(x, 0) + k * times
            offset += k * x
        next_bin += times
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, a stored table, with ``sequence_id`` and ``offset``.

    Lengths are from 1 to ``capacity``.  What reaches the driver is the histogram of the lengths, at
    most ``capacity`` rows, whatever the input.  Each length has as many salted groups as its pieces need.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(minimum_bin_slack(counts, capacity))
    salts = spark.createDataFrame([(x, -(-n // PER_SALT)) for x, n in sorted(counts.items())], "_l long, _salts long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_l"))  # at most ``capacity`` rows
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.col("_salts"))).drop("_l", "_salts")
    upto = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # a row for each salt
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = sums.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    line = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = (
        salted.withColumn("_in", F.row_number().over(line) - 1)
        .join(first, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_l", "_s", "_before", "_in", "_salt")
    )
    names = [c for c in ranked.columns if c != "_rank"]
    by_length: dict[int, list] = {}
    for x, *slot in slots:
        by_length.setdefault(x, []).append(slot)
    table = {x: np.array(s, np.int64) for x, s in by_length.items()}  # a few thousand slots at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == x)
                slot = table[x][np.searchsorted(table[x][:, 0], ranks[rows], side="right") - 1]
                within = ranks[rows] - slot[:, 0]
                sequence[rows] = slot[:, 3] + within // slot[:, 2]
                offset[rows] = slot[:, 4] + within % slot[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` with their places.

    Null and empty texts give one piece of the end id.  Rows with equal ids are packed each for
    itself.  An empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "token-pieces")
    return pack(pieces, id_col, capacity)


def op2_query(spark, sf_dir: str) -> DataFrame:
    """The packing of all ``documents`` into sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
