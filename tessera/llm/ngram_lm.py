"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Training counts words, bigrams and, at order 3, trigrams of all training documents.  Each task sums the
counts of some megabytes of text and deals them to shards by the first word, as
packed arrays; a shard's task merges them and writes a trie file to the shared
folder.  The upper level holds the sorted 64-bit word hashes as an Elias-Fano
sequence, with counts.  In the lower level the high bits, coded in unary, are
the monotone pointers from a word to its successors, and the low bits are the
40-bit hashes of the successors, sorted within their word: a bigram is found by
a search among the successors of its context.  The third level, of trigrams, has
the places of bigrams as its pointers.  Bigrams seen less often than ``min_count``
are pruned, which leaves none out at 1; the others have a probability with
absolute discount, quantised to 16 bits, and each context has the mass that is
left for shorter contexts.

Frequent words have too many successors for one shard: theirs are dealt by ranges
of the successor's hash.  Which words are so dealt is learned from a few thousand
documents; it decides where counts lie, not what they are.  A shard has the
probabilities of a range within the range; the share of the range among all of the
word's successors is multiplied in when scoring.

Scoring maps the files into memory, looks the distinct bigrams of some megabytes
of text up, and sums log10 probabilities by document.

Two words share a 64-bit hash with probability 3e-6 among ten million; two
successors of a word share 40 bits with probability 5e-7 among a thousand.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import keep_path, materialize, new_path

CHUNK = 24 << 20  # bytes of text whose counts are summed at once
SHARD_TEXT = 32 << 20  # bytes of training text for each shard
MAX_SHARDS = 1 << 16  # a task deals its counts to so many; beyond a terabyte of text shards grow
HOT_DOCS = 4096  # documents, about, from which the frequent words are learned
DISCOUNT = 0.75
MIN_COUNT = 2  # bigrams seen less often are pruned
STEP = 10.0 / 65535  # of log10 in a quantised probability
END, START = b"\n", b"\t"  # no word holds these
CHILD_BYTES = 5


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 20240229)


END_HASH, START_HASH = np.uint64(word_hash(END)), np.uint64(word_hash(START))
CHILD_SHIFT = np.uint64(64 - 8 * CHILD_BYTES)


# ---------------------------------------------------------------- texts


@dataclass
class Tokens:
    """The tokens of some texts as numbers of a local vocabulary in the order of its hashes; an end after each text."""

    hashes: np.ndarray  # of the vocabulary, the end and the start
    ids: np.ndarray
    before: np.ndarray  # the token before each
    starts: np.ndarray  # of the texts
    start: int  # the number of the start


def tokenise(texts: pa.Array) -> Tokens:
    """Words between the characters 0x09-0x0D and 0x20, A-Z lower-cased; null is empty."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(words)
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # a text without a word gives one empty string
    if blank.any():
        sizes -= np.add.reduceat(np.append(blank, False).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0)
        flat = flat.filter(pa.array(~blank))
    coded = flat.dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.concatenate([np.fromiter(map(word_hash, known), np.uint64, len(known)), [END_HASH, START_HASH]])
    order = np.argsort(hashes)
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    ends = np.cumsum(sizes + 1) - 1
    ids = np.full(int(sizes.sum()) + len(sizes), rank[-2], np.int64)
    is_word = np.ones(len(ids), bool)
    is_word[ends] = False
    ids[is_word] = rank[coded.indices.to_numpy()]
    starts = ends - sizes
    before = np.concatenate([[0], ids[:-1]])
    before[starts] = rank[-1]
    return Tokens(hashes[order], ids, before, starts, int(rank[-1]))


def _chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Batches cut into pieces of about ``size`` bytes of text, tokenised; a text is never cut."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        first = 0
        while first < batch.num_rows:
            done = upto[first - 1] if first else 0
            after = min(batch.num_rows, int(np.searchsorted(upto, done + size)) + 1)
            yield batch.slice(first, after - first), tokenise(batch.column(column).slice(first, after - first))
            pa.default_memory_pool().release_unused()
            first = after


# ---------------------------------------------------------------- counting


def _pack_children(children: np.ndarray) -> np.ndarray:
    """The top 40 bits of hashes as 5 bytes each, low byte first."""
    return np.ascontiguousarray((children >> CHILD_SHIFT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHILD_BYTES])


def _unpack(low: np.ndarray) -> np.ndarray:
    """Rows of bytes, low byte first, as numbers."""
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : low.shape[1]] = low
    return wide.view("<u8").ravel()


@dataclass
class Hot:
    """Frequent words: their successors are dealt to 2 ** bits ranges of the successor's hash."""

    hashes: np.ndarray
    bits: np.ndarray

    def find(self, context: np.ndarray) -> np.ndarray:
        """The number of each context among the frequent words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.hashes, context), len(self.hashes) - 1)
        return np.where(self.hashes[at] == context, at, -1)

    def shard(self, context: np.ndarray, child: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each pair."""
        hot = self.find(context)
        key = context.copy()
        at = np.flatnonzero(hot >= 0)
        spread = child[at] >> (np.uint64(63) - self.bits[hot[at]].astype(np.uint64)) >> np.uint64(1)
        key[at] += spread * np.uint64(0x9E3779B97F4A7C15)
        return _shard(key, shards)


def _count_rows(shards: int, order: int, hot: Hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, 0, CHUNK if order == 2 else CHUNK // 3):
            hashes, tokens, before, starts = chunk.hashes, chunk.ids, chunk.before, chunk.starts
            counts = np.bincount(tokens, minlength=len(hashes))
            counts[chunk.start] = len(starts)  # as a context
            n = np.int64(len(hashes))
            triples, triple_counts = np.zeros((2, 0), np.int64)
            pairs, which, pair_counts = np.unique(before * n + tokens, return_inverse=True, return_counts=True)
            if order == 3:
                triples, triple_counts = np.unique(_triples(which, tokens, starts, n), return_counts=True)
            del which, tokens, before
            chunk.ids = chunk.before = None
            context, child = hashes[pairs // n], hashes[pairs % n]
            word_shard, pair_shard = _shard(hashes, shards), hot.shard(context, child, shards)
            pair_order = np.argsort(pair_shard, kind="stable")  # in order already but for frequent words
            word_cut = np.searchsorted(word_shard, np.arange(shards + 1))
            pair_cut = np.searchsorted(pair_shard[pair_order], np.arange(shards + 1))
            rank = np.empty(len(pairs), np.int64)
            rank[pair_order] = np.arange(len(pairs))
            above, third = rank[triples // n], hashes[triples % n]  # triples stand in the order of their pairs
            triple_order = np.argsort(above, kind="stable")
            triple_sizes = np.bincount(above, minlength=len(pairs))
            triple_cut = np.concatenate([[0], np.cumsum(triple_sizes)])[pair_cut]
            out_shard, blobs = [], []
            for s in np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(pair_cut) > 0)).tolist():
                w, p = slice(word_cut[s], word_cut[s + 1]), pair_order[pair_cut[s] : pair_cut[s + 1]]
                heads, sizes = np.unique(context[p], return_counts=True)
                t = triple_order[triple_cut[s] : triple_cut[s + 1]]
                arrays = [hashes[w].astype("<u8"), counts[w].astype("<u4"), heads.astype("<u8"), sizes.astype("<u4"), _pack_children(child[p]), pair_counts[p].astype("<u4")]
                if order == 3:
                    arrays += [triple_sizes[pair_cut[s] : pair_cut[s + 1]].astype("<u4"), _pack_children(third[t]), triple_counts[t].astype("<u4")]
                head = np.array([w.stop - w.start, len(heads), len(p), len(p) * (order == 3), len(t)], "<u8")
                raw = b"".join(x.tobytes() for x in [head, *arrays])
                blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
                out_shard.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "counts"])

    return run


def _triples(which: np.ndarray, tokens: np.ndarray, starts: np.ndarray, n: np.int64) -> np.ndarray:
    """The number of the pair before each token, and the token, as one number; first tokens of texts have no pair."""
    inner = np.ones(len(tokens), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    return which[at - 1] * n + tokens[at]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _read_counts(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    words, heads, pairs, above, triples = np.frombuffer(raw, "<u8", 5).astype(int)
    out, at = [], 40
    for kind, n in (
        ("<u8", words), ("<u4", words), ("<u8", heads), ("<u4", heads), (np.uint8, pairs * CHILD_BYTES), ("<u4", pairs),
        ("<u4", above), (np.uint8, triples * CHILD_BYTES), ("<u4", triples),
    ):
        out.append(np.frombuffer(raw, kind, n, at) if n else np.zeros(0, kind))
        at += out[-1].nbytes
    for i in (4, 7):
        out[i] = _unpack(out[i].reshape(-1, CHILD_BYTES))
    return out


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- the trie


class EliasFano:
    """Sorted numbers as low bytes and unary high parts, with a directory of zeros.

    The numbers with the high part h stand from ``first(h)`` to ``first(h + 1)``.
    """

    BLOCK = 16  # bytes of the bit vector for each entry of the directory
    ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)
    #: place of the k-th zero in a byte, low bit first
    PLACE = np.array([[next((i for i in range(8) if not b >> i & 1 and sum(not b >> j & 1 for j in range(i)) == k), 0) for k in range(8)] for b in range(256)], np.uint8)

    PAD = 8  # bytes after the low parts, so that eight bytes can be read from each

    def __init__(self, low: np.ndarray, bits: np.ndarray, zeros: np.ndarray) -> None:
        self.low, self.bits, self.zeros = low, bits, zeros
        self.padded: np.ndarray | None = None

    @classmethod
    def mapped(cls, low: np.ndarray, width: int, bits: np.ndarray, zeros: np.ndarray) -> EliasFano:
        """From arrays of a file, where ``low`` is flat and has the bytes after it."""
        n = (len(low) - cls.PAD) // width
        out = cls(low[: n * width].reshape(n, width), bits, zeros)
        out.padded = low
        return out

    def _lows(self) -> tuple[np.ndarray, np.uint64]:
        """Eight bytes from the start of each low part, as numbers, and the mask of the part."""
        n, width = self.low.shape
        if self.padded is None:
            self.padded = np.concatenate([self.low.reshape(-1), np.zeros(self.PAD, np.uint8)])
        wide = np.lib.stride_tricks.as_strided(self.padded[:8].view("<u8"), (n,), (width,), writeable=False)
        return wide, np.uint64((1 << (8 * width)) - 1)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, highs: int) -> EliasFano:
        """``high`` sorted numbers below ``highs``; ``low`` rows of bytes in order within each."""
        length = len(high) + highs + 1
        bits = np.zeros(-(-length // (8 * cls.BLOCK)) * 8 * cls.BLOCK, np.uint8)
        bits[high.astype(np.int64) + np.arange(len(high))] = 1
        packed = np.packbits(bits, bitorder="little")
        in_block = cls.ZEROS[packed].reshape(-1, cls.BLOCK).sum(axis=1, dtype=np.int64)
        return cls(low, packed, np.concatenate([[0], np.cumsum(in_block)[:-1]]).astype("<i8"))

    def first(self, h: np.ndarray) -> np.ndarray:
        """The number of entries with a high part below each ``h``."""
        k = np.maximum(h - 1, 0)  # the zero that ends high part h - 1
        block = np.searchsorted(self.zeros, k, side="right") - 1
        inside = self.ZEROS[(window := self.bits.reshape(-1, self.BLOCK)[block])]
        upto = np.cumsum(inside, axis=1, dtype=np.uint8)  # a block has 128 bits
        rest = k - self.zeros[block]
        byte = (upto <= rest.astype(np.uint8)[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        rest -= np.where(byte > 0, upto[rows, byte - 1], 0)
        place = (block * self.BLOCK + byte) * 8 + self.PLACE[window[rows, byte], rest]
        return np.where(h > 0, place - k, 0)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of the entries with these parts, -1 where there is none: a search from the pointer on.

        Equal high parts next to each other share their pointers.
        """
        out = np.full(len(high), -1, np.int64)
        if not len(high) or not len(self.low):
            return out
        change = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        ends = self.first(np.concatenate([high[change], high[change] + 1]))
        times = np.diff(np.append(change, len(high)))
        a, b = np.repeat(ends[: len(change)], times), np.repeat(ends[len(change) :], times)
        lows, mask = self._lows()
        end = b.copy()
        active = np.flatnonzero(a < b)
        lo, hi, ask = a[active], b[active], low[active]
        while len(active):
            middle = (lo + hi) // 2
            less = (lows[middle] & mask) < ask
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
            open_ = lo < hi
            if not open_.all():
                a[active[~open_]] = lo[~open_]
                active, lo, hi, ask = active[open_], lo[open_], hi[open_], ask[open_]
        found = np.flatnonzero(a < end)
        hit = found[(lows[a[found]] & mask) == low[found]]
        out[hit] = a[hit]
        return out


def _codes(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit steps of -log10, rounded to the smaller one; the last code is zero."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log10(p) / STEP), 65535).astype("<u2")


def _decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 65535, 0.0, np.power(10.0, -STEP * codes.astype(np.float64)))


class Trie:
    """Two or three levels of a shard; arrays may be mapped from a file."""

    NAMES = (
        "word_low", "word_bits", "word_zeros", "counts", "sizes", "rest", "pair_low", "pair_bits", "pair_zeros", "probability",
        "pair_rest", "triple_low", "triple_bits", "triple_zeros", "triple_probability",
    )

    def __init__(self, facts: dict, arrays: dict[str, np.ndarray]) -> None:
        self.facts, self.arrays = facts, arrays
        level = lambda name, width: EliasFano.mapped(arrays[f"{name}_low"], width, arrays[f"{name}_bits"], arrays[f"{name}_zeros"])
        self.words, self.pairs, self.triples = level("word", facts["word_bytes"]), level("pair", CHILD_BYTES), level("triple", CHILD_BYTES)

    @classmethod
    def build(cls, blobs: list[bytes], order: int = 2, min_count: int = MIN_COUNT) -> Trie:
        parts = [_read_counts(b) for b in blobs]
        # contexts whose own count is in another shard count nothing here
        words, counts = _sum_by(np.concatenate([x for p in parts for x in (p[0], p[2])]), np.concatenate([x for p in parts for x in (p[1], np.zeros(len(p[2]), "<u4"))]))
        by_part = [(np.repeat(np.searchsorted(words, p[2]).astype(np.uint64), p[3]) << np.uint64(8 * CHILD_BYTES)) | p[4] for p in parts]
        pairs, pair_counts = _sum_by(np.concatenate(by_part), np.concatenate([p[5] for p in parts]))
        triples, triple_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if order == 3:
            keys = [(np.repeat(np.searchsorted(pairs, keys).astype(np.uint64), p[6]) << np.uint64(8 * CHILD_BYTES)) | p[7] for keys, p in zip(by_part, parts, strict=True)]
            triples, triple_counts = _sum_by(np.concatenate(keys), np.concatenate([p[8] for p in parts]))
            del keys
        del by_part
        real = (words != START_HASH) & (counts > 0)
        facts = {"tokens": int(counts[real].sum()), "vocabulary": int(real.sum()), "pairs": len(pairs), "words": len(words), "triples": len(triples)}
        # a pair is followed by a word whenever it is no end, so its count is that of the context
        pair_place = (triples >> np.uint64(8 * CHILD_BYTES)).astype(np.int64)
        triple_codes = _codes((triple_counts - DISCOUNT) / pair_counts[pair_place])
        pair_rest = _codes(np.maximum(1e-12, 1.0 - np.bincount(pair_place, _decode(triple_codes), minlength=len(pairs))))[: len(pairs) if order == 3 else 0]
        third = np.ascontiguousarray(triples.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHILD_BYTES])
        lowest = EliasFano.build(pair_place, third, len(pairs) if order == 3 else 0)
        sizes = np.bincount((pairs >> np.uint64(8 * CHILD_BYTES)).astype(np.int64), pair_counts, minlength=len(words))  # of the successors in this shard
        kept = pair_counts >= min_count
        pairs, pair_counts = pairs[kept], pair_counts[kept]
        context = (pairs >> np.uint64(8 * CHILD_BYTES)).astype(np.int64)
        codes = _codes((pair_counts - DISCOUNT) / sizes[context])
        rest = _codes(np.maximum(1e-12, 1.0 - np.bincount(context, _decode(codes), minlength=len(words))))
        # the low bytes of a word's hash: so many that about 16 words share the rest
        word_bytes = min(7, max(4, -(-(64 - max(0, len(words).bit_length() - 4)) // 8)))
        shift = np.uint64(8 * word_bytes)
        low = np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :word_bytes])
        level = EliasFano.build(words >> shift, low, 1 << (64 - 8 * word_bytes))
        child = np.ascontiguousarray(pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHILD_BYTES])
        lower = EliasFano.build(context, child, len(words))
        facts |= {"word_bytes": word_bytes, "kept": len(pairs)}
        flat = lambda e: np.concatenate([e.low.reshape(-1), np.zeros(EliasFano.PAD, np.uint8)])
        arrays = [flat(level), level.bits, level.zeros, counts.astype("<u8"), sizes.astype("<u8"), rest, flat(lower), lower.bits, lower.zeros, codes, pair_rest, flat(lowest), lowest.bits, lowest.zeros, triple_codes]
        return cls(facts, dict(zip(cls.NAMES, arrays, strict=True)))

    def to_bytes(self) -> bytes:
        at, where, parts = 0, {}, []
        for name in self.NAMES:
            data = np.ascontiguousarray(self.arrays[name])
            where[name] = (data.dtype.str, data.size, at)
            parts += [data.tobytes(), bytes(-data.nbytes % 8)]
            at += data.nbytes + -data.nbytes % 8
        head = json.dumps({"facts": self.facts, "arrays": where}).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(parts)

    @classmethod
    def from_buffer(cls, data: np.ndarray) -> Trie:
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        arrays = {}
        for name, (kind, n, at) in head["arrays"].items():
            arrays[name] = data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)
        return cls(head["facts"], arrays)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Places of word hashes in the upper level, -1 where there is none."""
        shift = np.uint64(8 * self.facts["word_bytes"])
        return self.words.find((words >> shift).astype(np.int64), words & ((np.uint64(1) << shift) - np.uint64(1)))

    def conditional(self, place: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of a child after the word at ``place``, mass left for shorter contexts, place of the pair); (0, 1, -1) after an unknown word."""
        p, rest, found = np.zeros(len(place)), np.ones(len(place)), np.full(len(place), -1, np.int64)
        known = np.flatnonzero(place >= 0)
        rest[known] = _decode(self.arrays["rest"][place[known]])
        at = self.pairs.find(place[known], children[known] >> CHILD_SHIFT)
        hit = at >= 0
        p[known[hit]] = _decode(self.arrays["probability"][at[hit]])
        found[known] = at
        return p, rest, found

    def after_pair(self, place: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a child after the pair at ``place``, mass left for shorter contexts); (0, 1) after an unknown pair."""
        p, rest = np.zeros(len(place)), np.ones(len(place))
        known = np.flatnonzero(place >= 0)
        rest[known] = _decode(self.arrays["pair_rest"][place[known]])
        at = self.triples.find(place[known], children[known] >> CHILD_SHIFT)
        hit = at >= 0
        p[known[hit]] = _decode(self.arrays["triple_probability"][at[hit]])
        return p, rest


# ---------------------------------------------------------------- files in the shared folder


def _local(path: str) -> str | None:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def _write(path: str, data: bytes) -> None:
    """Write a file and then give it its name: a repeated task replaces the file by an equal one."""
    part = f"{path}.{uuid.uuid4().hex}"
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(_local(part), "xb") as f:
            f.write(data)
        os.replace(_local(part), local)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(part)
    system.create_dir(where.rpartition("/")[0], recursive=True)
    with system.open_output_stream(where) as f:
        f.write(data)
    system.move(where, fs.FileSystem.from_uri(path)[1])


@lru_cache(maxsize=1024)
def _map(path: str) -> Trie | None:
    return Trie.from_buffer(np.memmap(path, np.uint8, "r")) if os.path.exists(path) else None


@lru_cache(maxsize=4)
def _fetch(path: str) -> Trie | None:
    """A trie read into mapped memory, from a store that is no file system of this machine; few are kept."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        return None
    memory = mmap.mmap(-1, max(1, info.size))
    with system.open_input_stream(where) as f:
        while part := f.read(1 << 24):
            memory.write(part)
    return Trie.from_buffer(np.frombuffer(memory, np.uint8))


def _open(model: dict, shard: int) -> Trie | None:
    """The trie of a shard; None if nothing was dealt to it."""
    path = _path(model["folder"], shard)
    local = _local(path)
    return _map(local) if local else _fetch(path)


def _path(folder: str, shard: int) -> str:
    return f"{folder}/{shard:06d}.trie"


# ---------------------------------------------------------------- the operator


def _hot_words(texts: DataFrame, shards: int, rows: int) -> Hot:
    """Words with more successors than a quarter of a shard, by some thousand documents, and the start of texts.

    The sample decides about places only.  At most 4 * ``shards`` words reach the driver.
    """
    if shards < 4:
        return Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, 0):
            counts = np.bincount(chunk.before, minlength=len(chunk.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.hashes.view(np.int64)), pa.array(counts)], ["h", "n"])

    share = min(1 << 30, (HOT_DOCS << 30) // max(1, rows))  # a filter, so no text moves
    found = texts.where(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 30)) < share).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n")).limit(4 * shards).collect()
    total = sum(r["n"] for r in found)
    rows = sorted((np.uint64(r["h"] & (2**64 - 1)), 4 * shards * r["n"] / total) for r in found if 4 * shards * r["n"] > total)
    return Hot(np.array([h for h, _ in rows], np.uint64), np.array([min(30, int(np.ceil(np.log2(x)))) for _, x in rows], np.int64))


def train(texts: DataFrame, text_col: str = "text", order: int = 2, min_count: int = MIN_COUNT) -> dict:
    """A model of all ``texts``, of bigrams or trigrams: the folder of the shards' tries, and the sums N and V.

    What reaches the driver are sums, and a row for each frequent word.  Null texts are empty; no text at all
    gives a model of no word.
    """
    if order not in (2, 3) or order == 3 and min_count != 1:
        raise ValueError("order is 2 or 3, and trigrams need min_count 1")
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).alias("text"))
    facts = texts.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.count("*").alias("rows")).first()
    size = facts["n"] or 0
    shards = int(min(MAX_SHARDS, max(1, -(-size // (SHARD_TEXT if order == 2 else SHARD_TEXT // 2)))))
    folder = keep_path(new_path(spark, "tries"))
    hot = _hot_words(texts, shards, facts["rows"])
    counts = texts.mapInArrow(_count_rows(shards, order, hot), "shard int, counts binary")
    schema = "shard int, tokens long, vocabulary long, pairs long, kept long, hot array<struct<word:int,size:double,rest:double>>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
            trie = Trie.build(blobs, order, min_count)
            _write(_path(folder, shard), trie.to_bytes())
            at = trie.lookup(hot.hashes)
            here = [{"word": int(i), "size": float(trie.arrays["sizes"][at[i]]), "rest": float(_decode(trie.arrays["rest"][at[i]]))} for i in np.flatnonzero(at >= 0)]
            row = {"shard": shard, "hot": here} | {k: trie.facts[k] for k in ("tokens", "vocabulary", "pairs", "kept")}
            return pa.RecordBatch.from_pylist([row], schema=shape)

        kind = pa.list_(pa.struct([("word", pa.int32()), ("size", pa.float64()), ("rest", pa.float64())]))
        shape = pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in ("tokens", "vocabulary", "pairs", "kept")), ("hot", kind)])
        now, blobs = -1, []
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and blobs:
                    yield done(now, blobs)
                    blobs = []
                now = shard
                blobs.append(blob)
        if blobs:
            yield done(now, blobs)

    dealt = counts.repartition(shards, "shard").sortWithinPartitions("shard")
    built = materialize(dealt.mapInArrow(build, schema), "trie-shards")
    sums = built.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "vocabulary", "pairs", "kept")]).first().asDict()
    total, rest = np.zeros(len(hot.hashes)), np.zeros(len(hot.hashes))
    one = built.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.size").alias("n"), F.sum(F.col("h.size") * F.col("h.rest")).alias("r"))
    for r in one.collect():  # one for each frequent word
        total[r["word"]], rest[r["word"]] = r["n"], r["r"]
    rest = np.where(total > 0, rest / np.maximum(total, 1), 1.0)
    return {"order": order, "shards": shards, "folder": folder, "hot": hot, "hot_total": total, "hot_rest": rest} | sums


def _by_shard(shard: np.ndarray, model: dict) -> Iterator[tuple[np.ndarray, Trie]]:
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
    for a, b in zip(first, np.append(first[1:], len(ordered)), strict=True):
        if trie := _open(model, int(ordered[a])):
            yield order[a:b], trie


def score_chunk(tokens: Tokens, model: dict) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    hashes, ids, before, starts = tokens.hashes, tokens.ids, tokens.before, tokens.starts
    hot = model["hot"]
    place, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes))
    for at, trie in _by_shard(_shard(hashes, model["shards"]), model):
        place[at] = trie.lookup(hashes[at])
        hit = at[place[at] >= 0]
        counts[hit] = trie.arrays["counts"][place[hit]]
    unigram = (counts + 0.5) / (model["tokens"] + 0.5 * (model["vocabulary"] + 1))
    n = np.int64(len(hashes))
    pairs, which = np.unique(before * n + ids, return_inverse=True)
    context, child = pairs // n, pairs % n
    p, rest, found = np.zeros(len(pairs)), np.ones(len(pairs)), np.full(len(pairs), -1, np.int64)
    frequent = hot.find(hashes)[context]
    pair_shard = hot.shard(hashes[context], hashes[child], model["shards"])
    for at, trie in _by_shard(pair_shard, model):
        own, many = place[context[at]], np.flatnonzero(frequent[at] >= 0)
        own[many] = trie.lookup(hashes[context[at[many]]])
        p[at], rest[at], found[at] = trie.conditional(own, hashes[child[at]])
        there = many[own[many] >= 0]  # the share of the range among all successors
        p[at[there]] *= trie.arrays["sizes"][own[there]] / model["hot_total"][frequent[at[there]]]
    of_hot = frequent >= 0
    rest[of_hot] = model["hot_rest"][frequent[of_hot]]
    by_token = (p + rest * unigram[child])[which]
    if model["order"] == 3:
        triples, which_triple = np.unique(_triples(which, ids, starts, n), return_inverse=True)
        above, third = triples // n, triples % n
        p, rest = np.zeros(len(triples)), np.ones(len(triples))
        for at, trie in _by_shard(pair_shard[above], model):
            p[at], rest[at] = trie.after_pair(found[above[at]], hashes[third[at]])
        inner = np.ones(len(ids), bool)
        inner[starts] = False
        by_token[inner] = p[which_triple] + rest[which_triple] * by_token[inner]
    total = lambda x: np.add.reduceat(x, starts)
    return {
        "n_tokens": total(np.ones(len(ids), np.int64)),
        "n_known": total((counts[ids] > 0).astype(np.int64)),
        "base_score": total(np.log10(unigram)[ids]),
        "score": total(np.log10(by_token)),
    }


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` of each row; a null or empty text is one end."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some numbers for each frequent word
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens in _chunks(batches, 1, CHUNK // 4):
            found = score_chunk(tokens, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c]) for c in names)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 of the text form has the remainder 1 modulo 5; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents`` by a trigram model of all n-grams of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()), order=3, min_count=1)
    scored = score(docs, model).withColumn("train_tokens", F.lit(model["tokens"]).cast("long"))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
