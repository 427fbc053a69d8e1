"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Byte bigrams and trigrams of the lower-cased letters are hashed into a vector,
weighted by TF-IDF and normalised.  Each language has several centroids from
spherical k-means; a text gets the language of the centroid with the largest
cosine.  A text whose cosine lies far below what training texts of its length
reach is marked as rejected; so are unseen languages and random letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import free_prefix

SIZE = 1 << 13  # entries of a vector
PER_LANGUAGE = 300  # training texts of a language, about: the bound of the sample that the classifier is fitted on
CENTROIDS = 4  # of a language
REJECT = 0.5  # of the lowest cosine that training texts of that length have
SLICE = 512  # texts that are classified together
ENOUGH = 64  # training texts of a length for a floor of its own
LENGTHS = 24  # classes of length: powers of two of the n-grams
UNKNOWN = "und"
MAX_BROADCAST = 10_000  # languages whose sampling shares are sent to all tasks
#: ASCII characters other than letters become spaces.
TO_SPACE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of byte bigrams and trigrams within and around the words of a whole text."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(TO_SPACE).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    shift = np.uint32(32 - SIZE.bit_length() + 1)
    slots = np.concatenate([(two * np.uint32(0x9E3779B1)) >> shift, (three * np.uint32(0x85EBCA6B)) >> shift])
    return np.bincount(slots, minlength=SIZE).astype(np.float32)


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers of other kinds than digits, as ½ and Ⅷ, are none."""
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one per row, of length 1
    idf: np.ndarray
    floors: np.ndarray  # least cosine by class of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; ``und``, 0, rejected without a letter."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not self.languages:
            return out
        for k in range(0, len(rows), 128):
            at = rows[k : k + 128]
            counts = np.stack([ngram_counts(texts[i]) for i in at])
            cosines = self.vectors(counts) @ self.centroids.T
            best = cosines.argmax(axis=1)
            floor = self.floors[_length_class(counts)]
            for i, c, f, row in zip(at, best.tolist(), floor.tolist(), cosines, strict=True):
                score = min(1.0, max(0.0, float(row[c])))
                out[i] = (self.languages[c], score, score < f)
        return out


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), LENGTHS - 1)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the vector farthest from all."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    centres = [unit(v.mean(axis=0))]
    while len(centres) < min(k, len(v)):
        centres.append(v[(v @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.array([unit(v[near == i].mean(axis=0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), SIZE), np.float32)
    for i, (slots, values) in enumerate(rows):
        out[i, slots] = values
    return out


def train(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]], per_language: int = CENTROIDS) -> Model:
    """A model from the labelled n-gram counts of a sample, as (slots, counts), in an order that does not matter.

    Only one language's counts are held in full at a time.
    """
    order = sorted(range(len(languages)), key=lambda i: (languages[i], rows[i][0].tobytes(), rows[i][1].tobytes()))
    languages, rows = [languages[i] for i in order], [rows[i] for i in order]
    seen_in = np.bincount(np.concatenate([s.astype(np.int64) for s, _ in rows]), minlength=SIZE) if rows else np.zeros(SIZE, np.int64)
    idf = np.log((1 + len(rows)) / (1 + seen_in)).astype(np.float32) + 1
    model = Model([], np.zeros((0, SIZE), np.float32), idf, np.zeros(LENGTHS))
    if not languages:
        return model
    labels = np.array(languages)
    groups, own, classes = [], [], []
    for x in sorted(set(languages)):
        counts = _dense([rows[i] for i in np.flatnonzero(labels == x)])
        v = model.vectors(counts)
        c = _clusters(v, per_language)
        groups.append((x, c))
        own.append((v @ c.T).max(axis=1))
        classes.append(_length_class(counts))
    model.languages = [x for x, c in groups for _ in c]
    model.centroids = np.concatenate([c for _, c in groups]).astype(np.float32)
    # a text's own language; a shorter text needs no more than longer ones.  Classes with few training
    # texts count with the nearest that has enough; below all of these a floor
    # falls as a cosine does with the root of the n-grams
    own, classes = np.concatenate(own), np.concatenate(classes)
    sizes = np.bincount(classes, minlength=LENGTHS)
    seen = np.flatnonzero(sizes >= min(ENOUGH, sizes.max()))
    near = seen[np.abs(np.arange(LENGTHS)[:, None] - seen).argmin(axis=1)]
    least = np.array([own[near[classes] == k].min() * REJECT for k in seen])
    least = np.minimum.accumulate(least[::-1])[::-1]
    model.floors = least[np.searchsorted(seen, near)] * 0.5 ** (np.maximum(seen[0] - np.arange(LENGTHS), 0) / 2)
    return model


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 of the text form has the remainder 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` labelled rows of each language that are not held out.

    A row's hash decides whether it is in the sample.  What reaches the driver is a sparse vector
    of each text in the sample.
    """
    usable = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)).alias("draw")
    )
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return train([], [])
    below = docs.sparkSession.createDataFrame([(x, min(1 << 30, (per_language << 30) // n)) for x, n in sizes.items()], "_lang string, below long")
    if len(sizes) <= MAX_BROADCAST:  # so no text moves
        below = F.broadcast(below)
    sample = usable.join(below, (F.col("lang") == F.col("_lang")) & (F.col("draw") < F.col("below"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for text in batch.column(1):
                c = ngram_counts(text.as_py())
                at = np.flatnonzero(c)
                slots.append(at.astype("<u2").tobytes())
                values.append(c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["lang", "slots", "values"])

    rows = sample.mapInArrow(run, "lang string, slots binary, values binary").collect()
    return train([r["lang"] for r in rows], [(np.frombuffer(r["slots"], "<u2"), np.frombuffer(r["values"], "<f4")) for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``, each under ``prefix`` + name.

    Texts are read whole.  Null texts and texts without a letter get ``und``, score 0, and are
    rejected.  Languages are as in training; equal cosines go to the first language by name.
    Columns of ``docs`` with one of the new names, in any case, are replaced.
    """
    new = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    docs = docs.select(*[c for c in docs.columns if c == text_col or c.lower() not in [n.lower() for n in new]])
    if text_col.lower() in [n.lower() for n in new]:
        raise ValueError(f"{text_col} is the name of a new column; pass a prefix")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x centroids x SIZE
    at = docs.columns.index(text_col)
    names = [*docs.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):  # bounds what a worker holds twice
                found = shared.value.predict(batch.column(at).to_pylist())
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}rejected` boolean")


def language_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged.

    Null texts, empty ones and those without a letter go, and all go if no row is labelled.  Repeated
    rows stay or go together.  The model is fitted on the labelled rows of ``docs`` themselves.
    """
    p = free_prefix(docs.columns, "_langid_")
    return predict(docs, fit(docs), prefix=p).where(~F.col(f"{p}rejected")).select(*docs.columns)


def op4_query(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
