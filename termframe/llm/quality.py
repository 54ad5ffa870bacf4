"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of terms hashed to columns. WORDS columns have its words and the three-letter beginnings and
ends of them (A-Z lower-cased). TERMS columns have its form: four characters in a row by kind (lower, upper, digit,
space, line end, above 127, each ASCII sign by itself), whether words repeat the word before or one
shortly before, kinds of words, the share of repeated words and the length of the text in steps. Counts are damped,
words are scaled by LEXICAL, all are weighted by inverse document frequency and normalised. A truncated singular value decomposition of a bounded sample of
labelled rows gives the latent space; the sample's own vectors (at most SAMPLE x RANK floats, whatever
the input) are broadcast with it.

Every document's cosines with all labelled vectors are exact matrix products, in blocks of documents. Its
NEAREST labelled neighbours vote with their labels, weighted by a power of their cosine; the score is the
weighted share of label 1.

Nulls and edges: null and empty texts have a vector as well (their length's term), so they get the score
of their neighbours. Rows of labels without doc_id or quality don't train; a doc_id that is repeated in
labels trains once, with its least label. Without training rows every score is 0.5. Ties among neighbours
go to the first in the sample, which is ordered by doc_id. Repeats and order of documents don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import free_name, mix, pieces, read, span_hashes, text_bytes, word_spans

#: Labelled rows that are fitted at most (about that many, chosen by a hash of doc_id), and the model's shape.
SAMPLE, TERMS, WORDS, RANK, NEAREST, POWER = 3000, 2048, 1024, 48, 25, 8
#: Scale of the words' part beside the form's.
LEXICAL = 0.35
#: Predicted as 1 from this score.
THRESHOLD = 0.3

_KIND = np.full(256, 6, np.uint64)
_KIND[:128] = np.arange(8, 136)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[32], _KIND[10], _KIND[[9, 11, 12, 13]] = 4, 5, 7


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(TERMS)).astype(np.int64)


def counts(texts: pa.Array) -> np.ndarray:
    """(len(texts), TERMS + WORDS) damped counts, by document normalised to a sum that doesn't grow with length."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    total = np.zeros(n * TERMS)

    def add(rows: np.ndarray, columns: np.ndarray) -> None:
        nonlocal total
        total += np.bincount(rows * TERMS + columns, minlength=n * TERMS)

    if len(data) > 3:
        gram = kind[:-3] << np.uint64(24) | kind[1:-2] << np.uint64(16) | kind[2:-1] << np.uint64(8) | kind[3:]
        whole = row[3:] == row[:-3]
        add(row[3:][whole], _hashed(gram, 1)[whole])
    starts, ends = word_spans(data, offsets)
    repeats = np.zeros(n)
    lexical = np.zeros(n * WORDS)
    if len(starts):
        some = np.minimum(starts + 3, ends), np.maximum(ends - 3, starts)
        for salt, a, b in ((6, starts, ends), (7, starts, some[0]), (8, some[1], ends)):
            lexical += np.bincount(row[starts] * WORDS + _hashed(span_hashes(data, a, b), salt) % WORDS, minlength=n * WORDS)
        words, of = span_hashes(data, starts, ends), row[starts]
        for back in (1, 2, 3, 5):
            if len(words) > back:
                here = of[back:][of[back:] == of[:-back]]  # pairs of words within a text
                same = (words[back:] == words[:-back])[of[back:] == of[:-back]]
                add(here, _hashed(same.astype(np.uint64), 10 + back))
                if back == 1:
                    repeats = np.bincount(here[same], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))
        shape = kind[starts] << np.uint64(16) | kind[ends - 1] << np.uint64(8) | np.minimum(ends - starts, 20).astype(np.uint64)
        add(of, _hashed(shape, 3))
    x = total.reshape(n, TERMS)
    size = np.diff(offsets)
    x = np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))
    bucket = np.floor(np.log2(size + 1)).astype(np.int64)
    np.add.at(x, (np.arange(n), _hashed(bucket.astype(np.uint64), 4)), 0.3)
    np.add.at(x, (np.arange(n), _hashed(np.ceil(repeats * 8).astype(np.uint64), 5)), 0.4)
    y = lexical.reshape(n, WORDS)
    y = LEXICAL * np.sqrt(y / np.maximum(1, y.sum(axis=1, keepdims=True)))
    return np.concatenate((x, y), axis=1).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # (TERMS + WORDS, RANK): inverse document frequency and projection
    idf: np.ndarray
    vectors: np.ndarray  # labelled rows in the latent space, normalised
    labels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Model:
        """By randomised subspace iteration with a fixed seed; ``x`` is weighted in place."""
        idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rank = min(RANK, *x.shape)
        q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
        for _ in range(6):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
        weights = (q @ turn[:rank].T).astype(np.float32)
        return cls(weights, idf, _unit(x @ weights), labels.astype(np.float32))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = _unit(_unit(counts(texts) * self.idf) @ self.weights) @ self.vectors.T
        k = min(NEAREST, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
        weight = np.maximum(np.take_along_axis(near, best, 1), 1e-3).astype(np.float64) ** POWER
        return np.clip((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most 256 rows, so that a block of counts has a few megabytes."""
    for batch in pieces(batches):
        for low in range(0, batch.num_rows, 256):
            yield batch.slice(low, 256)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        found = [x.astype(np.float32).tobytes() for x in counts(batch.column("text"))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array(found, pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality). The labelled ids are counted, about
    ``sample`` of them are chosen by a hash and broadcast (a size bound by that parameter) to find their texts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.mapInArrow(_vectors, "doc_id long, quality double, x binary").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    if not len(order):
        return Model(*[np.zeros(0, np.float32)] * 4)
    x = np.empty((len(order), TERMS + WORDS), np.float32)
    found = rows.column("x")
    for i, j in enumerate(order.tolist()):
        x[i] = np.frombuffer(found[j].as_buffer(), np.float32)
    return Model.fit(x, rows.column("quality").to_numpy()[order])


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...) with their score, which replaces a column of that ``name``."""
    keep = [c for c in keep if c.lower() != name.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = shared.value.scores(batch.column("text")).astype(np.float64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {name: pa.array(found)})

    docs = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.mapInArrow(run, schema + f"`{name}` double")


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``; same columns."""
    name = free_name(docs, "_score")
    return score(docs, model, docs.columns, name).where(F.col(name) >= threshold).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(fold(5) != 0))
    out = score(docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
