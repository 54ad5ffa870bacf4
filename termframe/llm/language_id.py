"""Language ID by Bloom filters that are sliced by bits: one lookup says which languages hold an n-gram.

Texts become bytes: A-Z lower-cased, other ASCII but letters taken as one space, bytes above 127 kept. An
n-gram is four such bytes. Training counts n-grams by language over a bounded sample of documents; a language holds an
n-gram if it is, there, at least ``SHARE`` as frequent as in the language where it is most frequent. The filters
are filled where the counts are: what reaches the driver is the slots that have bits. All languages' filters share their hash functions and lie beside each other: slot i has a bit a language (a byte
for up to 8, else as many 64-bit words as they need), so the AND of an n-gram's slots is the set of its languages.

A text's n-grams give a count of each set; language l has the sum of the counts of sets with its bit. A
filter of false-positive rate p says yes for (true + p * (n - true)) of n n-grams, so true is estimated as
(yes - p * n) / (1 - p). The language with the largest estimate wins (the first by name in a tie); the
score is its part of the sum of all estimates. Neither languages nor n-grams are capped.

Nulls and edges: null texts and texts without a letter are ``und`` with score 0. A text with a letter but
no n-gram that any language holds gets the most frequent language of the training rows and the score
1 / languages. Rows whose lang is null or empty don't train. Without training rows everything is ``und``.
Repeats and order of rows don't matter. A row without doc_id is not held out, but doesn't train either. Columns of
the names of the results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import mix, pieces, read, table, text_bytes

#: Documents of a language that training takes at most, by the order of a hash of doc_id; about that many.
TRAIN_DOCS = 3000
#: How frequent an n-gram must be beside its most frequent language, and how often it must be seen at all.
SHARE, LEAST = 0.1, 3
SLOTS, HASHES = 1 << 20, 2

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of all texts, as integers, and the row of each; n-grams don't cross rows and
    have no two spaces in a row."""
    data, offsets = text_bytes(texts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    folded, row = folded[keep].astype(np.uint32), row[keep]
    if len(folded) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    joined = folded[:-3] << 24 | folded[1:-2] << 16 | folded[2:-1] << 8 | folded[3:]
    whole = row[3:] == row[:-3]
    return joined[whole], row[:-3][whole]


def _slots(keys: np.ndarray) -> Iterator[np.ndarray]:
    x = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(HASHES):
        yield (x >> np.uint64(24 * i)).astype(np.int64) & (SLOTS - 1)


@dataclass
class Model:
    languages: list[str]
    usual: int
    slots: np.ndarray  # (SLOTS, words), a bit a language
    rates: np.ndarray  # false positives of each language's filter

    @classmethod
    def of(cls, names: list[str], slots: np.ndarray, documents: dict[str, int]) -> Model:
        own = [np.count_nonzero(slots[:, i // width] & slots.dtype.type(1 << i % width)) / SLOTS for width in (8 * slots.itemsize,) for i in range(len(names))]
        return cls(names, max(range(len(names)), key=lambda i: documents[names[i]], default=0), slots, np.array(own) ** HASHES)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        n_rows, n_lang = len(texts), len(self.languages)
        keys, row = grams(texts)
        sets = np.bitwise_and.reduce([self.slots[at] for at in _slots(keys)]) if len(keys) else np.zeros((0, self.slots.shape[1]), self.slots.dtype)
        yes = np.zeros((n_rows, n_lang))
        total = np.bincount(row, minlength=n_rows).astype(float)
        if self.slots.itemsize == 1:
            table = np.bincount(row * 256 + sets[:, 0], minlength=256 * n_rows).reshape(n_rows, 256)
            bits = (np.arange(256)[:, None] >> np.arange(n_lang)) & 1
            yes = (table @ bits).astype(float)
        else:
            for i in range(n_lang):
                yes[:, i] = np.bincount(row, weights=(sets[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n_rows)
        held = np.maximum(0, (yes - self.rates * total[:, None]) / (1 - self.rates))
        names, scores = [], []
        for i, text in enumerate(texts.to_pylist()):
            if not n_lang or not text or not any(map(str.isalpha, text)):
                names.append("und"), scores.append(0.0)
            elif (whole := held[i].sum()) > 0:
                best = int(held[i].argmax())
                names.append(self.languages[best]), scores.append(float(held[i, best] / whole))
            else:
                names.append(self.languages[self.usual]), scores.append(1 / n_lang)
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of (lang, gram): one row each for a slice of about a chunk."""
    for batch in pieces(batches):
        keys, row = grams(batch.column("text"))
        codes = batch.column("lang").dictionary_encode()
        lang = codes.indices.to_numpy()[row].astype(np.uint64)
        both, n = np.unique(lang << np.uint64(32) | keys, return_counts=True)
        names = codes.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64)))
        yield pa.RecordBatch.from_pydict({"lang": names, "gram": pa.array((both & np.uint64(2**32 - 1)).astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _words(n_languages: int) -> tuple[type, int]:
    """The kind of a slot's words and how many it has."""
    kind = np.uint8 if n_languages <= 8 else np.uint64
    return kind, max(1, -(-n_languages // (8 * kind().itemsize)))


def _fill(n_languages: int):
    kind, words = _words(n_languages)
    width = 8 * kind().itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots and their bits, from n-grams and the numbers of the languages that hold them."""
        for batch in batches:
            held = batch.column("held")
            language = pc.list_flatten(held).to_numpy()
            gram = np.repeat(batch.column("gram").to_numpy(), pc.list_value_length(held).to_numpy())
            for at in _slots(gram.astype(np.uint64)):
                bits = np.left_shift(np.int64(1), (language % width).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"at": at * words + language // width, "bits": bits})

    return run


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """From rows (doc_id, text, lang). The languages are counted first (one row each reaches the driver);
    each then gives about ``train_docs`` documents, chosen by a hash, so that a language with a third of
    all rows costs no more than another. The filters' words that have bits reach the driver, at most SLOTS for
    every 64 languages."""
    spark = docs.sparkSession
    rows = docs.where(F.length("lang") > 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    taken = spark.createDataFrame([(x, int(min(1.0, train_docs / n) * 1_000_000)) for x, n in sizes.items()], "lang string, taken int")
    rows = rows.select("doc_id", "text", "lang").join(F.broadcast(taken), "lang")
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1_000_000)) < F.col("taken"))
    counts = table(sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    kind, words = _words(len(names))
    slots = np.zeros(SLOTS * words, kind)
    if names:
        known = spark.createDataFrame([(i, x, float(totals[x])) for i, x in enumerate(names)], "i int, lang string, total double")
        shares = counts.join(F.broadcast(known), "lang").select("gram", F.struct("i", (F.col("n") / F.col("total")).alias("share")).alias("x"))
        by_gram = shares.groupBy("gram").agg(F.collect_list("x").alias("x"), F.max("x.share").alias("best"))  # a row a language at most
        held = by_gram.select("gram", F.transform(F.filter("x", lambda y: y["share"] >= SHARE * F.col("best")), lambda y: y["i"]).alias("held"))
        got = held.mapInArrow(_fill(len(names)), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64).astype(kind)
    return Model.of(names, slots.reshape(SLOTS, words), sizes)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score, which replace columns of those names; the model (a
    megabyte for up to 8 languages, else 8 MB for every 64) is broadcast."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    docs = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.mapInArrow(run, schema + "lang_pred string, score double")


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(4) != 2))
    return predict(docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))), model, ["doc_id", "held_out"])
