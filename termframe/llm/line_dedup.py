"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of frequent lines.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased. A key of
at least ``min_chars`` code points that ``min_docs`` documents hold loses its lines everywhere but in
the largest doc_id that holds it. Keys are compared by 128-bit hashes.

1. Every document emits the distinct hashes of its keys; they are written once (24 bytes a key).
2. Counting is one aggregation with map-side partial sums, so that a line that all documents share is
   a row a task. Keys below ``min_docs`` go.
3. What is left goes to shards by hash. Each shard becomes one row: a minimal perfect hash of levels
   of bits (a key sits in the first level where it is alone; its index is the number of bits set before
   its own) and, by that index, arrays of fingerprints, counts and keepers.
   Keys that agree in the half of the hash that the index is built on are kept in a short list beside it.
4. Probes (doc_id, hash) go to the shard's arrays, not to lines. Each shard is laid beside its probes in
   one sorted stream; a shard with many probes is laid beside each of several salted parts of them, as many
   as its own probes need.
5. Hits return to the documents as one array a document, and the texts are rewritten.

Nulls and edges: a null or empty text is one empty line. A row without doc_id keeps all its lines and is
not counted. Repeated rows count one by one; rows that share the largest doc_id all keep the line. Further
columns of the input pass through ``dedup_lines``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import SPACES, free_name, mix, pieces, read, table

#: Keys in one shard of the index, on average: about 100 KB of arrays. With more than MOST_SHARDS of them shards are
#: larger instead, so that the numbers of their parts (8 bytes a shard) can be broadcast.
SHARD_KEYS, MOST_SHARDS = 4_000, 200_000
#: Probes that one copy of a shard serves, on average.
PROBES = 10_000


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes.lower() changes A-Z only


def _hash(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - 2**63, (x & 2**64 - 1) - 2**63


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _document_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, one, two = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc_id is None or not text:
                    continue
                keys = {k for x in text.encode().split(b"\n") if _long_enough(k := line_key(x), min_chars)}
                for a, b in map(_hash, keys):
                    ids.append(doc_id), one.append(a), two.append(b)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(one, pa.int64()), "f": pa.array(two, pa.int64())})

    return run


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, each for the keys that collided
    in those before; what is left after the last level is kept as a sorted list."""

    GAMMA, LEVELS = 1.5, 24

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.placed = int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys.astype(np.uint64)
        while len(left) and len(sizes) < cls.LEVELS:
            n = 64 * (int(cls.GAMMA * len(left)) // 64 + 1)
            at = cls._place(left, len(sizes), n)
            alone = np.bincount(at, minlength=n) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(n)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([*parts, np.zeros(0, np.uint64)]), np.sort(left))

    @staticmethod
    def _place(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(n)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for a key outside the set any index, or -1."""
        keys = keys.astype(np.uint64)
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes.tolist()):
            at = self._place(keys[open_], level, n) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, start = open_[~hit], start + n
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out


_BLOBS = ("sizes", "words", "rest", "prints", "counts", "keepers", "others")
_SHARD = "shard int, n_probes long, " + ", ".join(f"{b} binary" for b in _BLOBS)


def _build_shard(rows: pa.Table) -> pa.Table:
    h, f, n, keeper = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "f", "n", "keeper"))
    probes = int(n.sum())
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    others = np.stack((h[~first], f[~first], keeper[~first]), axis=1)  # keys whose h another one has
    h, f, n, keeper = h[first], f[first], n[first], keeper[first]
    found = PerfectHash.build(h.view(np.uint64))
    at = found.index(h.view(np.uint64))
    by = {"prints": f, "counts": np.minimum(n, 2**31 - 1).astype(np.int32), "keepers": keeper}
    for name, values in by.items():
        by[name] = np.empty_like(values)
        by[name][at] = values
    blobs = {"sizes": found.sizes, "words": found.words, "rest": found.rest, "others": others} | by
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n_probes": pa.array([probes], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})


def line_index(keys: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """One row a shard over the keys of at least ``min_docs`` rows of ``keys``, and the number of shards."""
    counts = keys.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    counts = table(counts)
    shards = min(MOST_SHARDS, max(1, -(-counts.count() // SHARD_KEYS)))
    counts = counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return table(counts.groupBy("shard").applyInArrow(_build_shard, _SHARD)), shards


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by (part, kind): a shard's arrays, then its probes. Yields the lines to drop."""
    now = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for low, high in _runs(kinds):
            part = batch.slice(low, high - low)
            if kinds[low] == 0:
                row = part.slice(len(part) - 1).to_pylist()[0]
                get = lambda name, kind: np.frombuffer(row[name], kind)
                now = PerfectHash(get("sizes", np.int64), get("words", np.uint64), get("rest", np.uint64)), get("prints", np.int64), get("counts", np.int32), get("keepers", np.int64), row["shard"], {(a, b): c for a, b, c in get("others", np.int64).reshape(-1, 3).tolist()}
                continue
            if now is None:
                continue  # no shard lies before these probes
            found, prints, counts, keepers, shard, others = now
            doc, h, f = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h", "f"))
            at = found.index(h.view(np.uint64))
            safe = np.maximum(at, 0)
            here = part.column("shard").to_numpy() == shard
            drop = here & (at >= 0) & (prints[safe] == f) & (counts[safe] > 0) & (keepers[safe] != doc)
            if others:
                drop |= here & np.array([others.get((a, b), d) != d for a, b, d in zip(h.tolist(), f.tolist(), doc.tolist())])
            yield pa.RecordBatch.from_pydict({"doc_id": doc[drop], "h": h[drop], "f": f[drop]})


def _runs(kinds: np.ndarray) -> list[tuple[int, int]]:
    """Slices of equal kind; each row of kind 0 by itself, as every shard replaces the one before it."""
    cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)) + 1
    edges = [0, *cuts.tolist(), len(kinds)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def probe_lines(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, h, f) of all lines that a document loses."""
    # a shard has its part of all keys, and those of its own lines
    usual = keys.count() // shards
    salts = (1 + F.floor((F.col("n_probes") + usual) / PROBES)).cast("int").alias("salts")
    blobs = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n_probes").withColumn("kind", F.lit(0))
    probes = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).join(F.broadcast(index.select("shard", salts)), "shard")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts").withColumn("kind", F.lit(1))
    both = blobs.unionByName(probes, allowMissingColumns=True)
    both = both.withColumn("part", F.xxhash64("shard", "salt"))
    both = both.repartition("part").sortWithinPartitions("part", "kind").select("shard", "kind", "doc_id", "h", "f", *_BLOBS)
    return both.mapInArrow(_probe, "doc_id long, h long, f long")


def _rewrite(min_chars: int, digest: bool, lost_lines: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, n, lost = [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column(lost_lines).to_pylist()):
                lines = (text or "").encode().split(b"\n")
                stay = lines
                if drops:
                    gone = {(x["h"], x["f"]) for x in drops}
                    stay = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in gone)]
                n.append(len(lines)), lost.append(len(lines) - len(stay))
                new = b"\n".join(stay)
                kept.append(hashlib.sha256(new).hexdigest() if digest else None if text is None else new.decode())
            out = {name: batch.column(name) for name in batch.schema.names if name not in (lost_lines, "text")} if not digest else {"doc_id": batch.column("doc_id")}
            out |= {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(lost, pa.int64())} if digest else {}
            out["kept_sha256" if digest else "text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _with_drops(docs: DataFrame, name: str, min_chars: int, min_docs: int) -> DataFrame:
    """``docs`` with the lines that each loses in a column of that name."""
    keys = table(docs.select("doc_id", "text").mapInArrow(_document_keys(min_chars), "doc_id long, h long, f long"))
    index, shards = line_index(keys, min_docs)
    drops = probe_lines(keys, index, shards).groupBy("doc_id").agg(F.collect_set(F.struct("h", "f")).alias(name))
    return docs.join(drops, "doc_id", "left")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the repeated lines taken out of ``text``; same columns and rows."""
    names, drops = docs.columns, free_name(docs, "_drops")
    out = _with_drops(docs, drops, min_chars, min_docs).select(*[c for c in names if c != "text"], "text", drops)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in ("text", drops)) + ", text string"
    return out.mapInArrow(_rewrite(min_chars, False, drops), schema).select(*names)


def line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the text that is left."""
    out = _with_drops(docs.select("doc_id", "text"), "_drops", min_chars, min_docs).select("doc_id", "text", "_drops")
    return out.mapInArrow(_rewrite(min_chars, True, "_drops"), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(read(spark, sf_dir, "documents"))


SQL = """
WITH l AS (SELECT doc_id, i, line,
                  translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
     f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
