"""Near duplicates by circulant MinHash, banding, exact Jaccard verification and components.

Shingles are five consecutive words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), a text with fewer words being
one shingle; they are compared by 64-bit hashes. Two texts are linked if their sets have a Jaccard
similarity of at least ``percent`` / 100.

Circulant MinHash: the shingle hash's upper half is a first permutation's value in 2**32 places. A second
permutation P is used for all coordinates, shifted circularly: coordinate k is the least P(x + k * SHIFT)
over a set's x. ROWS coordinates make a band.

1. Each text gives its set's size and 128-bit digest, and its bands. Equal digests are one class, named by
   its least doc_id: a thousand copies are one set from here on.
2. Band values that at least two classes hold are buckets. In a bucket the class with the least hash leads;
   its pairs with all others are verified on full sets (a join, a leader's members dealt out with copies of
   the leader's set, so that no task gathers a bucket), and components of the links are found.
3. A bucket whose classes are all in one component needs nothing more: the copies and variants of a
   text are not paired with one another. Only in buckets with several components the strays meet more of
   the others, eight times as many in each round, until each pair of a bucket is verified or within a
   component. So no link of a bucket is lost. Before that, shingles that one class alone has are counted:
   a class of which over 100 - ``percent`` in 100 are its own is linked with none, and two classes
   that share too little with any others are not paired.

LSH sees a pair in at least one of BANDS bands with probability 1 - (1 - J ** ROWS) ** BANDS: for J = 0.85
all but 1e-8, for J = 0.8 all but 3e-6.

Nulls and edges: a null, empty or blank text has an empty set, is linked with nothing and kept. A row
without doc_id is linked with nothing and has no component. Repeated rows (same doc_id and text) share
their component; rows of one doc_id with different texts are one document with the links of all its texts.
Further columns pass through ``dedup_documents``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import as_long, gram_hashes, mix, pieces, read, span_hashes, table, text_bytes, word_spans

WORDS, ROWS, BANDS = 5, 5, 32
SHIFT = 0x9E3779B1
#: Members that are verified beside one copy of their leader's set.
BESIDE = 256
#: Links whose components one task finds; a size that is checked.
ONE_TASK = 500_000
_WEIGHTS = np.random.default_rng(5).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    grams = gram_hashes(words, n)
    sets = []
    for low, high in zip(at.tolist(), at[1:].tolist()):
        if high - low >= n:
            sets.append(np.unique(grams[low : high - n + 1]))
        elif high > low:  # the whole sequence; its length sets it apart from shingles
            sets.append(gram_hashes(words[low:high], high - low) ^ np.uint64(0xA5A5A5A5 + high - low))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _permute(x: np.ndarray, tmp: np.ndarray) -> None:
    """In place, a fixed permutation of the 32-bit integers (the finaliser of murmur3)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(sets: list[np.ndarray], n: int = ROWS * BANDS) -> np.ndarray:
    """(n, len(sets)) coordinates; the sets must not be empty."""
    out = np.empty((n, len(sets)), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    low = 0
    while low < len(sets):
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), 16_384, side="right")))
        x = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[low:high]) - sizes[low:high]
        y, tmp = np.empty_like(x), np.empty_like(x)
        for k in range(n):
            np.add(x, np.uint32(k * SHIFT % 2**32), out=y)
            _permute(y, tmp)
            out[k, low:high] = np.minimum.reduceat(y, starts)
        low = high
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS) 64-bit values; the band's number is part of the value."""
    parts = signatures(sets).reshape(BANDS, ROWS, len(sets)).astype(np.uint64)
    total = (parts * _WEIGHTS[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return mix(total).T


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The halves of each set's 128-bit digest; null for an empty set."""
    found = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
    half = lambda shift: pa.array([None if x is None else (x >> shift & 2**64 - 1) - 2**63 for x in found], pa.int64())
    return half(64), half(0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=1 << 20):
        sets = shingle_sets(batch.column("text"))
        full = [i for i, s in enumerate(sets) if len(s)]
        found: list = [None] * len(sets)
        if full:
            for i, row in zip(full, as_long(bands([sets[i] for i in full]))):
                found[i] = row
        k1, k2 = _digests(sets)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "k1": k1,
            "k2": k2,
            "bands": pa.array(found, pa.list_(pa.int64())),
        })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=1 << 20):
        sets = shingle_sets(batch.column("text"))
        k1, k2 = _digests(sets)
        yield pa.RecordBatch.from_pydict({"rep": batch.column("doc_id"), "k1": k1, "k2": k2, "members": pa.array([s.tobytes() for s in sets], pa.binary())})


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a stream sorted by (a, part, b), in which each leader's own set (b null) comes first."""
        leader, own, led = None, [], True
        for batch in batches:
            left, right = [], []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members")):
                now = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    own = [now] if led or a != leader else [*own, now]  # one doc_id can have several texts
                    leader, led = a, False
                    continue
                led = True
                for mine in own if a == leader else ():
                    both = len(mine) + len(now)
                    same = len(np.intersect1d(mine, now, assume_unique=True))
                    if 100 * same >= percent * (both - same):
                        left.append(a), right.append(b)
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each b brings its set once a leader; a leader's
    set is copied for every BESIDE of its members."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BESIDE).cast("int").alias("parts"))
    spread = pairs.join(parts.hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    members = spread.join(sets.withColumnRenamed("rep", "b").hint("merge"), "b").select("a", "part", "b", "members")
    leaders = parts.join(sets.withColumnRenamed("rep", "a").hint("merge"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = leaders.select("a", "part", F.lit(None).cast("long").alias("b"), "members").unionByName(members)
    both = both.withColumn("key", F.xxhash64("a", "part")).repartition("key").sortWithinPartitions("key", "a", "part", F.col("b").asc_nulls_first())
    return both.select("a", "b", "members").mapInArrow(_verify(percent), "a long, b long")


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of a graph that one task holds."""
    found = list(batches)
    ends = [np.concatenate([b.column(c).to_numpy() for b in found] or [np.zeros(0, np.int64)]) for c in ("a", "b")]
    vertices, index = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = np.split(index, 2)
    label = np.arange(len(vertices))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_pydict({"v": vertices.astype(np.int64), "label": vertices[label].astype(np.int64)})


def components(links: DataFrame) -> DataFrame:
    """(v, label) of all vertices of ``links`` (a, b): label is the least vertex that v reaches. Up to
    ONE_TASK links (8 MB) are one task's work. More are labelled by joins: labels take the least label of their
    neighbours and then the label of their label, until none changes."""
    if links.count() <= ONE_TASK:
        return table(links.select("a", "b").coalesce(1).mapInArrow(_small_components, "v long, label long"))
    links = table(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")))
    labels = table(links.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "v"))
    while True:
        near = links.join(labels.hint("merge"), links.y == labels.v).groupBy("x").agg(F.min("label").alias("least"))
        moved = labels.join(near.hint("merge"), labels.v == near.x, "left").select("v", "label", F.least("label", "least").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("further"))
        after = table(moved.join(jump.hint("merge"), "to", "left").select("v", F.least("to", "further").alias("to"), "label"))
        changed = after.where(F.col("to") != F.col("label")).limit(1).count()
        labels = after.select("v", F.col("to").alias("label"))
        if not changed:
            return labels


def _rank(column: Column) -> Column:
    """A number from 0 to 1 that the class has in every bucket."""
    return F.pmod(F.xxhash64(column, F.lit("rank")), F.lit(2**40)) / F.lit(2.0**40)


def _opened(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets whose classes are in several components, each with its component (label), the
    bucket's least rank (first) and that one's component (home)."""
    now = buckets.join(labels.hint("merge"), buckets.rep == labels.v, "left").withColumn("label", F.coalesce("label", "rep")).drop("v")
    open_ = now.groupBy("key").agg(F.min(F.struct("u", "rep", "label")).alias("least"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return now.join(open_.select("key", F.col("least.rep").alias("first"), F.col("least.label").alias("home")).hint("merge"), "key")


def link_classes(classes: DataFrame, sets: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """(v, label) of the linked classes. ``buckets`` (key, rep, n, u, size): a row for each class in a bucket,
    u its rank and size the bucket's. First each bucket's least rank, its leader, is paired with all others.
    Later only strays are paired, the classes outside the component of the least rank that the bound by shared
    shingles left (the leader itself or, where it is gone, one that has met nobody yet): with the classes
    whose rank is within the next ``lead`` places or so, until every stray has met every class of its bucket
    or both are in one component. A round thus makes no more than ``lead`` pairs a stray, and a pair is made in
    the first bucket that both are in."""
    order = buckets.groupBy("key").agg(F.min(F.struct("u", "rep", "n")).alias("first"))
    met = buckets.join(order.hint("merge"), "key").where(F.col("rep") != F.col("first.rep"))
    met = met.where(F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent)
    links = table(verified(table(_ordered(met.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")))), sets, percent))
    labels = components(links)
    now = table(_opened(buckets, labels).drop("label", "home").withColumnRenamed("first", "leader"))
    if not now.limit(1).count():
        return labels
    shared = shared_sizes(sets.join(now.select("rep").distinct().hint("merge"), "rep", "left_semi"))
    now = now.join(shared.hint("merge"), "rep").where(F.col("shared") * 100 >= F.col("n") * percent)
    buckets = table(now.join(classes.select("rep", "bands").groupBy("rep").agg(F.first("bands").alias("bands")).hint("merge"), "rep"))
    before, lead = 0, 8
    while True:
        now = table(_opened(buckets.where(F.col("size") > before), labels))
        if not now.limit(1).count():
            return labels
        window = (F.col("u") * F.col("size") >= before) & ((F.col("u") * F.col("size") < lead) | (F.lit(lead) >= F.col("size")))
        strays = now.where("label <> home").select("key", F.struct("rep", "n", "u", "shared", "label", "bands").alias("s"))
        others = now.where(window & (F.col("rep") != F.col("leader"))).select("key", (F.col("label") != F.col("home")).alias("stray"), F.struct("rep", "n", "u", "shared", "label", "bands").alias("o"))
        both = F.least("s.shared", "o.shared")  # of what the two can have in common
        fits = (F.col("s.label") != F.col("o.label")) & (both * 100 >= (F.col("s.n") + F.col("o.n") - both) * percent)
        fits = fits & (~F.col("stray") | (F.struct("o.u", "o.rep") < F.struct("s.u", "s.rep"))) & (F.array_min(F.array_intersect("s.bands", "o.bands")) == F.col("key"))
        pairs = table(_ordered(strays.join(others.hint("merge"), "key").where(fits).select(F.col("s.rep").alias("a"), F.col("o.rep").alias("b"))))
        new = table(verified(pairs, sets, percent))
        if new.limit(1).count():
            links = links.unionByName(new)
            labels = components(links)
        before, lead = lead, lead * 8


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            some = batch.slice(a, 64)
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("members")]
            rep = np.repeat(some.column("rep").to_numpy(), [len(x) for x in parts])
            yield pa.RecordBatch.from_pydict({"rep": rep, "shingle": np.concatenate(parts)})


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(rep, shared): how many of a class's shingles another class of ``sets`` has as well. No other class
    can have more in common with it, whatever the bands say."""
    counts = sets.mapInArrow(_exploded, "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    own = counts.where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    sizes = sets.select("rep", (F.octet_length("members") / 8).cast("long").alias("n")).groupBy("rep").agg(F.max("n").alias("n"))
    return sizes.join(own.hint("merge"), "rep", "left").select("rep", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller class first: neighbours of a text mostly have the same leader."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the least doc_id that links
    reach) and kept (whether that is the row's own)."""
    docs = docs.select("doc_id", "text")
    features = table(docs.mapInArrow(_features, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    classes = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = table(classes)
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = table(rows.join(sizes.hint("merge"), "key").withColumn("u", _rank(F.col("rep"))))
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "rep long, k1 long, k2 long, members binary")
    sets = table(texts.join(classes.select("rep", "k1", "k2").hint("merge"), ["rep", "k1", "k2"], "left_semi").dropDuplicates(["rep", "k1", "k2"]).select("rep", "members"))
    labels = link_classes(classes, sets, buckets, percent)
    named = classes.join(labels.hint("merge"), classes.rep == labels.v, "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "k1", "k2").join(named.hint("merge"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def dedup_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller doc_id; same columns. Of rows with one
    doc_id one stays; rows without doc_id stay."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    out = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
    return out


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 85)


#: All pairs by their common shingles; for small tables. doc_id is taken to be a key.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
     n AS (SELECT d.doc_id, count(shingle) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
     pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
     reach(v, from_) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.from_ FROM reach r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) e ON e.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT v, min(from_) AS component_id FROM reach GROUP BY v) c ON c.v = n.doc_id
"""
