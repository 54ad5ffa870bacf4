"""Exact removal of repeated byte strings by the maximal repeats of an enhanced suffix array.

A byte is removed if a string of LENGTH (400) bytes that covers it also starts anywhere else, in any
document. Matches don't cross documents; strings are judged on the input. Shorter repeats, from LEAST (264) bytes,
come from the same tree and are reported, not removed.

Not all suffixes are sorted, only those at anchors: a position is an anchor if the hash of its GRAM bytes is
the least of some window of LEAST - GRAM + 1 positions. Every string of LEAST bytes holds an anchor with its
gram, and equal strings hold the same one, so each pair of equal strings is found at an anchor; there is one
for some 70 bytes of text.

1. Documents give their anchors: the gram's hash g, and the hash c of the context, the bytes of all strings
   of up to LENGTH that can hold the anchor (180 before, 400 after, as far as the document goes).
2. (g, c) is counted, with map-side partial sums. A context that stands twice is wholly repeated: copies, however
   many, are one row from here on. A gram with one context needs nothing more.
3. The other contexts (one representative each) are sorted by gram and by the text after the anchor: the suffix
   array. In each gram's stretch, longest common prefixes of neighbours are scanned with a stack, which gives
   the tree of common-prefix intervals. An interval whose members agree on R bytes is tested for its left
   extensions: its members, ordered by the text before the anchor, fall into groups that agree on L bytes
   as well; a group that no further byte extends on either side without losing a member is a maximal repeat, with
   all its occurrences. Those of L + R >= LEAST give the spans. An anchor is in as many nested
   intervals as there are depths from GRAM to LENGTH at most, so work grows with the stretch, not its square.
4. A gram with over STRETCH contexts would be an unbounded stretch. Its contexts are hashed instead, exactly: in
   LEVELS cores of the length less STEP - 1 bytes, then, where a core stands twice, the core with these bytes on
   either side (equal: all its strings are repeated), else each of its STEP strings. Only counts are grouped,
   and only hashes are shuffled.
5. The covered intervals return to the documents, are united and cut out.

``n_passages`` counts a document's maximal runs of repeats of LEAST bytes that another document also holds and
that have PASSAGE_WORDS whole words or more. (Of a context that stands several times in one document and in
no other, one occurrence is looked at for that.)

Nulls and edges: a null or empty text has no bytes. Repeated rows are copies of each other like other equal
texts, but one document; doc_id may be null. Texts under LENGTH bytes are kept whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import as_long, mix, pieces, read, table, text_bytes

LENGTH, LEAST, GRAM = 400, 264, 84
WINDOW = LEAST - GRAM + 1
PASSAGE_WORDS = 50
#: Stretches in which each pair is looked at, instead of the tree: small arrays cost more than pairs.
PAIRED = 6
#: Kinds of spans, as bits: of a string of LENGTH bytes that stands elsewhere; of one of LEAST bytes that stands in another document.
REPEATED, SHARED = 1, 2
#: Contexts of a gram that are sorted in one task: about 20 MB of text.
STRETCH = 32_768
STEP = 8
LEVELS = range(0, WINDOW, STEP)
_BYTE = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(2**64 - 1)


def gram_values(data: np.ndarray, length: int | None = None) -> np.ndarray:
    """Hashes of the ``length`` bytes from each position on; the last positions, without as many, have none."""
    length = length or GRAM
    part, n, base = _BYTE[data], 1, _BASE  # hashes of n bytes, and base ** n
    out, done = None, 0
    while True:
        if length & n:  # length is a sum of powers of two; the hash goes on from the bytes done so far
            out = part if out is None else out[: len(part) - done] * np.uint64(base) + part[done:]
            done += n
        if done == length:
            return mix(out)
        part = part[:-n] * np.uint64(base) + part[n:]
        n, base = 2 * n, base * base % 2**64


def _sliding(x: np.ndarray, w: int, f: np.ufunc, rest: np.uint64) -> np.ndarray:
    """f over each w neighbours from a position on, for the first len(x) - w + 1 positions."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, rest, np.uint64))).reshape(-1, w)
    left = f.accumulate(padded, axis=1).ravel()
    right = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of texts laid end to end, and their grams' hashes."""
    if len(data) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = np.minimum(gram_values(data), _TOP - np.uint64(1)) + np.uint64(1)
    least = _sliding(values, WINDOW, np.minimum, _TOP)
    inside = np.zeros(len(least), bool)  # windows that lie in one document
    for low, high in zip(offsets.tolist(), offsets[1:].tolist()):
        if high - low >= LEAST:
            inside[low : high - LEAST + 1] = True
    least[~inside] = 0
    margin = np.zeros(WINDOW - 1, np.uint64)
    most = _sliding(np.concatenate((margin, least, margin)), WINDOW, np.maximum, np.uint64(0))
    at = np.flatnonzero(most == values)
    return at, values[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = text_bytes(batch.column("text"))
        at, grams = anchors(data, offsets)
        row = np.searchsorted(offsets, at, side="right") - 1
        low, high = np.maximum(offsets[row], at - (WINDOW - 1)), np.minimum(offsets[row + 1], at + LENGTH)
        view = memoryview(data.tobytes())
        digest = xxhash.xxh3_64_intdigest
        contexts = [digest(view[a:b], seed) for a, b, seed in zip(low.tolist(), high.tolist(), (at - low).tolist())]
        index = pa.array(row)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(index), "k": batch.column("k").take(index), "pos": pa.array((at - offsets[row]).astype(np.int32)), "tail": pa.array((high - at).astype(np.int32)), "g": as_long(grams), "c": as_long(np.array(contexts, np.uint64))})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: they are shuffled twice, and this halves what Spark's own codec leaves."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches):
        frames = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "k": batch.column("k"), "z": pa.array(frames, pa.binary())})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted anchor: (g, once, many, hot, doc_id, k, pos, before, text)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for a in range(0, batch.num_rows, 32):
            rows = {name: [] for name in ("g", "once", "many", "hot", "doc_id", "k", "pos", "before", "text")}
            for r in batch.slice(a, 32).to_pylist():
                text = unpack.decompress(r["z"])
                for x in r["wanted"]:
                    low = max(0, x["pos"] - (WINDOW - 1))
                    values = x["g"], x["once"], x["many"], x["hot"], r["doc_id"], r["k"], x["pos"], x["pos"] - low, text[low : x["pos"] + LENGTH]
                    for name, value in zip(rows, values):
                        rows[name].append(value)
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_pydict({name: pa.array(v, kind) for (name, v), kind in zip(rows.items(), kinds)})


def agree(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The nodes (depth, first, after the last) of the tree of common-prefix intervals, inner ones first."""
    stack = [(0, 0)]
    for i in range(1, len(prefixes) + 1):
        now, first = prefixes[i] if i < len(prefixes) else 0, i - 1
        while stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i
        if stack[-1][0] < now:
            stack.append((now, first))


class Stretch:
    """The enhanced suffix array of anchors: ``after`` sorted texts from the anchors on, ``before`` the texts before
    them, from the anchor outwards. Both have the common prefixes of neighbours in their own order."""

    def __init__(self, before: list[bytes], after: list[bytes]):
        self.n = len(before)
        self.prefixes = [0, *map(agree, after, after[1:])]
        self.order = np.array(sorted(range(self.n), key=before.__getitem__))
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.order] = np.arange(self.n)
        self.left = np.array([0, *(agree(before[i], before[j]) for i, j in zip(self.order, self.order[1:]))])

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each common-prefix interval, inner ones first: its depth, its members in the order of the texts
        before them, and how many bytes neighbours in that order agree on: a least over the whole order's."""
        for depth, first, end in intervals(self.prefixes):
            ranks = np.sort(self.rank[first:end])
            if end - first == 2:
                yield depth, self.order[ranks], self.left[ranks[0] + 1 : ranks[1] + 1].min(keepdims=True)
            else:
                yield depth, self.order[ranks], np.minimum.reduceat(self.left[: ranks[-1] + 1], ranks[:-1] + 1)

    def maximal_repeats(self, least: int, owners: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[int], list[int]]]:
        """(L, R, members, fresh, shared): all anchors that agree on L bytes before and R bytes after, L + R >= least,
        for each group that a further byte on either side would make smaller. A repeat within others is left
        out if it adds nothing to any member: ``fresh`` are the members that it covers bytes of which no
        repeat before did, ``shared`` those of which no repeat before with several ``owners`` did."""
        most = np.full((2, self.n), -1)
        for depth, members, left in self.nodes():
            longest = np.maximum(np.append(left, -1), np.insert(left, 0, -1))
            new = []
            for reach, value in zip(most, (longest, _with_others(left, longest, owners[members]))):
                fresh = np.flatnonzero((value + depth >= least) & (value > reach[members]))
                reach[members[fresh]] = value[fresh]
                new.append((fresh, value[fresh]))
            for shared in np.unique(np.concatenate([x for _, x in new])).tolist():
                edges = np.concatenate(([0], np.flatnonzero(left < shared) + 1, [len(members)]))  # groups that agree on so much
                places = [fresh[x == shared] for fresh, x in new]
                groups = [np.searchsorted(edges, x, "right") - 1 for x in places]
                for g in np.unique(np.concatenate(groups)).tolist():
                    yield shared, depth, members[edges[g] : edges[g + 1]], *(members[x[y == g]].tolist() for x, y in zip(places, groups))


def _with_others(left: np.ndarray, longest: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """How many bytes each of a row of neighbours, which agree on ``left`` bytes, agrees on with one of another owner
    (-1 if there is none)."""
    same = owners[1:] == owners[:-1]
    if not same.any():
        return longest
    out = longest.copy()
    edges = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(owners)]))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b - a > 1:  # a run of one owner: only what stands before and behind it counts
            before = np.minimum.accumulate(left[a - 1 : b - 1]) if a else np.full(b - a, -1)
            behind = np.minimum.accumulate(left[a:b][::-1])[::-1] if b < len(owners) else np.full(b - a, -1)
            out[a:b] = np.maximum(before, behind)
    return out


_SPAN = "doc_id long, k long, low int, high int, kind int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_pydict({name: pa.array(v, kind) for name, kind, v in zip(("doc_id", "k", "low", "high", "kind"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), columns)})


_AROUND = ("g", "once", "many", "doc_id", "k", "pos", "before", "text")


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by gram: the spans that are repeated. One gram's stretch is held at a time."""
    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*[batch.column(c).to_pylist() for c in _AROUND]):
            if held and held[0][0] != row[0]:
                out += _stretch(held)
                held = []
            held.append(row)
        if out:
            yield _spans(out)
    if held:
        yield _spans(_stretch(held))


def _repeats(before: list[bytes], after: list[bytes], owners: list[int]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(L, R, fresh, shared) of a stretch's maximal repeats; of a small stretch, of each of its pairs."""
    if len(after) > PAIRED:
        for left, right, _, fresh, shared in Stretch(before, after).maximal_repeats(LEAST, np.array(owners)):
            yield left, right, fresh, shared
        return
    prefixes = [agree(*x) for x in zip(after, after[1:])]
    for i, own in enumerate(before):
        right = LENGTH
        for j in range(i + 1, len(before)):
            right = min(right, prefixes[j - 1])
            left = agree(own, before[j])
            if left + right >= LEAST:
                yield left, right, [i, j], [i, j] if owners[i] != owners[j] else []


def _stretch(rows: list[tuple]) -> list[tuple]:
    rows = sorted(rows, key=lambda r: r[7][r[6] :])  # the suffix array of this gram's anchors
    numbers: dict[tuple, int] = {}  # of documents; a context of several documents counts as one of its own
    owners = [numbers.setdefault(r[3:5] if not r[2] else (None, i), len(numbers)) for i, r in enumerate(rows)]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for left, right, fresh, shared in _repeats([r[7][: r[6]][::-1] for r in rows], [r[7][r[6] :] for r in rows], owners):
        # a context that stands twice is covered as a whole already
        for kind, some in ((REPEATED, [i for i in fresh if rows[i][1]] if left + right >= LENGTH else []), (SHARED, shared)):
            for i in some:
                found.setdefault((i, kind), []).append((rows[i][5] - left, rows[i][5] + right))
    return [(*rows[i][3:5], low, high, kind) for (i, kind), spans in found.items() for low, high in _united(sorted(spans))]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


_PLACE = ("g", "once", "many", "doc_id", "k", "pos")


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per context, length (LENGTH, LEAST) and level: hashes of the core and of all that its strings cover, low to high."""
    for batch in batches:
        ids, rows = [], []
        for i, (before, text, pos) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("before", "text", "pos")])):
            for length in (LENGTH, LEAST):
                for l in LEVELS:
                    last = min(l + STEP - 1, WINDOW - 1)  # strings start l to last bytes before the anchor
                    if before < l or len(text) < before + length - last:
                        continue
                    a, b = max(0, before - last), min(len(text), before + length - l)
                    ids.append(i)
                    rows.append((length, l, xxhash.xxh3_64_intdigest(text[before - l : before + length - last], l), xxhash.xxh3_64_intdigest(text[a:b], (before - a) * 1000 + l), pos - before + a, pos - before + b))
        index, found = pa.array(ids, pa.int64()), np.array(rows, np.uint64).reshape(-1, 6)
        small = lambda j: pa.array(found[:, j].view(np.int64).astype(np.int32))
        yield pa.RecordBatch.from_pydict({c: batch.column(c).take(index) for c in _PLACE} | {"length": small(0), "level": small(1), "core": as_long(found[:, 2]), "whole": as_long(found[:, 3]), "low": small(4), "high": small(5)})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each string of the wanted lengths and levels."""
    for batch in batches:
        ids, rows, flags = [], [], []
        for i, (before, text, pos, wanted) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("before", "text", "pos", "wanted")])):
            for x in wanted:
                length, l = x["length"], x["level"]
                for d in range(l, min(l + STEP, WINDOW, before + 1)):
                    if len(text) >= before - d + length:
                        ids.append(i), flags.append((x["once"], x["many"]))
                        rows.append((length, pos - d, xxhash.xxh3_64_intdigest(text[before - d : before - d + length], d)))
        index, found = pa.array(ids, pa.int64()), np.array(rows, np.uint64).reshape(-1, 3)
        small = lambda j: pa.array(found[:, j].view(np.int64).astype(np.int32))
        yield pa.RecordBatch.from_pydict({"g": batch.column("g").take(index), "once": pa.array([a for a, _ in flags], pa.bool_()), "many": pa.array([b for _, b in flags], pa.bool_())} | {c: batch.column(c).take(index) for c in ("doc_id", "k")} | {"length": small(0), "low": small(1), "digest": as_long(found[:, 2])})


def _several() -> Column:
    """Whether rows are of several documents, or of contexts that are."""
    return (F.bool_or("many") | (F.min("k") != F.max("k"))).alias("several")


def hot_spans(contexts: DataFrame) -> DataFrame:
    """The repeated and shared spans of contexts whose gram has too many to sort in one task: by counts of hashes."""
    place = "g long, once boolean, many boolean, doc_id long, k long, "
    cores = table(contexts.mapInArrow(_cores, place + "pos int, length int, level int, core long, whole long, low int, high int"))
    core, repeated = ["g", "length", "level", "core"], F.col("length") == LENGTH
    # of LENGTH bytes whatever stands twice counts, of LEAST bytes what stands in several documents
    counts = table(cores.groupBy(*core, "whole").agg(F.count("*").alias("n"), _several()))
    both = counts.groupBy(*core).agg(F.sum("n").alias("cores"), F.count("*").alias("kinds"), F.bool_or("several").alias("any")).where((F.col("cores") > 1) & (repeated | (F.col("kinds") > 1) | F.col("any")))
    kept = counts.join(both.select(*core).hint("merge"), core)
    settled = F.when(repeated, F.col("n") > 1).otherwise(F.col("several"))
    found = table(cores.join(kept.withColumn("settled", settled).hint("merge"), [*core, "whole"]))
    wanted, kind = F.col("once") | ~repeated, F.when(repeated, REPEATED).otherwise(SHARED).alias("kind")
    whole = found.where(wanted & F.col("settled")).select("doc_id", "k", "low", "high", kind)
    # a core's wholly repeated representatives matter to the others as one
    columns = ["doc_id", "k", "pos", "g", "length", "level", "once", "many"]
    mixed = found.join(both.where("kinds > 1").select(*core).hint("merge"), core, "left_semi")
    single = mixed.where(~F.col("settled")).select(*columns)
    shared = mixed.where("settled").withColumn("once", F.lit(False)).withColumn("many", F.col("several")).dropDuplicates([*core, "whole"]).select(*columns)
    levels = single.unionByName(shared).groupBy("doc_id", "k", "pos", "g").agg(F.collect_list(F.struct("length", "level", "once", "many")).alias("wanted"))
    texts = contexts.select("doc_id", "k", "pos", "g", "before", "text").join(levels.hint("merge"), ["doc_id", "k", "pos", "g"])
    strings = table(texts.mapInArrow(_strings, place + "length int, low int, digest long"))
    twice = strings.groupBy("g", "length", "digest").agg(F.count("*").alias("n"), _several()).where(F.when(repeated, F.col("n") > 1).otherwise(F.col("several"))).select("g", "length", "digest")
    exact = strings.where(wanted).join(twice.hint("merge"), ["g", "length", "digest"], "left_semi").select("doc_id", "k", "low", (F.col("low") + F.col("length")).alias("high"), kind)
    return whole.unionByName(exact)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k, a hash of doc_id and text that tells documents apart: equal rows share it, and are equally cut."""
    return docs.withColumn("k", F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, low, high, kind): repeated and shared spans of ``docs`` (doc_id, k, text), which may overlap."""
    every = table(docs.where(F.octet_length("text") >= LEAST).mapInArrow(_anchor_rows, "doc_id long, k long, pos int, tail int, g long, c long"))
    counted = every.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "pos")).alias("rep"), (F.min("k") != F.max("k")).alias("many"))
    contexts = table(counted.select("g", "c", "n", "many", "rep.*"))
    grams = contexts.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    several = contexts.join(grams.hint("merge"), "g").select("doc_id", "k", F.struct("pos", "g", (F.col("n") == 1).alias("once"), "many", (F.col("m") > STRETCH).alias("hot")).alias("x"))
    wanted = several.groupBy("doc_id", "k").agg(F.collect_list("x").alias("wanted"))
    packed = docs.mapInArrow(_packed, "doc_id long, k long, z binary")
    around = packed.join(wanted.hint("merge"), ["doc_id", "k"]).dropDuplicates(["doc_id", "k"])
    around = around.select("doc_id", "k", "z", "wanted").mapInArrow(_contexts, "g long, once boolean, many boolean, hot boolean, doc_id long, k long, pos int, before int, text binary")
    around = table(around)
    sorted_ = around.where("NOT hot").select(*_AROUND).repartition("g").sortWithinPartitions("g").mapInArrow(_sort_suffixes, _SPAN)
    whole = every.join(contexts.where("n > 1").select("g", "c", "many").hint("merge"), ["g", "c"])
    low = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    end = F.col("pos") + F.col("tail")
    kind = F.when(end - low >= LENGTH, REPEATED).otherwise(0) + F.when(F.col("many"), SHARED).otherwise(0)
    whole = whole.select("doc_id", "k", low.alias("low"), end.alias("high"), kind.alias("kind")).where("kind > 0")
    out = sorted_.unionByName(whole)
    hot = around.where("hot").select(*_AROUND)
    if hot.limit(1).count():
        out = out.unionByName(hot_spans(hot))
    return out


def _words(text: bytes, low: int, high: int) -> int:
    """Whole words from ``low`` to ``high``."""
    within = lambda at: 0 < at < len(text) and text[at - 1 : at + 1].split() == [text[at - 1 : at + 1]]
    return len(text[low:high].split()) - within(low) - within(high)


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                n_bytes, removed, runs, kept, passages = [], [], [], [], []
                for z, spans in zip(some.column("z").to_pylist(), some.column("spans").to_pylist()):
                    text = unpack.decompress(z)
                    cuts, shared = (_united(sorted((x["low"], x["high"]) for x in spans or () if x["kind"] & kind)) for kind in (REPEATED, SHARED))
                    parts, at = [], 0
                    for low, high in cuts:
                        parts.append(text[at:low])
                        at = high
                    parts.append(text[at:])
                    n_bytes.append(len(text)), removed.append(sum(b - a for a, b in cuts)), runs.append(len(cuts))
                    passages.append(sum(_words(text, *x) >= PASSAGE_WORDS for x in shared))
                    kept.append(b"".join(parts))
                out = {"doc_id": pa.array([None if x == -(2**63) else x for x in some.column("doc_id").to_pylist()], pa.int64())}
                if digest:
                    out |= {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "n_passages": pa.array(passages, pa.int64())}
                else:  # a cut may fall within a character; what is left of it goes as well
                    out |= {"text": pa.array([x.decode(errors="ignore") for x in kept], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _with_spans(docs: DataFrame) -> DataFrame:
    docs = keyed(docs.select("doc_id", "text"))
    found = repeated_spans(docs).groupBy("doc_id", "k").agg(F.collect_set(F.struct("low", "high", "kind")).alias("spans"))
    return docs.mapInArrow(_packed, "doc_id long, k long, z binary").join(found.hint("merge"), ["doc_id", "k"], "left").select("doc_id", "z", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without repeated strings of LENGTH bytes."""
    return _with_spans(docs).mapInArrow(_cut(False), "doc_id long, text string")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_passages."""
    return _with_spans(docs).mapInArrow(_cut(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(read(spark, sf_dir, "documents"))
