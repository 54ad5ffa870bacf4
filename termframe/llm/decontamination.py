"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts and items are lower-cased words of letters, digits and characters above 127; an item of n words is
found where a passage is within ``allowed(n)`` word edits of it (RATE * n; exact below SHORT words).

Windows: if an item of n words is cut into allowed + 1 parts, one of them stands unchanged in any such passage, so
windows of n words are looked at only where some item's part (its first words, at most SEED) puts them. That is a
necessary condition and says where an item could be, not which.

CGK embedding: a random walk reads a window; at step t it writes the word it stands on and goes on by a
random bit of (t, word), for STEPS times the window's words, so that it hardly reaches the window's end. Walks
over two texts with the same bits fall into step again after an edit, so edit distance becomes Hamming
distance. Bit sampling: each of REPEATS walks keeps SAMPLED of the written words, whose hash is a key. The items of n words have
their keys in one sorted table; a window's candidates are the items that share a key with it. Their exact
distance (item against all substrings of the window and its margin) decides.

Recall of the keys, at the most edits allowed and on random words, is measured by a test: 0.98 or more for items of 8 to 60
words; it is higher for fewer edits, and 1 for passages without edits.

Each task works on its own documents; the items are broadcast in blocks of at most ITEMS, one pass a block.

Nulls and edges: a null text is empty and contains nothing. Items that are null, without words or without
item_id are left out; repeated items are reported once each item_id. Repeated rows of documents each have
their hits. Further columns pass through ``drop_contaminated``. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import gram_hashes, mix, pieces, read, span_hashes, text_bytes, word_spans

RATE, SHORT, SEED = 0.2, 8, 4
REPEATS, SAMPLED, STEPS, ITEMS = 128, 3, 1.5, 20_000
#: Windows that are walked at once.
AT_ONCE = 512
_FILTER_BITS = 22

_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True


def allowed(n: int) -> int:
    return int(RATE * n) if n >= SHORT else 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the n + 1 offsets of the texts."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    starts, ends = word_spans(data, offsets, _WORDY)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def walk(windows: np.ndarray, n: int) -> np.ndarray:
    """(windows, REPEATS) keys: hashes of the sampled words of each walk over each row of ``windows``."""
    steps = max(1, int(STEPS * n))
    chosen = np.sort(np.random.default_rng([n, 11]).integers(0, steps, (REPEATS, SAMPLED)), axis=1)
    padded = np.concatenate((windows, np.full((len(windows), steps), 3, np.uint64)), axis=1)
    rows = np.arange(len(windows))[:, None]
    place = np.zeros((len(windows), REPEATS), np.int64)
    out = np.tile(np.arange(1, REPEATS + 1, dtype=np.uint64), (len(windows), 1))
    for t in range(int(chosen.max()) + 1):
        word = padded[rows, place]
        for j in range(SAMPLED):
            at = np.flatnonzero(chosen[:, j] == t)
            if len(at):
                out[:, at] = mix(out[:, at] + word[:, at] + np.uint64(j + 1))
        bits = mix(word + _walk_seed(t))
        place += (bits & np.uint64(1)).astype(np.int64)
    return out


_SEEDS = np.random.default_rng(13).integers(0, 2**63, (1 << 12, REPEATS), dtype=np.uint64)


def _walk_seed(t: int) -> np.ndarray:
    return _SEEDS[t % len(_SEEDS)] + np.uint64(t)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between ``item`` and a substring of ``text``, and where that substring ends."""
    steps = np.arange(len(item) + 1)
    row = steps.copy()
    best, at = len(item), 0
    for i, word in enumerate(text.tolist()):
        new = np.minimum(row + 1, np.concatenate(([0], row[:-1] + (item != word))))
        new[0] = 0
        row = np.minimum.accumulate(new - steps) + steps
        if row[-1] < best:
            best, at = int(row[-1]), i + 1
    return best, at


class Items:
    """Items ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, at = words_of(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(at, at[1:])]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seeds: dict[int, set[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            if not len(w):
                continue
            parts = allowed(len(w)) + 1
            size = len(w) // parts
            q = min(SEED, size)
            for p in range(parts):
                seeds.setdefault(q, set()).add((int(gram_hashes(w[p * size : p * size + q], q)[0]), len(w), p * size))
        self.seeds = {}
        for q, rows in ((q, sorted(x)) for q, x in seeds.items()):
            keys = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.seeds[q] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), bits

    def placed(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (number of words, text, first word) of the windows that items' parts put in place, in order."""
        found = []
        for q, (keys, lengths, offsets, bits) in self.seeds.items():
            grams = gram_hashes(words, q)
            maybe = np.flatnonzero(bits[grams & np.uint64((1 << _FILTER_BITS) - 1)])
            text = np.searchsorted(at, maybe, side="right") - 1
            inside = maybe + q <= at[text + 1]
            maybe, text = maybe[inside], text[inside]
            low, high = np.searchsorted(keys, grams[maybe], "left"), np.searchsorted(keys, grams[maybe], "right")
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack((lengths[which], np.repeat(text, n), np.repeat(maybe, n) - offsets[which]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of the items of ``n`` words, and the item of each."""
        if n not in self.tables:
            items = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            keys = walk(np.stack([self.words[i] for i in items]), n).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], np.repeat(items, REPEATS)[order]
        return self.tables[n]

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, word after the passage) of all passages; of an item in a text, the best."""
        words, at = words_of(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        places = self.placed(words, at)
        cuts = [0, *(np.flatnonzero(np.diff(places[:, 0])) + 1).tolist(), len(places)]
        for low, high in zip(cuts, cuts[1:]):
            for a in range(low, high, AT_ONCE):
                self._look(words, at, places[a : min(high, a + AT_ONCE)], best)
        return [(text, item, *found) for (text, item), found in sorted(best.items())]

    def candidates(self, windows: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(row of ``windows``, item of ``n`` words) that share a key."""
        keys, items = self.table(n)
        own = walk(windows, n)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        pairs = set()
        for row, column in np.argwhere(high > low).tolist():
            pairs.update((row, i) for i in items[low[row, column] : high[row, column]].tolist())
        return sorted(pairs)

    def _look(self, words: np.ndarray, at: np.ndarray, places: np.ndarray, best: dict) -> None:
        if not len(places):
            return
        n = int(places[0, 0])
        most = allowed(n)
        index = places[:, 2:] + np.arange(n)
        inside = (index >= at[places[:, 1]][:, None]) & (index < at[places[:, 1] + 1][:, None])
        windows = np.where(inside, words[np.clip(index, 0, len(words) - 1)], np.uint64(3))
        for row, item in self.candidates(windows, n):
            text, start = places[row, 1:].tolist()
            low, high = max(int(at[text]), start - most), min(int(at[text + 1]), start + n + most)
            edits, end = distance(self.words[item], words[low:high])
            if edits <= most and (edits, low + end) < best.get((text, item), (n, 0)):
                best[text, item] = edits, low + end - int(at[text])


def _item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark, at most about ITEMS items at once."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    blocks = max(1, -(-rows.count() // ITEMS))
    for b in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in found], [r["text"] for r in found])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, n_words, end_word): items found in ``docs`` (doc_id, text), with their number
    of words and the number of the document's words up to the passage's end."""
    out = None
    for items in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                own, rows = shared.value, {}
                ids = batch.column("doc_id").to_pylist()
                for text, item, edits, end in own.hits(batch.column("text")):
                    new = edits, len(own.words[item]), end
                    key = text, own.ids[item]
                    rows[key] = min(rows.get(key, new), new)
                found = [(ids[text], item, *x) for (text, item), x in rows.items()]
                columns = list(zip(*found)) or [[]] * 5
                names = ("doc_id", "item_id", "edits", "n_words", "end_word")
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, columns)})

        new = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, n_words long, end_word long")
        out = new if out is None else out.unionByName(new)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; same columns. No shuffle: each task filters its rows."""
    for items in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[text for text, *_ in shared.value.hits(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
