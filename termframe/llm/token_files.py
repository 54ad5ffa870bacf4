"""Token-ID files: independent zstandard frames, one a document, with a trailing seek table.

A file is a sequence of frames in ascending order of doc_id. Each frame holds one document's ids as
little-endian unsigned 32-bit integers and ends with zstandard's own content checksum. Two skippable
frames follow: the doc_ids (8 bytes each; -2**63 stands for null), and the seek table of the
public seekable format: for each frame its compressed size, its size and the low half of its xxh64,
4 bytes each, then the number of frames, a descriptor and a magic number. A reader takes the last bytes,
then the table, and then only the frames of the documents that it wants.

Documents are range-partitioned by doc_id, so that part files follow one another; each task writes one
file through a filesystem opened from the folder's URI. A file's name holds the task attempt, and only
files named by the rows of a finished job count: retried, speculative or lost tasks leave files that
nothing refers to.

Tokenizing remembers chunks of text that no token crosses: ids of a document are those of its chunks, one
after another.

Nulls and edges: a null or empty text has the end id only. Null doc_ids come first; rows of the same
doc_id follow each other by text. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termframe.llm.common import mix, pieces, powers, read, shared_dir, table, text_bytes

#: Fixed values of the public zstandard formats: skippable frames, seek table's frame, its end, its descriptor with checksums.
IDS_MAGIC, SEEK_MAGIC, END_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NULL_ID = -(2**63)
LEVEL = 1
#: Chunks of text that a worker remembers, and how many of them wait to be sorted in.
REMEMBERED, RECENT = 1_500_000, 50_000
_RANDOM = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)
#: Kinds of bytes: white space to the tokenizer as well, letters, digits, signs; what may belong to either side.
WHITE, LETTER, DIGIT, SIGN, BOUND = range(5)
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[9, 10, 13, 32]] = WHITE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[39] = _KIND[0:9] = _KIND[11:13] = _KIND[14:32] = _KIND[127:] = BOUND
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class ChunkTokenizer:
    """The ids of texts, from the ids of their chunks. A chunk never ends within a token: it ends at white
    space, next to a digit, or where ASCII letters meet ASCII signs; apostrophes and bytes above 127 are
    bound to what is next to them. Letters are lower-cased early, but not before a byte above 127, which
    may be a combining mark. Texts with a special token's string go to the library whole.

    Chunks are looked up by 64-bit hashes, in two sorted arrays (a large one, and a small one for the latest)
    with the places of their ids and bytes: some 40 bytes a chunk. Bytes are compared as well; texts in which two
    chunks of one hash differ go to the library whole."""

    def __init__(self, definition: str):
        self.library = Tokenizer.from_str(definition)
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.ending = np.zeros(self.library.get_vocab_size(), bool)
        for word, i in self.library.get_vocab().items():
            self.ending[i] = word.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.places = [np.zeros(0, np.uint64)] * 2, [none, none]
        self.first, self.sizes, self.ids = none, none, np.zeros(0, np.uint32)
        self.start, self.length, self.bytes = none, none, np.zeros(0, np.uint8)

    def _encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Many chunks that are a word each go in one text; the ids that end a word tell them apart."""
        texts = [x.decode() for x in chunks]
        found: list = [None] * len(texts)
        plain = [i for i, x in enumerate(texts) if x.isalpha() and (x.isascii() or max(x) < "\u0250" and "\u0130" not in x)]
        for low in range(0, len(plain), 1000):
            some = plain[low : low + 1000]
            ids = np.array(self.library.encode(" ".join([texts[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            ends = (np.flatnonzero(self.ending[ids]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):
                for i, a, b in zip(some, [0, *ends], ends):
                    found[i] = ids[a:b]
        other = [i for i, x in enumerate(found) if x is None]
        for low in range(0, len(other), 1000):
            some = other[low : low + 1000]
            for i, x in zip(some, self.library.encode_batch([texts[i] for i in some], add_special_tokens=False)):
                found[i] = np.array(x.ids, np.uint32)
        return found

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        found = self._encode(chunks)
        sizes = np.array([len(x) for x in found], np.int64)
        places = len(self.sizes) + np.arange(len(sizes))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate([self.ids, *found])
        length = np.array([len(x) for x in chunks], np.int64)
        self.start = np.concatenate((self.start, len(self.bytes) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(chunks), np.uint8)))
        level = 0 if len(self.hashes[1]) > RECENT else 1
        some = (self.hashes[0], self.hashes[1], hashes) if level == 0 else (self.hashes[1], hashes)
        at = (self.places[0], self.places[1], places) if level == 0 else (self.places[1], places)
        every, every_at = np.concatenate(some), np.concatenate(at)
        order = np.argsort(every)
        self.hashes[level], self.places[level] = every[order], every_at[order]
        if level == 0:
            self.hashes[1], self.places[1] = self.hashes[1][:0], self.places[1][:0]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for known, places in zip(self.hashes, self.places):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = places[at[hit]]
        return out

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.library.encode(x or "", add_special_tokens=False).ids, np.uint32) for x in texts.to_pylist()]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and the n + 1 offsets of the texts."""
        data, offsets = text_bytes(texts)
        whole = data.tobytes()
        if any(x in whole for x in self.special):
            return self._whole(texts)
        kind = _KIND[data]
        inside = kind != WHITE
        cut = np.ones(len(data) + 1, bool)  # whether a chunk can start here, or end before
        cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & (kind[1:] != BOUND) & (kind[:-1] != BOUND) | ~inside[1:] | ~inside[:-1]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        full = inside[starts] if len(starts) else np.zeros(0, bool)
        starts, ends = starts[full], ends[full]
        lower = _LOWER[data]
        high = np.flatnonzero(data[1:] > 127)
        lower[high] = data[high]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[lower] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        codes = pa.array(hashes).dictionary_encode()
        code, own = codes.indices.to_numpy(), codes.dictionary.to_numpy()
        if len(self.sizes) > REMEMBERED:
            self.clear()
        place = self._find(own)
        at = np.empty(len(own), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        known = np.flatnonzero(place >= 0)
        if not (_equal(lower, starts, ends - starts, lower, starts[at[code]], (ends - starts)[at[code]]) and _equal(lower, starts[at[known]], (ends - starts)[at[known]], self.bytes, self.start[place[known]], self.length[place[known]])):
            return self._whole(texts)
        if len(new := np.flatnonzero(place < 0)):
            raw = lower.tobytes()
            place[new] = len(self.sizes) + np.arange(len(new))
            self._learn(own[new], [raw[starts[i] : ends[i]] for i in at[new].tolist()])
        n = self.sizes[place][code]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.first[place][code] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def _equal(x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether the spans of ``x`` have the bytes of those of ``y``."""
    if not np.array_equal(size, other_size):
        return False
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool((x[np.repeat(at, size) + inside] == y[np.repeat(other, size) + inside]).all())


def skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


class FrameWriter:
    """Writes frames to an open stream; ``close`` adds doc_ids and seek table."""

    def __init__(self, out):
        self.out, self.ids, self.table = out, [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self.out.write(skippable(IDS_MAGIC, np.array(self.ids, "<i8").tobytes()))
        end = len(self.table).to_bytes(4, "little") + bytes([CHECKSUMS]) + END_MAGIC.to_bytes(4, "little")
        self.out.write(skippable(SEEK_MAGIC, np.array(self.table, "<u4").tobytes() + end))


class FrameReader:
    """Reads a file by its seek table; ``documents`` takes all frames or only those of some doc_ids."""

    def __init__(self, source):
        self.source, size = source, source.size()
        end = self._at(size - 9, 9)
        if int.from_bytes(end[5:], "little") != END_MAGIC or end[4] != CHECKSUMS:
            raise ValueError("no seek table")
        n = int.from_bytes(end[:4], "little")
        start = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.ids = np.frombuffer(self._at(start - 8 - 8 * n, 8 * n), "<i8")
        self.starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        raw = self.unpack.decompress(self._at(int(self.starts[i]), int(self.table[i, 0])))
        if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        for i, doc_id in enumerate(self.ids.tolist()):
            if wanted is None or doc_id in wanted:
                yield None if doc_id == NULL_ID else doc_id, self.frame(i)


_made: dict[str, ChunkTokenizer] = {}


def _worker_tokenizer(definition: str) -> ChunkTokenizer:
    """One a worker process, which Spark uses for many tasks."""
    if definition not in _made:
        _made.clear()
        _made[definition] = ChunkTokenizer(definition)
    return _made[definition]


def _write(folder: str, definition: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        where, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        tokenizer, n_docs, n_tokens = _worker_tokenizer(definition), 0, 0
        with where.open_output_stream(path, compression=None) as out:
            writer = FrameWriter(out)
            for batch in pieces(_chain(first, batches)):
                ids, at = tokenizer(batch.column("text"))
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    writer.add(doc_id, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
                n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(ids) + batch.num_rows
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [path.rpartition("/")[2]], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def load_tokenizer(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` (doc_id, text, ...) to ``folder`` (a URI that all executors reach) and returns the
    finished files in order: part, file, n_docs, n_tokens, start (ids in the files before). One row a file,
    so the driver adds up as many numbers as there are files."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path)
    spread = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    job = _write(folder, load_tokenizer(tokenizer_path), end_id)
    done = table(spread.mapInArrow(job, "part int, file string, n_docs long, n_tokens long"))
    rows, start = [], 0
    for r in sorted(done.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], r["file"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return docs.sparkSession.createDataFrame(rows, "part int, file string, n_docs long, n_tokens long, start long")


def _read(folder: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{root}/{row['file']}") as source:
                    found, start, rows = FrameReader(source), row["start"], []
                    wanted = None if row.get("wanted") is None else set(row["wanted"])
                    for doc_id, ids in found.documents(wanted):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), None if digest else ids))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield _rows(rows, digest)
                            rows = []
                    if rows:
                        yield _rows(rows, digest)

    return run


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows)
    if not digest:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(files: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of the files; with ``doc_ids`` only those documents' frames are decompressed."""
    wanted = F.lit(None).cast("array<long>") if doc_ids is None else F.array(*map(F.lit, doc_ids)).cast("array<long>")
    spread = files.select("part", "file", "start", wanted.alias("wanted"))
    return spread.repartition(max(1, files.count()), "part").mapInArrow(_read(folder, False), "doc_id long, ids array<long>")


def digest_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = files.select("part", "file", "start").repartition(max(1, files.count()), "part")
    return spread.mapInArrow(_read(folder, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    files = write_token_files(read(spark, sf_dir, "documents"), folder)
    return digest_token_files(files, folder)
