"""SentencePiece encoding with byte offsets, and decoding.

A model file holds a compiled character map: a double-array trie of source strings and the strings that
replace them. ``Normaliser`` walks it from every place of a text at once, a byte of all places a step, and keeps the
longest prefix that ends in an entry (a model without a map has none anywhere). Reading from the left, such
prefixes are replaced and all other characters stay; spaces are squeezed and marked as the model says. Every
normalised byte has the source byte it came from. Pieces are laid end to end over the normalised text, so
their lengths give normalised spans and the alignment projects those to spans of the original bytes.

Nulls and edges: a null text is an empty one; an empty text has the begin and end ids only and no spans.
Rows keep their order, repeats and further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2

from termframe.llm.common import pieces, read, text_bytes

#: The library's mark of a space within normalised text.
SPACE_MARK = "▁".encode()


class Normaliser:
    """The normaliser of a model, with source alignment."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.own = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len)
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.targets = blob[4 + size :]

    def longest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in a text's bytes the length of the longest entry of the character map that starts
        there (0 if there is none), and where its replacement stands."""
        lengths, targets = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        units = self.trie
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at = np.arange(len(data) if len(units) else 0)
        node = np.full(len(at), offset(units[0]) if len(units) else 0)
        depth = 0
        while len(at):
            byte = data[at + depth].astype(np.int64)
            node = node ^ byte
            unit = units[node]
            good = unit & 0x800000FF == byte
            at, unit, node = at[good], unit[good], node[good]
            node = node ^ offset(unit)
            depth += 1
            ends = unit >> 8 & 1 == 1
            lengths[at[ends]] = depth
            targets[at[ends]] = units[node[ends]] & 0x7FFFFFFF
            inside = at + depth < len(data)
            at, node = at[inside], node[inside]
        return lengths, targets

    def _replaced(self, text: bytes, data: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, new bytes) of what is replaced, from the left."""
        lengths, targets = self.longest(data)
        for x in self.own:  # the model's own symbols stay as they are and go before the map; the longest is last
            at = text.find(x)
            while at >= 0:
                lengths[at], targets[at] = len(x), -1
                at = text.find(x, at + 1)
        out, end = [], 0
        for at in np.flatnonzero(lengths).tolist():
            if at >= end:
                n, start = int(lengths[at]), int(targets[at])
                out.append((at, n, text[at : at + n] if start < 0 else self.targets[start : self.targets.index(b"\0", start)]))
                end = at + n
        return out

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in ``text``."""
        data = np.frombuffer(text, np.uint8)
        parts, places, leading, at = [], [], [], 0
        for start, n, new in self._replaced(text, data):
            parts += [data[at:start], np.frombuffer(new, np.uint8)]
            places += [np.arange(at, start), np.full(len(new), start)]
            leading += [np.ones(start - at, bool), np.arange(len(new)) < len(new) - len(new.lstrip(b" "))]
            at = start + n
        x = np.concatenate([*parts, data[at:]])
        align = np.concatenate([*places, np.arange(at, len(data))]).astype(np.int64)
        if self.squeeze and len(x):  # a space that starts what a place became goes if one stands before it
            blank = x == 32
            stay = ~(blank & np.concatenate([*leading, np.ones(len(data) - at, bool)]) & np.concatenate(([True], blank[:-1])))
            x, align = x[stay], align[stay]
        if not len(x):
            return b"", np.zeros(1, np.int64)
        first, end = align[0], len(data)
        if self.squeeze:
            tail = len(x) - len(x.tobytes().rstrip(b" "))
            if tail:
                end = align[-tail]
                x, align = x[:-tail], align[:-tail]
        if self.dummy:
            x = np.append(x, 32) if self.suffix else np.insert(x, 0, 32)
            align = np.append(align, end) if self.suffix else np.insert(align, 0, first)
        normal = x.astype(np.uint8).tobytes()
        if self.escape:
            normal, align = normal.replace(b" ", SPACE_MARK), np.repeat(align, np.where(x == 32, len(SPACE_MARK), 1))
        return normal, np.append(align, end)


class Codec:
    """Encoding and decoding with one model; built once a worker from the bytes of the model file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalise = Normaliser(model)
        sp = self.library
        self.byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        self.length = np.where(self.byte, 1, [len(sp.id_to_piece(i).encode()) for i in range(sp.get_piece_size())])
        self.unknown = sp.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(start, end) in bytes of ``text`` for every id; begin and end ids are empty spans. Byte pieces
        cover their own byte of a character; a piece made of a replaced character covers its source."""
        normal, align = self.normalise(text.encode())
        inner = np.array(ids[1:-1], np.int64)
        if self.unknown in ids[1:-1]:  # its length isn't known from the id; the library's own alignment has it
            proto = self.library.encode(text, return_type="proto")
            lengths = np.array([len(p.piece.encode()) for p in proto.pieces], np.int64)
        else:
            lengths = self.length[inner]
        ends = np.cumsum(lengths)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        n = len(text.encode())
        starts = align[ends - lengths] if len(ends) else ends
        stops = align[ends] if len(ends) else ends
        return np.concatenate(([[0, 0]], np.stack((starts, stops), 1), [[n, n]]))


def _codec_job(model: bytes, digest: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in pieces(batches, most=1 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            encoded = codec.encode(texts)
            if digest:
                n = list(map(len, encoded))
                ids_sha = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in encoded]
                decoded = [hashlib.sha256(codec.library.decode(x).encode()).hexdigest() for x in encoded]
                spans = [hashlib.sha256(codec.spans(t, x).astype("<u4").tobytes()).hexdigest() for t, x in zip(texts, encoded)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": decoded, "spans_sha256": spans})
                continue
            spans = [codec.spans(t, x) for t, x in zip(texts, encoded)]
            out = {name: batch.column(name) for name in keep}
            out |= {"ids": pa.array(encoded, pa.list_(pa.int32())), "starts": pa.array([s[:, 0] for s in spans], pa.list_(pa.int64())), "ends": pa.array([s[:, 1] for s in spans], pa.list_(pa.int64())), "decoded": pa.array([codec.library.decode(x) for x in encoded], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def load_model(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``docs`` (text, ...) with ids, starts, ends (bytes of the text that each piece came from) and the
    decoded text in place of any columns of those names."""
    keep = [c for c in docs.columns if c not in ("ids", "starts", "ends", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(_codec_job(load_model(model_path), False, keep), schema + ", ids array<int>, starts array<long>, ends array<long>, decoded string")


def codec_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256 of all ids' spans (start and end
    bytes as little-endian unsigned 32-bit integers)."""
    return docs.select("doc_id", "text").mapInArrow(_codec_job(load_model(model_path), True, []), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(read(spark, sf_dir, "documents"))
