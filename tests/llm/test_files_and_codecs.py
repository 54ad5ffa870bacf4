import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from tokenizers import Tokenizer

from termframe.llm import sentencepiece_codec, token_files

TEXTS = ["", None, " ", "a", "The  the. THE!", "don't x's '' 's", "été İstanbul ciónñ ǰ J̌ é", "1234 5,678.90", "日本語 text\n\n\ttab\x0bvt\x1c", "x" * 3000, "😀😀 ok …. „a“", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑ", "<s> </s> <unk> ▁ ▁▁"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, i) for i, t in enumerate(TEXTS)] + [(3, "a", 99), (3, "a", 99)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files = token_files.write_token_files(docs, folder)
    rows = sorted(token_files.digest_token_files(files, folder).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for doc_id, text in sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x)):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == expected
    some = token_files.read_token_files(files, folder, [4, 9]).collect()
    assert {r["doc_id"] for r in some} == {4, 9}
    empty = token_files.write_token_files(docs.limit(0), folder + "2")
    assert token_files.digest_token_files(empty, folder + "2").count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    path = str(tmp_path / "x.zst")
    where = fs.LocalFileSystem()
    with where.open_output_stream(path, compression=None) as out:
        writer = token_files.FrameWriter(out)
        for i in range(5):
            writer.add(i, np.arange(i * 100, dtype=np.uint32))
        writer.close()
    with where.open_input_file(path) as source:
        reader = token_files.FrameReader(source)
        assert reader.frame(3).tolist() == list(range(300)) and [d for d, _ in reader.documents({1, 4})] == [1, 4]
        place = int(reader.starts[2]) + 12
    raw = bytearray(open(path, "rb").read())
    raw[place] ^= 1
    open(path, "wb").write(raw)
    with where.open_input_file(path) as source:
        reader = token_files.FrameReader(source)
        assert len(reader.frame(3)) == 300
        with pytest.raises(Exception):
            reader.frame(2)


def test_codec(spark, docs):
    rows = sentencepiece_codec.codec_digests(docs).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(expected, key=key)
    codec, spans = sentencepiece_codec.Codec(sentencepiece_codec.load_model()), {}
    for x in (r["text"] or "" for r in docs.collect()):
        ids = codec.encode([x])[0]
        spans[hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] = hashlib.sha256(codec.spans(x, ids).astype("<u4").tobytes()).hexdigest()
    assert {r["ids_sha256"]: r["spans_sha256"] for r in rows} == spans
    assert sentencepiece_codec.codec_digests(docs.limit(0)).count() == 0 == sentencepiece_codec.encode_documents(docs.limit(0)).count()
    out = sentencepiece_codec.encode_documents(docs)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "starts", "ends", "decoded"]
    for r in out.collect():
        raw = (r["text"] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r["starts"], r["ends"])) == raw


def test_spans_of_a_very_long_text_are_the_librarys(spark):
    text = "The été 日本 😀 x\ty  zz\n" * 20_000
    row = sentencepiece_codec.encode_documents(spark.createDataFrame([(1, text)], "ids long, text string")).first()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = library.encode(text, return_type="proto").pieces
    assert row["ids"] == [1, *(p.id for p in pieces), 2] and row["decoded"] == text
    for a, b, p in zip(row["starts"][1:-1], row["ends"][1:-1], pieces):
        if p.surface and not p.piece.startswith("<0x"):
            assert (a, b) == (p.begin, p.end)


def test_spans_agree_with_the_library():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_model())
    for text in filter(None, TEXTS):
        ids = codec.encode([text])[0]
        proto = codec.library.encode(text, return_type="proto")
        spans = codec.spans(text, ids)[1:-1]
        for (a, b), piece in zip(spans.tolist(), proto.pieces):
            if piece.surface and not piece.piece.startswith("<0x"):
                assert text.encode()[a:b].decode() == piece.surface


def _model(mapping, squeeze):
    """A model whose character map holds ``mapping``: a double array with one unit a byte, built by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(sentencepiece_codec.load_model())
    targets, places = bytearray(), {}
    for source, target in mapping.items():
        places[source.encode()] = len(targets)
        targets += target.encode() + b"\0"
    units, used = [0] * 256, set()
    trie: dict = {}
    for source in places:
        node = trie
        for byte in source:
            node = node.setdefault(byte, {})
        node[None] = places[source]

    def lay(node, place):
        base = 256
        while any((base ^ (k or 0)) in used for k in node):
            base += 256
            if base >= len(units):
                units.extend([0] * 256)
        while len(units) < base + 256:
            units.extend([0] * 256)
        used.update(base ^ (k or 0) for k in node)
        offset = base ^ place
        units[place] |= (offset << 10) if offset < 1 << 21 else ((offset >> 8) << 10 | 512)
        if None in node:
            units[place] |= 256
            units[base] = node[None] | 1 << 31
        for k, child in node.items():
            if k is not None:
                units[base ^ k] |= k
                lay(child, base ^ k)

    lay(trie, 0)
    used.add(0)
    blob = np.array(units, "<u4").tobytes()
    proto.normalizer_spec.precompiled_charsmap = len(blob).to_bytes(4, "little") + blob + bytes(targets)
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    return proto.SerializeToString()


@pytest.mark.parametrize("squeeze", [False, True])
def test_longest_prefix_normalisation(squeeze):
    model = _model({"ﬁ": "fi", "a": "A", "ab": "X", "abc": "", "\t": " ", "é": "ee"}, squeeze)
    normalise = sentencepiece_codec.Normaliser(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ("ﬁn ab abc abd a", "  x\t\ty ", "é\té", "plain", "abcabcab", " "):
        normal, align = normalise(text.encode())
        assert normal.decode().replace("▁", " ") == library.normalize(text).replace("▁", " "), text
        assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())
    text = "abx ﬁ\t\t éab" * 30_000
    assert normalise(text.encode())[0].decode().replace("▁", " ") == library.normalize(text).replace("▁", " ")
    normal, align = normalise("xﬁy".encode())
    assert [int(align[normal.index(c)]) for c in (b"x", b"f", b"i", b"y")] == [0, 1, 1, 4]


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    definition = open(public_tokenizers.path("word_bpe_49k.json")).read()
    tokenizer, library = token_files.ChunkTokenizer(definition), Tokenizer.from_str(definition)
    texts = ["one two three", "four five", "one six", ""]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for hashes in (token_files.mix, lambda x: x * np.uint64(0), lambda x: x % np.uint64(3)):
        monkeypatch.setattr(token_files, "mix", hashes)
        for some, ids in ((texts, expected), (texts[:1], expected[:1]), (texts[1:2], expected[1:2])):
            found, at = tokenizer(pa.array(some))
            assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == ids
