"""The pipeline against a plain version of each stage, on documents with nulls, empty, long and repeated texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from termframe.llm import decontamination, quality
from test_dedup import expected_groups, expected_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _score double, _drops string, score int, h long, component_id long"


def documents():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, item = line(9), line(20)
    rows = []
    for i in range(50):
        rows.append((i, "\n".join(line(rng.randrange(4, 12)) for _ in range(6)) + (f"\n{shared}" if i % 4 == 0 else "") + (f" {item}" if i % 13 == 5 else "")))
    rows += [(60 + i, rows[i][1].replace("a", "A", 3)) for i in range(6)] + [(70, rows[3][1] + " and one more")]
    rows += [(80 + i, "### &&& !!! " * 40 + str(i)) for i in range(12)]
    rows += [(95, None), (96, ""), (97, " \n\t"), (None, rows[1][1]), (None, None), (98, line(30_000)), (2, rows[2][1]), (2, rows[2][1]), (99, "one two")]
    labels = [(i, int(i < 60), 0) for i in range(92)] + [(None, 1, 0), (4, None, 0), (5, 1, 0)]
    return rows, labels, [(1, item), (2, None), (3, ""), (None, "x y"), (4, line(15))]


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, labels, items):
        full = [(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2, 3) for i, t in rows]
        spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def key(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_stages_against_plain_ones(spark, tables):
    rows, labels, items = documents()
    sf_dir = tables(rows, labels, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold(5) != 0)
    model = quality.train(docs, known)
    expected = [(i, t) for i, t in rows if model.scores(pa.array([t], pa.string()))[0] >= quality.THRESHOLD]
    assert 50 <= len(expected) < len(rows)
    plain = [expected]
    expected = [(i, None if t is None else new) for (i, t), (_, _, _, new) in zip(expected, expected_lines(expected))]
    plain.append(expected)
    groups, seen, kept = expected_groups(expected, 80), set(), []
    for i, t in expected:
        if i is None or groups[i] == i and i not in seen:
            kept.append((i, t))
            seen.add(i)
    plain.append(kept)
    words = lambda t: decontamination.words_of(pa.array([t], pa.string()))[0]
    sure = [words(t) for i, t in items if i is not None and t]
    plain.append([(i, t) for i, t in kept if not any(decontamination.distance(w, words(t))[0] <= decontamination.allowed(len(w)) for w in sure)])
    for (name, stage), before in zip(corpus_pipeline.STAGES[:-1], plain):
        docs = corpus_pipeline.table(stage(spark, docs, sf_dir))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        assert key((r["doc_id"], r["text"]) for r in docs.collect()) == key(before), name
    assert len({*map(len, plain)}) >= 3
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in plain[-1]]
    last = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in ids]
    assert key(tuple(r)[:4] for r in corpus_pipeline.run(spark, sf_dir).collect()) == key(last)


def test_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [], [])).count() == 0
