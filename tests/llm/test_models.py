import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termframe.llm import bm25, decontamination, language_id, pii, quality

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TEXTS = [None, "", " ", "\n", "7", "!?", "é", "the and of " * 20_000]
CLASHING = "doc_id long, text string, score double, df long, lang_pred string, base int, q1 long, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", 1, 1, "y") for i, t in rows], CLASHING).repartition(3)


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def expected_spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()]


def pii_texts():
    rng = random.Random(9)
    parts = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 123-4567", "+1 2", "++49 30 1234567", "+1.2.3.4.5.6.7.8", "é😀", " ", "  ", ".", "-", "word", "id=12345678901234567", "\n", "me [at] some (dot) org"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ",", "-"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    return texts + ["1 " * 20_000, "1" * 30_000, "a" * 50_000, "-" * 50_000, "a." * 20_000 + "@b.c", "+1" * 10_000, "4111 1111 1111 1111 " * 300, "x@a" + ".b" * 10_000]


def test_base_spans(spark):
    texts = TEXTS[:7] + pii_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")]
    df = frame(spark, rows)
    found = pii.span_digests(df, pii.train(df)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault((r["doc_id"], r["base_sha256"]), r)
    for doc_id, text in rows:
        kinds = expected_spans(text)
        every = [s for spans in kinds for s in spans]
        r = by[doc_id, hashlib.sha256(",".join(every).encode()).hexdigest()]
        assert [r[f"n_{k}"] for k in PATTERNS] == list(map(len, kinds)), text
        assert {*every} <= {*r["spans"].split(",")} | ({""} if not every else set())
    assert pii.span_digests(df.limit(0), pii.Trees()).count() == 0


def test_trees_and_added_spans(spark):
    """Disguised addresses, phone numbers without a plus beside "tel" and assigned secrets are found among numbers, dates,
    hashes of files and words; the base spans stay as they are."""
    def card(i):
        body = f"411111{i:09d}"
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    rows = [(i, f"mail a.b{i}@mail.example.com or tel +1 (555) 01{i % 10}-{1000 + i} and card {card(i)}, host 10.0.{i % 9}.{i % 250}; api_key = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"") for i in range(400)]
    rows += [(1000 + i, f"sum 9{i:014d} of {i} on 2024-05-{i % 28 + 1:02d}, build long-word-with-a-{i}-in-it-and-more v1.2.{i}, row 12345{i:05d}") for i in range(400)]
    hidden = [(5000, "write to jo.do (at) some.org now"), (5001, "tel 1 (555) 010-4242 now"), (5002, "host 10[.]1[.]2[.]3 up"), (5003, "x = \"da39a3ee5e6b4b0d3255bfef95601890afd80709\""), (5004, "nothing 12"), (5005, None)]
    df = frame(spark, rows + hidden)
    model = pii.train(df)
    assert {0, 1, 3, 4} <= {*model.thresholds}
    out = pii.span_digests(df, model)
    found = {r["doc_id"]: r for r in out.collect()}
    assert [found[i]["spans"] for i in range(5000, 5006)] == ["email:9:28", "phone:4:20", "ip:5:19", "secret:5:45", "", ""]
    odd = [(i, found[i]["n_added"], found[i]["n_spans"], found[i]["spans"]) for i in range(400) if not (found[i]["n_added"] == 1 and found[i]["spans"].count("secret") == 1 and found[i]["n_spans"] == 5)]
    assert len(odd) <= 4 and all(n == 0 for _, n, _, _ in odd)  # a rare cell may stay below the threshold; nothing else is added
    assert sum(r["n_added"] for i, r in found.items() if 1000 <= i < 1400) == 0
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df, model).where("doc_id >= 5000").collect()}
    assert redacted == {5000: "write to [email] now", 5001: "tel [phone] now", 5002: "host [ip] up", 5003: "x = \"[secret]\"", 5004: "nothing 12", 5005: None}


# --- languages


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.op5_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.99 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in enumerate(["alpha beta gamma", "uno dos tres"] * 20)] + [(None, None, None), (90, "text", "")], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    assert model.languages == ["xx", "yy"]
    names, scores = model.predict(pa.array([*TEXTS, "alpha", "tres dos"]))
    assert names[:6] == ["und"] * 6 and names[6] in ("xx", "yy") and names[-2:] == ["yy", "xx"] and scores[-1] > 0.9
    df = frame(spark, list(enumerate(TEXTS)))
    out = language_id.predict(df, model, df.columns)
    assert sorted(out.columns) == sorted(df.columns) and {r["lang_pred"] for r in out.collect()} <= {"und", "xx", "yy"}
    assert language_id.predict(df.limit(0), model, ["doc_id"]).count() == 0
    assert model.predict(pa.array(["²½Ⅷ", "ª"]))[0][0] == "und"  # signs that count as word characters, but aren't letters
    nobody = language_id.train(rows.limit(0))
    assert nobody.predict(pa.array(["text"])) == (["und"], [0.0])


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(4)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20)] for i in range(135)}
    rows = [(n, " ".join(w), x) for n, (x, w) in enumerate([*words.items()] * 4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words)
    names, scores = model.predict(pa.array([" ".join(w[::-1]) for w in words.values()] + ["", None]))
    assert names == [*words, "und", "und"] and min(scores[:-2]) > 0.3


def exact_sets(rows):
    """Each language's n-grams by the definition, without Bloom filters."""
    fold = lambda t: re.sub(rb" +", b" ", bytes(b + 32 if 65 <= b < 91 else b if b > 96 and b < 123 or b > 127 else 32 for b in t.encode()))
    grams = lambda t: [x[i : i + 4] for x in [fold(t)] for i in range(len(x) - 3)]
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(text))
    counts = {x: Counter({g: n for g, n in c.items() if n >= language_id.LEAST}) for x, c in counts.items()}
    share = lambda x, g: counts[x][g] / counts[x].total()
    best = {g: max(share(x, g) for x in counts) for c in counts.values() for g in c}
    return {x: {g for g in c if share(x, g) >= language_id.SHARE * best[g]} for x, c in counts.items()}, grams


def test_filters_against_exact_sets(spark):
    rng = random.Random(21)
    words = {x: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for x, letters in {"aa": "abcdefé", "bb": "defghiñ", "cc": "ghijkab"}.items()}
    rows = [(" ".join(rng.choice(w) for _ in range(80)) + rng.choice(["", ".", "\n"]), x) for x, w in words.items() for _ in range(40)]
    sets, grams = exact_sets(rows)
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.languages == sorted(sets) and (0 < model.rates).all() and (model.rates < 1e-4).all()
    keys = {g: np.array([int.from_bytes(g)], np.uint64) for c in sets.values() for g in c}
    for g, k in keys.items():
        bits = int(np.bitwise_and.reduce([model.slots[at, 0] for at in language_id._slots(k)])[0])
        assert {x for i, x in enumerate(model.languages) if bits >> i & 1} >= {x for x in sets if g in sets[x]}
    texts = [" ".join(rng.choice(words[rng.choice(list(words))]) for _ in range(30)) for _ in range(50)]
    names, scores = model.predict(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        exact = {x: sum(g in sets[x] for g in grams(text)) for x in sets}
        assert exact[name] >= max(exact.values()) - 1 and abs(score - exact[name] / sum(exact.values())) < 0.01


def test_false_positives_are_corrected():
    slots = np.zeros((language_id.SLOTS, 1), np.uint8)
    for bit, keys in ((1, np.arange(1, 60_000, dtype=np.uint64)), (2, np.arange(1, 100, dtype=np.uint64))):
        for at in language_id._slots(keys):
            slots[at, 0] |= np.uint8(bit)
    model = language_id.Model.of(["a", "b"], slots, {"a": 1, "b": 1})
    assert model.rates[0] > 0.003 > model.rates[1]


# --- quality


@needs_data
def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in quality.op7_quality(spark, DATA).collect()]
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_edges(spark):
    df = frame(spark, [*enumerate(TEXTS), (None, "a"), (3, "a")])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    assert len(model.labels) == 3
    df = df.withColumn("_score", F.lit("own"))
    out = quality.score(df, model, df.columns)
    assert sorted(out.columns) == sorted(df.columns)
    assert out.count() == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 and r["_score"] == "own" for r in out.collect())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["_score"] for r in kept.collect()} <= {"own"} and {r["score"] for r in kept.collect()} <= {0.5}
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0 == quality.keep_good(df.limit(0), model).count()
    assert {r["score"] for r in quality.score(df, quality.train(df, labels.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert {r["score"] for r in quality.score(df, quality.train(df.limit(0), labels), ["doc_id"]).collect()} == {0.5}


def test_votes_against_exact_cosines():
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdeABC1!é") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60)))
    known, labels = [text() for _ in range(90)], np.array([rng.randrange(2) for _ in range(90)])
    model = quality.Model.fit(quality.counts(pa.array(known)), labels)
    others = [text() for _ in range(40)] + ["", known[3]]
    found = model.scores(pa.array(others))
    unit = lambda x: x / max(1e-9, math.sqrt(sum(v * v for v in x)))
    for t, score in zip(others, found):
        x = unit(unit(quality.counts(pa.array([t]))[0].astype(float) * model.idf) @ model.weights.astype(float))
        near = sorted(((float(sum(a * b for a, b in zip(x, v))), y) for v, y in zip(model.vectors.astype(float), labels)), reverse=True)
        votes = [(max(c, 1e-3) ** quality.POWER, y) for c, y in near[: quality.NEAREST]]
        assert abs(score - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3


# --- benchmarks


def test_contamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(40)]
    rows, planted = [], set()
    for d in range(300):
        words = [word() for _ in range(rng.randrange(200))]
        if d % 3 == 0:
            i, text = rng.choice(items)
            own = text.split()
            for _ in range(rng.randint(0, decontamination.allowed(len(own)))):
                j = rng.randrange(len(own))
                kind = rng.random()
                if kind < 0.4:
                    own[j] = word()
                elif kind < 0.7:
                    del own[j]
                else:
                    own.insert(j, word())
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "!" if d % 2 else w for w in own]
            planted.add((d, i))
        rows.append((d, " ".join(words)))
    df = frame(spark, rows + [(1000, None), (1001, ""), (None, "x"), (1002, items[0][1]), (1002, items[0][1])])
    benchmark = spark.createDataFrame(items + [(None, "abc"), (77, None), (78, ""), (0, items[0][1]), (79, "zz yy xx")], "item_id long, text string")
    found = decontamination.contaminations(df, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None and r["doc_id"] < 1000}
    assert len(planted - pairs) <= 0.01 * len(planted) and not pairs - planted
    assert sum(r["doc_id"] == 1002 for r in found) == 2
    out = decontamination.drop_contaminated(df, benchmark)
    assert out.columns == df.columns and out.count() == df.count() - len({d for d, _ in pairs}) - 2
    assert decontamination.contaminations(df.limit(0), benchmark).count() == 0
    assert decontamination.contaminations(df, benchmark.limit(0)).count() == 0


def test_contamination_against_all_windows(spark):
    """Every document's every substring against every item, by the exact distance; passages have as many edits as are
    allowed, or one more."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5])))
    items = [(i, [word() for _ in range(rng.choice([1, 3, 7, 8, 9, 14, 15, 30, 60]))]) for i in range(30)]
    rows = []
    for d in range(200):
        n, own = rng.choice(items)[1], None
        own = list(n)
        for _ in range(decontamination.allowed(len(own)) + d % 2):
            j = rng.randrange(len(own) or 1)
            own[j : j + 1] = rng.choice([[], [word()], [*own[j : j + 1], word()]])
        rows.append((d, [word() for _ in range(rng.randrange(40))] + own + [word() for _ in range(rng.randrange(40))]))
    rows.append((999, [word() for _ in range(60_000)] + items[4][1] + ["end"]))
    number = {w: i for i, w in enumerate({w for _, x in items + rows for w in x})}
    coded = lambda x: np.array([number[w] for w in x], np.uint64)
    expected = {(d, i) for d, x in rows for i, y in items if (d < 999 or i == 4) and decontamination.distance(coded(y), coded(x))[0] <= decontamination.allowed(len(y))}
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = decontamination.contaminations(frame(spark, [(d, " ".join(x)) for d, x in rows]), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] < 999 or r["item_id"] == 4}
    assert found <= expected and len(found) >= 0.98 * len(expected) > 100 and (999, 4) in found


def test_keys_find_items_and_little_else():
    rng = np.random.default_rng(3)
    for n in (8, 12, 25, 60):
        item = rng.integers(0, 2**63, n, dtype=np.uint64)
        near = []
        for _ in range(100):
            x = item.tolist()
            for _ in range(decontamination.allowed(n)):
                j = rng.integers(len(x))
                x[j : j + 1] = [[], [int(rng.integers(2**40))], [x[j], int(rng.integers(2**40))]][rng.integers(3)]
            near.append([*x, *range(1, n)][:n])
        own = decontamination.walk(item[None], n)
        share = lambda rows: (decontamination.walk(np.array(rows, np.uint64), n) == own).any(axis=1).mean()
        assert share(near) >= 0.98 and share(rng.integers(0, 2**63, (300, n), dtype=np.uint64)) <= 0.02


def test_edit_distance_of_the_best_place():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (8, 14))

        def edits(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x):
                last, row[0] = row[0], i + 1
                for j, q in enumerate(y):
                    last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (p != q))
            return row[-1]

        best = min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontamination.distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == best


# --- search


def expected_top(rows, queries, k=10):
    words = lambda t: Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode()))
    docs = [(i, words(t)) for i, t in rows if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in docs:
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in words(text).items() if w in c)
            if s > 0:
                scores.append((i, s))
        out[q] = sorted(scores, key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return out


@pytest.mark.parametrize("shard", [16_384, 25])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    rows += [(300 + i, rows[5][1]) for i in range(15)] + [(400, None), (401, ""), (None, "w1 w2"), (402, "w1"), (402, "w1"), (403, "lone " * 5000)]
    docs = frame(spark, rows)
    queries = [(q, t) for q, t in rows if q is not None and q % 20 == 0] + [(5, rows[5][1]), (900, "nowhere"), (901, None)]
    found = {}
    for r in bm25.search(bm25.build_index(docs), spark.createDataFrame(queries, "query_id long, text string")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    expected = expected_top(rows, queries)
    assert {*found} == {q for q, top in expected.items() if top}
    for q, top in expected.items():
        mine = sorted(found.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(top) + 1))
        assert [d for _, d, _ in mine] == [d for d, _ in top]
        assert np.allclose([s for *_, s in mine], [s for _, s in top], rtol=1e-4)
    assert bm25.search(bm25.build_index(docs.limit(0)), docs.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0


def test_search_leaves_no_small_shards(monkeypatch):
    """Each query meets every shard, so the few documents over a full shard go into it."""
    monkeypatch.setattr(bm25, "SHARD_DOCS", 24)
    monkeypatch.setattr(bm25.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + 5)), "text": [f"all {j}" for j in range(5)]}) for i in range(0, 30, 5)]
    assert [b.column("n_docs")[0].as_py() for b in bm25._index(iter(batches))] == [30]


@pytest.mark.parametrize("share", [0, 0.5, 0.97, 1, 1.2])
def test_search_of_a_shard_by_bounds(share):
    """Common terms are looked at as bounds, blocks are passed over; the best that reach the score are all found."""
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    texts += texts[:40] * 2
    rows, terms, counts, lengths = bm25.term_counts(pa.array(texts))
    batch = bm25._shard(0, [np.arange(len(texts))], [lengths], [rows], [terms], [counts])
    shard = bm25.Shard({c: batch.column(c)[0].as_buffer() for c in bm25._BLOBS}, float(lengths.mean()))
    assert shard.dense.itemsize == 1 and len(shard.dense) > 10
    queries = [terms[rows == i] for i in range(0, 3000, 100)]
    weights = [counts[rows == i] * np.random.default_rng(i).uniform(0.1, 9, (rows == i).sum()) for i in range(0, 3000, 100)]
    every = []
    for q, w in zip(queries, weights):
        shard.weight[np.searchsorted(shard.terms, q)] = w
        score = shard.full(np.arange(len(texts)))
        shard.weight[:] = 0
        every.append(sorted((-s, shard.ids[d]) for d, s in enumerate(score) if s > 0)[:10])
    least = np.array([-e[-1][0] * share for e in every])
    for e, low, (docs, score) in zip(every, least, shard.top(queries, weights, least, 10)):
        assert [x for x in zip(-score, shard.ids[docs]) if -x[0] >= low] == [x for x in e if -x[0] >= low]


def test_queries_of_a_batch_are_added_up_together(monkeypatch):
    """One step for all queries of a batch, whatever they share with the shard, gives what each alone gives."""
    rng = random.Random(8)
    texts = [" ".join(f"{'abcd'[i % 4]}{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 60))) for i in range(1500)]
    rows, terms, counts, lengths = bm25.term_counts(pa.array(texts))
    batch = bm25._shard(0, [np.arange(len(texts))], [lengths], [rows], [terms], [counts])
    shard = bm25.Shard({c: batch.column(c)[0].as_buffer() for c in bm25._BLOBS}, float(lengths.mean()))
    places = list(range(0, 1500, 50))
    queries = [terms[rows == i] for i in places] + [np.array([3, 5], np.uint64), np.zeros(0, np.uint64), terms[-1:]]
    weights = [counts[rows == i] * 1.5 for i in places] + [np.ones(2), np.zeros(0), np.ones(1)]
    least = np.array([i % 3 * 4.0 for i in range(len(places))] + [0.0] * 3)
    alone = [shard.top([q], [w], least[i : i + 1], 10)[0] for i, (q, w) in enumerate(zip(queries, weights))]
    steps, candidates = [], bm25.Shard._candidates
    monkeypatch.setattr(bm25.Shard, "_candidates", lambda self, *a: steps.append(1) or candidates(self, *a))
    together = shard.top(queries, weights, least, 10)
    assert len(steps) == 1
    assert [len(d) for d, _ in together[-3:]][:2] == [0, 0] and len(together[-1][0])
    for (docs, score), (docs_alone, score_alone), low in zip(together, alone, least):
        assert [x for x in zip(docs, score) if x[1] >= low] == [x for x in zip(docs_alone, score_alone) if x[1] >= low]


@needs_data
def test_pipeline_stages(spark):
    """Each stage on its own input, as the stages before left it."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = p.table(stage(spark, docs, DATA))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= {*before}
        kept.append(len(after))
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "benchmark decontamination":
            items = [r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
            dirty = {i for i, t in before.items() if any(x in t for x in items)}
            assert not dirty & after and len(before) - len(after) <= len(dirty) + 2
    assert kept[0] > 700 and kept == sorted(kept, reverse=True) and kept[1] == kept[0] and kept[4] == kept[3]
