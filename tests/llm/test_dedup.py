import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termframe.llm import line_dedup, minhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, shard int, h string, k long, label int, part int, _drops int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, n, "h", n, n, n, n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def key(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# --- lines

LINES = ["A common line of some length", "  a COMMON line of some length\t", "another common line, é and ñ, here", "short", "", "only once in the whole corpus, this one"]


def line_rows():
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(LINES[:5]) for _ in range(rng.randrange(6)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, LINES[5]), (None, LINES[0]), (7, rows[7][1]), (53, "\n".join([LINES[0]] * 3 + ["x" * 100_000] * 2)), (54, "\n"), (55, "é" * 10), (56, "é" * 20), (57, "É" * 20), (58, "é" * 20), (59, "é" * 20)]


def expected_lines(rows, min_docs=3):
    keys = lambda t: {k for x in (t or "").split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})) >= 20}
    found = Counter(k for i, t in rows if i is not None for k in keys(t))
    last = {k: max(i for i, t in rows if i is not None and k in keys(t)) for k in found}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or not any(found[k] >= min_docs and last[k] != i for k in keys(x))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_lines(spark):
    rows = line_rows()
    expected = expected_lines(rows)
    df = frame(spark, rows)
    digests = [tuple(r) for r in line_dedup.line_digests(df).collect()]
    assert key(digests) == key([(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in expected])
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert key([(r["doc_id"], r["text"] or "") for r in out.collect()]) == key([(i, t) for i, _, _, t in expected])
    assert line_dedup.line_digests(df.limit(0)).count() == 0


def test_lines_of_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "PROBES", 2)
    rows = line_rows()
    digests = [tuple(r) for r in line_dedup.line_digests(frame(spark, rows)).collect()]
    assert key(digests) == key([(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in expected_lines(rows)])


def test_lines_whose_hashes_agree_in_half(spark, monkeypatch):
    whole = line_dedup._hash
    monkeypatch.setattr(line_dedup, "_hash", lambda key: (whole(key)[0] % 2, whole(key)[1]))
    rows = line_rows()
    keys = [(i, *line_dedup._hash(k)) for i, t in rows if i is not None for k in {line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")} if line_dedup._long_enough(k, 20)]
    df = spark.createDataFrame(keys, "doc_id long, h long, f long")
    index, shards = line_dedup.line_index(df, 3)
    found = sorted(tuple(r) for r in line_dedup.probe_lines(df, index, shards).collect())
    holders = defaultdict(set)
    for i, *k in keys:
        holders[tuple(k)].add(i)
    n = Counter(tuple(k) for _, *k in keys)
    assert found == sorted((i, *k) for i, *k in keys if n[tuple(k)] >= 3 and i != max(holders[tuple(k)])) and len(found) > 20


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    found = line_dedup.PerfectHash.build(keys)
    again = line_dedup.PerfectHash(found.sizes, found.words, found.rest)
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    assert len(found.words) * 64 <= 6 * max(len(keys), 64)
    other = again.index(np.arange(1000, dtype=np.uint64))
    assert (other < max(len(keys), 1)).all()


# --- near duplicates


def shingles(text, lower=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 8, 60, 150]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows) * 7 % 101, rng.choice([" ", "\n", " \t"]).join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    copies = [(200 + i, rows[0][1]) for i in range(30)]
    return rows + copies + [(300, None), (301, ""), (302, " \n "), (303, "one"), (304, "ONE"), (None, "one"), (305, "one"), (305, "one"), (306, "long " * 30_000), (307, "long " * 30_001)]


def expected_groups(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent, one_task", [(80, 0), (85, 500_000)])
def test_near_duplicates(spark, monkeypatch, percent, one_task):
    monkeypatch.setattr(minhash_dedup, "ONE_TASK", one_task)
    rows = near_rows()
    groups = expected_groups(rows, percent)
    df = frame(spark, rows)
    found = minhash_dedup.near_duplicates(df, percent).collect()
    assert key([tuple(r) for r in found]) == key([(i, len(shingles(t)), groups.get(i), None if i is None else groups[i] == i) for i, t in rows])
    assert len({*groups.values()}) < len(groups) - 30
    out = minhash_dedup.dedup_documents(df, percent)
    assert out.columns == df.columns
    assert key([(r["doc_id"],) for r in out.collect()]) == key([(i,) for i in {*groups.values()}] + [(None,)])
    assert minhash_dedup.near_duplicates(df.limit(0), percent).count() == 0


def test_strays_meet_everyone(spark):
    """A chain and a crowd that share bands, so that leaders alone would not find every link."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[j] = f"y{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    groups = expected_groups(rows, 85)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows), 85).collect()}
    assert found == groups


def test_strays_of_a_filtered_leader_meet(spark):
    """Families of 300 documents with common boilerplate and over 15 % own shingles, which are linked with none
    but lead most buckets; the few near copies in them share nothing but these buckets."""
    rows = []
    for family, copies in enumerate((2, 5, 2, 3)):
        base = [f"b{family}x{i}" for i in range(86)]
        own = [18] * 300 + [4] * copies
        rows += [(n, " ".join(base + [f"w{n}x{i}" for i in range(k)])) for n, k in enumerate(own, 1000 * family)]
    groups = expected_groups(rows, 85)
    assert len({*groups.values()}) == len(groups) - 8
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows), 85).collect()}
    assert found == groups


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(minhash_dedup, "ONE_TASK", one_task)
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(30)] + [(100, 90), (95, 100)] + [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    parent = {v: v for x in links for v in x}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    found = minhash_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["v"]: r["label"] for r in found} == {v: find(v) for v in parent}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))
    s = minhash_dedup.signatures([np.unique(np.concatenate((common, x))) for x in (a, b)], 2000)
    assert abs((s[0::1, 0] == s[:, 1]).mean() - 0.8) < 0.04


# --- repeated strings


def string_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([390, 400, 401, 420, 500, 900]))) for _ in range(10)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randrange(0, 4)):
            part = rng.choice(base)
            part = part[rng.randrange(0, 60) : len(part) - rng.randrange(0, 60)]
            if rng.random() < 0.3:
                j = rng.randrange(len(part))
                part = part[:j] + rng.choice("xyz") + part[j + 1 :]
            text += "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 300))) + part
        rows.append((i if i % 9 else None, text if i % 31 else None))
    return rows + rows[:10] + [(500, "a" * 399), (501, "a" * 1200), (502, ""), (503, "b" * 400), (504, "c" * 401)]


def expected_strings(rows):
    raw = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for (doc_id, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if counts[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def expected_passages(rows):
    """Per row, the runs of strings of 264 bytes that another document also holds, if of 50 whole words or more."""
    documents = {(i, t or ""): (t or "").encode() for i, t in rows}
    holders = defaultdict(set)
    for d, b in documents.items():
        for i in range(len(b) - 263):
            holders[b[i : i + 264]].add(d)
    out = {}
    for d, b in documents.items():
        inside = np.zeros(len(b) + 2, int)
        for i in range(len(b) - 263):
            if len(holders[b[i : i + 264]]) > 1:
                inside[i + 1 : i + 265] = 1
        edges = np.flatnonzero(np.diff(inside))
        out[d] = sum(len([m for m in re.finditer(rb"\S+", b) if low <= m.start() and m.end() <= high]) >= 50 for low, high in edges.reshape(-1, 2).tolist())
    return [out[i, t or ""] for i, t in rows]


@pytest.mark.parametrize("stretch, paired", [(32_768, 6), (32_768, 1), (3, 6)])
def test_repeated_strings(spark, monkeypatch, stretch, paired):
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    rows = string_rows()
    expected = expected_strings(rows)
    found = [tuple(r) for r in suffix_dedup.repeat_digests(frame(spark, rows)).collect()]
    assert key(r[:5] for r in found) == key(expected) and sum(r[2] for r in expected) > 10_000
    passages = [(i, *x[1:], n > 0) for (i, _), x, n in zip(rows, expected, expected_passages(rows))]
    assert key((*r[:5], r[5] > 0) for r in found) == key(passages) and 20 < sum(x[-1] for x in passages) < 140
    assert suffix_dedup.repeat_digests(frame(spark, rows).limit(0)).count() == 0


def test_repeats_of_a_very_long_text(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[1_000_000:1_000_401]), (3, "x" + long[-400:])]
    found = {r["doc_id"]: r for r in suffix_dedup.repeat_digests(frame(spark, rows)).collect()}
    assert [(found[i]["n_removed"], found[i]["n_spans"]) for i in (1, 2, 3)] == [(801, 2), (401, 1), (400, 1)]


def test_maximal_repeats():
    rng = random.Random(3)

    def agree(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for _ in range(200):
        rows = sorted(((bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))), bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9)))) for _ in range(rng.randrange(2, 14))), key=lambda r: r[1])
        before, after = [r[0] for r in rows], [r[1] for r in rows]
        least = rng.randrange(1, 9)
        expected = set()
        for i, j in itertools.combinations(range(len(rows)), 2):
            left, right = agree(before[i], before[j]), agree(after[i], after[j])
            if left + right >= least and right:
                expected.add((left, right, tuple(k for k in range(len(rows)) if agree(before[k], before[i]) >= left and agree(after[k], after[i]) >= right)))
        owners = np.array([rng.randrange(4) for _ in rows])
        cover, mine, several, shared = (defaultdict(set) for _ in range(4))
        for a, b, m, fresh, others in suffix_dedup.Stretch(before, after).maximal_repeats(least, owners):
            assert (a, b, tuple(sorted(m.tolist()))) in expected | {(a, b, tuple(range(len(rows))))} and {*fresh, *others} <= {*m.tolist()}
            for i in fresh:
                mine[i] |= set(range(-a, b))
            for i in others:
                assert len({*owners[m]}) > 1
                shared[i] |= set(range(-a, b))
        for a, b, m in expected:
            for i in m:
                cover[i] |= set(range(-a, b))
                several[i] |= set(range(-a, b)) if len({owners[j] for j in m}) > 1 else set()
        plain = lambda x: {i: k for i, k in x.items() if k}
        assert plain(mine) == plain(cover) and plain(shared) == plain(several)
