"""PII by candidate gradient boosting, with DataFrame functions only.

Base spans are regular expressions with validators (see ``op2_pii``'s contract); they always stay. Generators
of high recall propose further spans that may overlap: anything around an ``@`` or ``(at)``, any four numbers
with dots or ``[.]``, any long run of digits with separators, any dialled-looking number, and, as a kind of its own
(secret), any long run of letters and digits. Boosted trees score each proposal by its format (digits, letters,
separators, marks, a leading plus) and its context (the characters and the words before it); a proposal of
which no base span covers a part is added if its score reaches its kind's threshold.

Labels don't come from the base rules' own outcome. Positive are base spans in disguise, in the context in which they were
found: addresses with ``(at)`` or ``[dot]``, numbers with ``[.]``, cards in groups by dots or wide gaps, phone numbers without
their plus. Unlabelled are the proposals of the corpus that no base span covers: lists of numbers, dates, ids, words with
digits and what is to be found. A secret is positive if it is assigned to a name like token, key or password; words before it
are no feature then. All features have a few values, so the whole corpus is one aggregation to a table of at most ``CELLS`` rows
(kind x features x fold: positives and all), which is all that reaches the driver. Trees of two levels are grown on it
by Newton boosting. Half of the documents (by hash) set the thresholds: the least score from which on at least
PRECISION of the kind's proposals are positive, of at least EVIDENCE proposals; otherwise nothing of that kind is added.

The trees become CASE expressions, so scoring stays in the JVM. Positions come from splitting a text at
its matches and summing lengths, in one pass; patterns are possessive and start only where a run of
their characters starts, so that long texts neither overflow the stack nor take quadratic time.

Nulls and edges: a null text is an empty one, without spans. Rows keep repeats; a null doc_id stays null.
An empty table gives no rows (and no model: nothing is added).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm.common import read

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: base kinds, and one that no base pattern has.
ALL_KINDS = (*KINDS, "secret")
#: The base patterns, written so that they match the same spans without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Runs of the characters of IP, CARD and PHONE that have a digit: each match of those lies within one.
REGION = r"(?<![0-9 ().+-])[ ().+-]*+[0-9][0-9 ().+-]*+"
#: Generators: (kind, pattern, whether it looks at the whole text).
PROPOSALS = (
    (0, r"(?<![^\s@<>(),;:\"])[^\s@<>(),;:\"]++@[^\s@<>(),;:\"]++", True),
    (0, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++", True),
    (1, r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}+", False),
    (1, r"(?<![0-9.\]])[0-9]++(?:\[\.\][0-9]++){3}+", True),
    (2, r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,}+", False),
    (3, r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,17}+", False),
    (4, r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}+[0-9])[A-Za-z0-9_+/-]{20,}+", True),
)
#: What a text must have for a generator that looks at the whole of it, by the generator's place.
HINTS = {0: "@", 1: r"(?i)[\[(]at[\])]", 3: r"\[\.\]", 6: "[A-Za-z0-9_+/-]{20}"}
#: What a secret is assigned to.
ASSIGNED = r"(?i)(?:token|secret|key|passw[a-z]*|pwd|auth[a-z]*)[\"' ]*[:=][\"' ]*$"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WORDS = ("", "phone|tel|call|fax|mobile", "card|visa|credit|debit|pay", "mail|contact|write", "host|server|addr|network| ip", "token|key|secret|hash|sha|id")
FEATURES = {"digits": 6, "separators": 4, "before": 4, "word": len(WORDS), "plus": 2, "mark": 4, "letters": 4}
#: Rows of the training table at most.
CELLS = len(ALL_KINDS) * int(np.prod(list(FEATURES.values()))) * 2
TREES, RATE, PRECISION, EVIDENCE = 40, 0.3, 0.995, 30


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, b>>: start and end in code points, text and up to 24 characters before."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string,b:string>>").alias("out"))

    def step(sofar: Column, x: Column) -> Column:
        start = sofar["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        new = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v"), F.right(x["g"], F.lit(24)).alias("b"))
        return F.when(x["m"].isNull(), sofar).otherwise(F.struct(end.alias("at"), F.concat(sofar["out"], F.array(new)).alias("out")))

    return F.aggregate(F.arrays_zip(gaps.alias("g"), matches.alias("m")), zero, step)["out"]


def _within(regions: Column, pattern: str) -> Column:
    """The matches within regions, placed in the text; what stands before a region is before its first."""
    def place(r: Column) -> Column:
        return F.transform(located(r["v"], pattern), lambda x: F.struct((x["s"] + r["s"]).alias("s"), (x["e"] + r["s"]).alias("e"), x["v"].alias("v"), F.concat(F.when(x["s"] == F.length(x["b"]), r["b"]).otherwise(F.lit("")), x["b"]).alias("b")))

    return F.flatten(F.transform(regions, place))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: int, v: Column) -> Column:
    """Whether text that has a kind's base form passes that kind's test."""
    n = F.length(_digits(v))
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == 2:
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(v))).otherwise(False)
    return (n >= 8) & (n <= 15)


_SPANS = "array<struct<s:int,e:int,v:string,b:string>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds _pii_base (an array of spans a kind) and _pii_proposed (spans with their kind k) to ``docs``. A text
    without @ or digits isn't searched for what needs them."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(_SPANS)
    docs = docs.withColumn("_pii_regions", F.when(text.rlike("[0-9]"), located(text, REGION)).otherwise(none))
    docs = docs.withColumn("_pii_mails", F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none))
    regions = F.col("_pii_regions")
    valid_of = lambda kind: lambda x: valid(kind, x["v"])
    base = [F.col("_pii_mails"), *(F.filter(_within(regions, p), valid_of(k)) for k, p in ((1, IP), (2, CARD), (3, PHONE)))]
    of_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["b"].alias("b"))
    proposed = []
    for i, (kind, pattern, whole) in enumerate(PROPOSALS):
        found = F.when(text.rlike(HINTS[i]), located(text, pattern)).otherwise(none) if whole else _within(regions, pattern)
        proposed.append(F.transform(found, of_kind(kind)))
    docs = docs.withColumn("_pii_base", F.array(*[F.coalesce(x, none) for x in base])).withColumn("_pii_proposed", F.concat(*proposed))
    return docs.drop("_pii_regions", "_pii_mails")


def features(x: Column) -> dict[str, Column]:
    """The features of a proposal (k, v, b), each from 0 to FEATURES - 1."""
    n, v, before = F.length(_digits(x["v"])), x["v"], F.lower(x["b"])
    last = F.right(x["b"], F.lit(1))
    steps = F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n == 16, 3).when(n < 20, 4).otherwise(5)
    kinds = F.when(v.rlike("[()]") | (v.rlike(r"\.") & v.rlike("[ -]")), 3).when(v.rlike(r"\."), 2).when(v.rlike("[ -]"), 1).otherwise(0)
    near = F.when(last.rlike(r"^$|\s"), 0).when(last.rlike("[A-Za-z]"), 1).when(last.rlike("""["'=:(<]"""), 2).otherwise(3)
    word = F.lit(0)
    for i in range(len(WORDS) - 1, 0, -1):
        word = F.when(before.rlike(WORDS[i]), i).otherwise(word)
    mark = F.when(v.rlike(r"\[\.\]"), 3).when(v.rlike(r"(?i)[\[(](?:at|dot)[\])]"), 2).when(F.contains(v, F.lit("@")), 1).otherwise(0)
    letters = F.when(~v.rlike("[A-Za-z]"), 0).when(v.rlike("^[0-9a-fA-F]+$"), 1).when(v.rlike("^[0-9A-Za-z]+$"), 2).otherwise(3)
    word = F.when(x["k"] == 4, 0).otherwise(word)
    return {"digits": steps, "separators": kinds, "before": near, "word": word, "plus": v.startswith("+").cast("int"), "mark": mark, "letters": letters}


def disguised(kind: int, v: Column) -> list[Column]:
    """Forms of a base span's text that the base pattern doesn't find."""
    if kind == 0:
        return [F.regexp_replace(v, "@", " (at) "), F.regexp_replace(F.regexp_replace(v, "@", "[at]"), r"\.", "[dot]")]
    if kind == 1:
        return [F.regexp_replace(v, r"\.", "[.]")]
    if kind == 2:
        return [F.regexp_replace(_digits(v), "([0-9]{4})(?=[0-9])", f"$1{gap}") for gap in (".", " - ")]
    return [F.regexp_replace(v, r"^\+", ""), F.regexp_replace(v, r"^\+", "00")]


@dataclass
class Trees:
    """Trees of two levels over features; a node asks whether a feature is at least a value."""

    trees: list[tuple] = field(default_factory=list)  # ((feature, value), (left split, leaves), (right split, leaves))
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(next(iter(x.values()))), self.start)
        for (f, v), left, right in self.trees:
            up = x[f] >= v
            for side, rows in ((left, ~up), (right, up)):
                (g, w), (low, high) = side
                total = total + np.where(rows, np.where(x[g] >= w, high, low), 0.0)
        return total

    def expression(self, x: dict[str, Column]) -> Column:
        total = F.lit(self.start)
        for (f, v), left, right in self.trees:
            leaf = lambda side: F.when(x[side[0][0]] >= side[0][1], side[1][1]).otherwise(side[1][0])
            total = total + F.when(x[f] >= v, leaf(right)).otherwise(leaf(left))
        return total

    @classmethod
    def fit(cls, x: dict[str, np.ndarray], positive: np.ndarray, every: np.ndarray, sizes: dict[str, int]) -> Trees:
        rate = min(max(positive.sum() / max(1, every.sum()), 1e-3), 1 - 1e-3)
        model = cls(start=float(np.log(rate / (1 - rate))))
        splits = [(f, v) for f, n in sizes.items() for v in range(1, n)]
        margin = model.margin(x)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = positive - every * p, every * p * (1 - p)
            gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)

            def best(rows: np.ndarray) -> tuple[float, tuple]:
                return max(((gain(rows & (x[f] >= v)) + gain(rows & (x[f] < v)), (f, v)) for f, v in splits), key=lambda a: a[0])

            def leaves(rows: np.ndarray) -> tuple:
                split = best(rows)[1]
                up = x[split[0]] >= split[1]
                value = lambda r: RATE * float(g[r].sum() / (h[r].sum() + 1))
                return split, (value(rows & ~up), value(rows & up))

            whole = np.ones(len(every), bool)
            f, v = best(whole)[1]
            model.trees.append(((f, v), leaves(x[f] < v), leaves(x[f] >= v)))
            margin = model.margin(x)
        return model

    def calibrate(self, kind: np.ndarray, margin: np.ndarray, positive: np.ndarray, every: np.ndarray) -> None:
        for k in range(len(ALL_KINDS)):
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(-margin[rows], kind="stable")]
            good, seen = np.cumsum(positive[rows]), np.cumsum(every[rows])
            last = np.append(np.diff(margin[rows]) != 0, True) if len(rows) else np.zeros(0, bool)  # of equal scores
            fit = np.flatnonzero(last & (seen >= EVIDENCE) & (good >= PRECISION * seen))
            if len(fit):
                self.thresholds[k] = float(margin[rows[fit[-1]]])


def _free(x: Column) -> Column:
    """Whether no base span covers a part."""
    return ~F.exists(F.flatten(F.col("_pii_base")), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def train(docs: DataFrame) -> Trees:
    """From all documents (doc_id, text)."""
    row = lambda k, v, b, y: F.struct(k.cast("int").alias("k"), v.alias("v"), b.alias("b"), y.cast("int").alias("y"))
    examples = [F.transform(F.filter("_pii_proposed", _free), lambda x: row(x["k"], x["v"], x["b"], (x["k"] == 4) & x["b"].rlike(ASSIGNED)))]
    forms = lambda k: lambda x: F.array(*[row(F.lit(k), v, x["b"], F.lit(1)) for v in disguised(k, x["v"])])
    for k in range(len(KINDS)):
        examples.append(F.flatten(F.transform(F.col("_pii_base")[k], forms(k))))
    x = F.col("x")
    rows = with_candidates(docs.select("doc_id", "text")).select("doc_id", F.explode(F.concat(*examples)).alias("x"))
    cells = rows.select(x["k"].alias("kind"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), x["y"].alias("y"), *[c.alias(n) for n, c in features(x).items()])
    cells = cells.groupBy("kind", "fold", *FEATURES).agg(F.sum("y").alias("positive"), F.count("*").alias("every")).collect()
    column = lambda name: np.array([r[name] for r in cells], np.int64)
    sizes = {"kind": len(ALL_KINDS)} | FEATURES
    found = {name: column(name) for name in sizes}
    fold, positive, every = column("fold"), column("positive").astype(float), column("every").astype(float)
    part = lambda rows: ({k: v[rows] for k, v in found.items()}, positive[rows], every[rows])
    if not (fold == 0).any():
        return Trees()
    model = Trees.fit(*part(fold == 0), sizes)
    held, good, seen = part(fold == 1)
    model.calibrate(held["kind"], model.margin(held), good, seen)
    return model


def spans(docs: DataFrame, model: Trees) -> DataFrame:
    """Adds _pii_base (array of arrays by kind) and _pii_added (array of k, s, e, v, b, in order) to ``docs``."""
    docs = with_candidates(docs)

    def wanted(x: Column) -> Column:
        ok = F.lit(False)
        score = model.expression({"kind": x["k"]} | features(x))
        for k, least in model.thresholds.items():
            ok = ok | ((x["k"] == k) & (score >= least))
        return _free(x) & ok

    added = F.filter("_pii_proposed", wanted) if model.thresholds else F.filter("_pii_proposed", lambda x: F.lit(False))
    return docs.withColumn("_pii_added", F.array_distinct(F.array_sort(added))).drop("_pii_proposed")


def _listed(k: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(ALL_KINDS[k]), x["s"], x["e"]))


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with each span's text in ``text`` replaced by its kind in brackets; overlapping spans are
    one, named by the first. Same columns."""
    names = docs.columns
    out = spans(docs, model)
    named = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS[k]).alias("k"))
    marked = [F.transform(F.col("_pii_base")[k], named(k)) for k in range(len(KINDS))]
    kinds = F.array(*map(F.lit, ALL_KINDS))
    marked.append(F.transform("_pii_added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(kinds, x["k"]).alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(sofar: Column, x: Column) -> Column:
        more = F.concat(sofar["done"], F.substring(F.col("text"), sofar["at"] + 1, x["s"] - sofar["at"]), F.lit("["), x["k"], F.lit("]"))
        return F.struct(F.greatest(sofar["at"], x["e"]).alias("at"), F.when(x["s"] < sofar["at"], sofar["done"]).otherwise(more).alias("done"))

    whole = F.aggregate(F.array_sort(F.concat(*marked)), zero, step, lambda x: F.concat(x["done"], F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    return out.withColumn("text", whole).select(*names)


def span_digests(docs: DataFrame, model: Trees) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind by kind), n_added and
    n_spans (how many were added, and how many there are)."""
    out = spans(docs.select("doc_id", "text"), model)
    base = [F.col("_pii_base")[k] for k in range(len(KINDS))]
    is_kind = lambda k: lambda x: x["k"] == k
    every = []
    for k in range(len(ALL_KINDS)):
        own = F.transform(base[k] if k < len(KINDS) else F.array().cast(_SPANS), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        new = F.transform(F.filter("_pii_added", is_kind(k)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        every.append(_listed(k, F.array_sort(F.concat(own, new))))
    listed = F.array_join(F.concat(*[_listed(k, base[k]) for k in range(len(KINDS))]), ",")
    counts = [F.size(base[k]).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.concat(*every), ",").alias("spans"), F.size("_pii_added").cast("long").alias("n_added"), (F.size(F.flatten(F.col("_pii_base"))) + F.size("_pii_added")).cast("long").alias("n_spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return span_digests(docs, train(docs))
