"""Quality rules: a decision list learned from labelled statistics, all in DataFrame expressions.

The statistics of a text are computed once by native expressions. Sequential covering then learns ordered rules that
reject: a rule grows by the threshold that gains most (FOIL's information gain) on two thirds of the labelled
documents, is pruned on the other third from its end while its precision there doesn't fall, is accepted if its
precision is high on both, and what it covers leaves the labelled rows. Every step is one aggregation to a histogram of
features x bins, so what reaches the driver doesn't depend on the number of labels. The list is emitted as one ordered
``CASE WHEN`` over the statistics.

Base rules reject texts with fewer than 20 words, or with more than 30 % of their words in repeated 8-word windows.
Windows are told apart by 64-bit hashes within their text.

Edge cases: null and empty texts have no words and fail the base rules; without usable labels the list is empty and the
base rules decide alone; null labels and ids teach nothing; repeated rows are judged each; an empty table gives an
empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


#: What rules may test; all are ratios, so a rule doesn't single out long or short texts as such.
FEATURES = {
    "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols": lambda: _ratio("n_symbols", "n_words"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats": lambda: _ratio("n_repeat_words", "n_words"),
    "upper": lambda: _ratio("n_upper", "word_chars"),
    "marks": lambda: _ratio("n_marks", "n_words"),
    "distinct": lambda: _ratio("n_distinct", "n_words"),
}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it within further lambdas."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows that the text holds twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, other: F.coalesce(F.get(s, other)["w"] == x["w"], F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW)))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        found = _bind(_bind(ordered, starts), length)
        return F.when(F.size(F.array_distinct(ws)) < F.size(ws), found).otherwise(0)

    return F.when(F.size(words) > WINDOW, _bind(_bind(hashes, windows), covered)).otherwise(0)


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and COUNTS of every whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        n = F.size(x)
        return F.struct(n.cast("long").alias("n_lines"), (n - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    found = documents.select(
        "doc_id",
        _bind(F.array_remove(F.split(text, SPACE), ""), of_words).alias("w"),
        _bind(lines, of_lines).alias("l"),
        count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[A-Z]").alias("n_upper"), count(r"!").alias("n_marks"),
    )
    return found.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks").select("doc_id", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold): above means value > threshold, else value <= threshold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            value = FEATURES[name]()
            out = out & (value > threshold if above else value <= threshold)
        return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for n, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(n))
    return out.otherwise(F.lit(0))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(
    labelled: DataFrame, *, label: str = "quality", bins: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95
) -> list[Rule]:
    """Rules that tell label 0 from label 1, from rows of COUNTS, ``doc_id`` and the label."""
    rows = labelled.where(F.col(label).isNotNull() & ~base_failed())
    value = {k: f() for k, f in FEATURES.items()}
    rows = rows.select(
        (F.col(label) == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"),
        *[F.col(c) for c in COUNTS], *[v.alias(k) for k, v in value.items()],
    )
    rows = materialize(rows)
    shares = [i / bins for i in range(1, bins)]
    # thresholds lie midway between neighbouring quantiles of the bad and of the good rows: a few bad ones still set some,
    # and a cut between the two kinds keeps its distance from both
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(k, shares, 10_000).alias(k) for k in FEATURES]).collect()
    values = {k: sorted({float(x) for r in cuts for x in r[k]}) for k in FEATURES}
    edges = {k: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for k, v in values.items()}
    code = {k: sum((F.when(F.col(k) > x, 1).otherwise(0) for x in e), F.lit(0)) for k, e in edges.items() if e}
    if not code:
        return []
    codes = F.array(*[F.struct(F.lit(k).alias("f"), c.alias("b")) for k, c in code.items()])
    rows = materialize(rows.select("bad", "grow", *COUNTS, codes.alias("codes")))
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        rule, inside = Rule(), left.where("grow")
        while len(rule.conditions) < max_conditions:
            table = inside.select("bad", F.explode("codes").alias("c")).groupBy("c.f", "c.b").agg(
                F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
            )
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in table.collect():
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            p0, n0 = (sum(x[i] for x in next(iter(by.values()), {}).values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for name, found in sorted(by.items()):
                p = n = 0
                for b, cut in enumerate(edges[name]):  # code b: b cuts lie below the value, so codes 0..b are <= cut
                    p, n = p + found.get(b, (0, 0))[0], n + found.get(b, (0, 0))[1]
                    for above, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                        if gain > best:
                            best, chosen = gain, (name, above, cut)
            if chosen is None:
                break
            rule.conditions.append(chosen)
            inside = left.where("grow").where(rule.column())
        if not rule.conditions:
            break
        heads = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        sums = [
            F.sum(F.when(h.column() & (F.col("grow") == g), x)).alias(f"{name}{k}{g}")
            for k, h in enumerate(heads) for g in (True, False) for name, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))
        ]
        c = left.agg(*sums).first()
        of = lambda k, g: ((c[f"p{k}{g}"] or 0), (c[f"n{k}{g}"] or 0))
        worth = lambda k: (of(k, False)[0] + 1) / (sum(of(k, False)) + 2)
        k = max(range(len(heads)), key=lambda k: (worth(k), -k))
        p, n = (of(k, True)[i] + of(k, False)[i] for i in (0, 1))
        if p < 3 or p / (p + n) < precision or sum(of(k, False)) and of(k, False)[0] / sum(of(k, False)) < precision:
            break
        rules.append(heads[k])
        left = left.where(~heads[k].column())
    return rules


def judge(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``doc_id``, COUNTS of the contract, ``base_failed``, ``kept`` and ``rule`` (0: none) of every document."""
    stats = materialize(statistics(documents))
    known = labels.select(F.col("doc_id").alias("__id"), "quality").where(F.col("__id").isNotNull())
    rules = learn(stats.join(known, F.col("doc_id") == F.col("__id")).drop("__id"), **parameters)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules).cast("int"))
    kept = (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "rule")
