"""Quality rules as a short-circuit cascade, DataFrame functions only.

A rule rejects a document by a condition on features of its text.  On a
bounded sample of rows the cascade measures each rule's cost (seconds for the
sample) and which rows it rejects, then orders the rules: next comes the rule
that rejects most of what the earlier ones leave, per cost.  One CASE holds
the rules in that order; a document is tested until the first rule rejects
it, so later features are not computed for it.  The verdict does not depend
on the order, only the name of the rule that is reported first does.  Features
that the caller wants as columns are computed for every row and cost a rule
nothing more; all others are computed inside the CASE only.

Words are runs of other than ASCII white space.  Features see the whole text.

Defined results: null and empty texts have no words; repeated rows are judged
each; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
#: Longer texts are left out of the sample (not of the verdicts), so its size is bounded.
SAMPLE_BYTES = 65_536
_REPEAT = 8

_WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _count(text: Column, keep: str) -> Column:
    """Characters of a class in a text."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{keep}]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(_WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that a text has twice or more."""
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))).otherwise(
        F.array().cast("array<string>"))

    def repeats(s: Column) -> Column:  # sorted (window, place): equal windows are neighbours
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["v"] == x["v"], F.lit(False)) | F.coalesce(
            F.get(s, j + 1)["v"] == x["v"], F.lit(False))
        places = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places))).cast("long")

    def count(v: Column) -> Column:
        placed = F.transform(v, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(placed), repeats))

    return let(windows, count)


#: Features by name, each a function of the text column.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x20\x09-\x0D]+", "")).cast("long"),
    "n_symbols": lambda t: _count(t, r"#*$%&|<>"),
    "n_capitals": lambda t: _count(t, r"\p{Lu}"),
    "n_lines": lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: x.rlike(_WORD))).cast("long"),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda t: let(words(t), repeated_words),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``condition`` (SQL over the named features) holds."""
    name: str
    features: tuple[str, ...]
    condition: Callable[[dict[str, Column]], Column]


RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", ("word_chars", "n_symbols"), lambda f: 100 * f["n_symbols"] > 10 * f["word_chars"]),
    Rule("capitals", ("word_chars", "n_capitals"), lambda f: 100 * f["n_capitals"] > 40 * f["word_chars"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: 100 * f["n_dup_lines"] > 40 * f["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: f["word_chars"] > 20 * f["n_words"]),
)
BASE = ("few_words", "repeated_words")


def features(text: Column, names) -> dict[str, Column]:
    return {n: FEATURES[n](text) for n in names}


def rejects(rule: Rule, text: Column) -> Column:
    return F.coalesce(rule.condition(features(text, rule.features)), F.lit(False))


def order_by_rejection(cost: dict[str, float], rejected: dict[str, set[int]]) -> list[str]:
    """Names in order: most rows not yet rejected per cost first; equal ones by cost, then name."""
    order, gone, left = [], set(), set(cost)
    while left:
        best = min(left, key=lambda n: (-len(rejected[n] - gone) / max(cost[n], 1e-9), cost[n], n))
        order.append(best)
        left.discard(best)
        gone |= rejected[best]
    return order


def measure(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS, fraction: float = 0.1,
            seed: int = 5) -> tuple[dict[str, float], dict[str, set[int]]]:
    """(seconds a rule takes on the sample, sample rows it rejects)."""
    spark = docs.sparkSession
    short = docs.select(F.col(text).alias("t")).where(F.octet_length(text) <= SAMPLE_BYTES).sample(fraction, seed)
    taken = [(i, r["t"]) for i, r in enumerate(short.take(rows))]
    sample = spark.createDataFrame(taken, "i int, t string").repartition(2)
    flags = sample.select("i", *[rejects(r, F.col("t")).alias(r.name) for r in rules]).collect()
    rejected = {r.name: {f["i"] for f in flags if f[r.name]} for r in rules}
    many = sample.select("i", "t", F.explode(F.sequence(F.lit(1), F.lit(_REPEAT))).alias("again"))

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count_if(condition)).first()
        return time.perf_counter() - began

    idle = min(seconds(F.col("t").isNull()) for _ in range(2))
    return {r.name: max(seconds(rejects(r, F.col("t"))) - idle, 1e-3) for r in rules}, rejected


def cascade(docs: DataFrame, rules=RULES, text: str = "text", with_features: bool | tuple[str, ...] = False,
            order: list[str] | None = None) -> DataFrame:
    """``docs`` with failed_rule (null: none) and kept.  ``with_features``
    returns features of the rules too (those named, True: every one), computed
    once for every row; rules that need no other feature cost nothing more."""
    by_name = {r.name: r for r in rules}
    used = list(dict.fromkeys(f for r in rules for f in r.features))
    eager = [f for f in used if with_features is True or f in (with_features or ())]
    if order is None:
        cost, rejected = measure(docs, rules, text)
        order = order_by_rejection({n: 1e-3 if set(by_name[n].features) <= set(eager) else c for n, c in cost.items()}, rejected)
    out = docs.drop("failed_rule", "kept", *eager).withColumns(features(F.col(text), eager))
    verdict = None
    for name in order:
        rule = by_name[name]
        values = {f: F.col(f) if f in eager else FEATURES[f](F.col(text)) for f in rule.features}
        hit = F.coalesce(rule.condition(values), F.lit(False))
        verdict = F.when(hit, name) if verdict is None else verdict.when(hit, name)
    return out.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
