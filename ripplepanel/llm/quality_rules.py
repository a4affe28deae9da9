"""Quality rules as a cascade that stops at the first failure, its order learned on a sample. Columns only.

``measures`` adds the counts that every rule may use; each is one pass over the text or its words. Windows of
three words are compared by a 64-bit hash within one document. ``plan_cascade`` runs each rule on a bounded
sample, takes the time as its cost and the share it rejects as its selectivity, and puts the rules with the most
rejection per cost first. The order changes the work, never the verdict: a document is kept when no rule fails.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.llm.common import WORD, texts
from ripplepanel.session import cut

#: Rows of the sample that orders the cascade (of those whose hashed id ends in a zero nibble).
SAMPLE = 2_000
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a rejected document; it reads the columns of ``measures`` and must not be null."""

    name: str
    fails: Column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> tuple[Rule, ...]:
    """Rules that leave prose of any length alone; shares are of words or of characters."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return (
        Rule("symbols", F.col("n_symbols") > 0.35 * n),
        Rule("word_length", ~(F.col("word_chars") / n).between(1.5, 20)),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.4 * F.col("n_lines"))),
        Rule("shouting", F.regexp_count("text", F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")) > 0.5 * n),
        Rule("exclamations", F.regexp_count("text", F.lit("!")) > 0.5 * n),
        Rule("letters", F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", "")) < 0.5 * chars),
        Rule("ellipses", F.regexp_count("text", F.lit(r"(?:\.{3}|…)[ \t]*(?:\n|\z)")) > 0.5 * F.greatest("n_lines", F.lit(1))),
        Rule("bullets", (F.col("n_lines") >= 5) & (F.regexp_count("text", F.lit(r"(?m)^[ \t]*[-*•][ \t]")) > 0.9 * F.col("n_lines"))),
    )


def measures(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, text (null: empty), ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long)."""
    trimmed = F.btrim("text", F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = texts(docs, keys=keys).select("*", words.alias("words"), lines.alias("lines"))
    # every array that a later step reads more than once is a column by then
    rows = rows.select(
        *keys, "text", "words", F.size("words").alias("n"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    window = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("windows", window)
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("ordered", F.when(some, ordered))
    again = F.filter("ordered", lambda s, k: (s.h == F.get("ordered", k - 1).h) | (s.h == F.get("ordered", k + 1).h))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda s: s.i)))
    # a window covers three words, or fewer where the next one starts earlier
    covered = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return rows.select(
        *keys, "text", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("n_lines").cast("long"), F.col("n_dup_lines").cast("long"),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost on a bounded sample, most first; ties keep their order."""
    few = docs.where(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).bitwiseAND(15) == 0).limit(sample)
    few = cut(measures(few), "rule_sample")
    few.agg(F.sum(F.length("text"))).collect()
    worth = []
    for rule in rules:
        start = time.perf_counter()
        row = few.agg(F.count_if(rule.fails).alias("bad"), F.count(F.lit(1)).alias("n")).first()
        spent = time.perf_counter() - start
        worth.append((row["bad"] + 0.5) / (row["n"] + 1) / spent)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def judge(
    docs: DataFrame, rules: Sequence[Rule] | None = None, sample: int = SAMPLE
) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` for every row.

    A null or empty text has zeros and fails the base. Repeated rows and null ids keep a row each; only id and
    text are read, so other columns may have any name. An empty table gives an empty table.
    """
    order = plan_cascade(docs, rules if rules is not None else default_rules(), sample)
    failed = F.when(base_failed(), F.lit(True))
    for rule in order:  # one CASE: a branch is evaluated only where none before it held
        failed = failed.when(rule.fails, F.lit(True))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~failed.otherwise(F.lit(False))).alias("kept"))
