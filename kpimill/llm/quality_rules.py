"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains.  Expectation-maximisation (Dawid and Skene's model) estimates how often each
rule casts each vote on good and on bad documents, and with it the probability that a document is good, which replaces
the demand that it pass every rule.

Rules see only counts made within a row, by built-in functions, so the documents are never shuffled.  The model needs of
the corpus only how often each combination of votes occurs: one aggregation, of 3 ** rules rows at most (6,561 for eight
rules) however many documents, on which the driver runs the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import Staged

SYMBOLS = "#*$%&|<>"
ROUNDS = 40


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: equal hashes meet by sorting within the row."""
    last = F.size(words) - 2
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("at")))

    def repeated(s: Column) -> Column:
        hit = lambda i: (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"])
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(hit(i), F.lit(False)))
        return F.sort_array(F.transform(places, lambda i: F.get(s, i)["at"]))

    def covered(at: Column) -> Column:  # each window adds the words after the end of the one before
        zero = F.struct(F.lit(-9).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("end"), (a["n"] + F.least(F.lit(3), p - a["end"])).alias("n"))
        return F.aggregate(at, zero, step)["n"]

    return F.when(last < 1, F.lit(0)).otherwise(_let(_let(F.sort_array(windows), repeated), covered))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what other rules count)."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " "))
    t = t.withColumn("one", one)
    t = t.withColumn("words", F.when(F.col("one") == "", F.array().cast("array<string>")).otherwise(F.split("one", " ")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    t = t.withColumn("lines", lines)
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    letters = F.regexp_replace("one", "[^\\p{L}]+", "")
    return t.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), (F.length("one") - F.greatest(F.size("words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), count("!").alias("n_shouts"),
        F.length(letters).cast("long").alias("n_letters"), F.length(F.regexp_replace(letters, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes good (1) or bad (-1); abstains (0) where neither condition is true."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("tinyint").alias(self.name)


RULES = (
    Rule("symbols", "100 * n_symbols <= word_chars", "100 * n_symbols > 4 * word_chars"),
    Rule("shouts", "20 * n_shouts <= n_words", "5 * n_shouts > n_words"),
    Rule("upper", "10 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    Rule("dup_lines", "n_lines >= 3 and 20 * n_dup_lines <= n_lines", "n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "n_words >= 20 and 20 * n_repeat_words <= n_words", "n_words >= 10 and 10 * n_repeat_words > 3 * n_words"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 7 * word_chars"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "n_words > 0 and (2 * word_chars < 5 * n_words or word_chars > 12 * n_words)"),
    Rule("length", "n_words >= 80", "n_words < 10"),
)
_START = {1: 0.01, 0: 0.4}


def fit_votes(patterns: Iterable[tuple[tuple[int, ...], int]], rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, prior: float = 0.8, tolerance: float = 1e-6, false_alarm: float = 0.002) -> tuple[float, dict]:
    """(share of good documents, P(bad vote | a vote, class) by rule and class) from the (votes of each rule, documents).

    No rule may call more than ``false_alarm`` of the good documents bad: without that bound the larger kinds of bad
    documents can end up in the class of the good, whose other votes they share.
    """
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    model = {r.name: dict(_START) for r in rules}
    for _ in range(rounds if total else 0):
        good = 0.0
        cast = {(r.name, v, c): 0.0 for r in rules for v in (1, -1) for c in (1, 0)}  # votes by rule, vote and class
        for votes, n in patterns:
            p = probability(votes, rules, prior, model)
            good += n * p
            for r, v in zip(rules, votes):
                if v:
                    cast[r.name, v, 1] += n * p
                    cast[r.name, v, 0] += n * (1 - p)
        before, prior = prior, min(max((good + 1) / (total + 2), 0.01), 0.99)
        for r in rules:
            for c in (1, 0):
                bad = cast[r.name, -1, c]
                model[r.name][c] = (bad + 0.5) / (bad + cast[r.name, 1, c] + 1)
            model[r.name][1] = min(model[r.name][1], false_alarm)
        if abs(prior - before) < tolerance:
            break
    return prior, model


def probability(votes: tuple[int, ...], rules: tuple[Rule, ...], prior: float, model: dict) -> float:
    """P(good | votes); an abstention says nothing."""
    odds = math.log(prior / (1 - prior))
    for r, v in zip(rules, votes):
        good, bad = model[r.name][1], model[r.name][0]
        odds += math.log((1 - good) / (1 - bad)) if v == 1 else math.log(good / bad) if v == -1 else 0.0
    return 1 / (1 + math.exp(-odds))


def posterior(rules: tuple[Rule, ...], prior: float, model: dict) -> Column:
    """:func:`probability` of the columns named like the rules."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r in rules:
        good, bad = model[r.name][1], model[r.name][0]
        odds = odds + F.when(F.col(r.name) == 1, math.log((1 - good) / (1 - bad))).when(F.col(r.name) == -1, math.log(good / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, votes.., p_good, kept).

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.  ``kept``: not
    ``base_failed``, and good with a probability of ``least`` or more.

    Null and empty texts count zero everywhere and fail the base.  Rows that repeat, share an id or have none are judged
    each.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    counts = text_counts(docs, id_col, text_col)
    voted = Staged(counts.select("*", *[r.vote() for r in rules]), "votes").df()
    names = [r.name for r in rules]
    patterns = voted.groupBy(*names).count().collect()  # 3 ** rules rows at most
    prior, model = fit_votes([(tuple(r)[:-1], r["count"]) for r in patterns], rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("p_good", posterior(rules, prior, model))
    kept = ~F.col("base_failed") & (F.col("p_good") >= least)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *names, "p_good", kept.alias("kept"))
