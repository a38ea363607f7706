"""Splitting token and word sequences into chunks, as array expressions of a row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpimill.functions.text import let

REACH = 200  #: how far from a chunk's border a safe break may lie
# Break marks in order of preference, all of them plain text
BREAKS = ("\n\n", "\nSida ", "\nNot ", ":\n", "\n\n[A-Z]", r"\. [A-ZÅÄÖ]")


def overlap_size(size: int, overlap: int | float) -> int:
    """An overlap in tokens, from a number of tokens or a share of the window."""
    if isinstance(overlap, bool) or not isinstance(overlap, (int, float)):
        raise TypeError("overlap must be a whole number of tokens or a share between 0 and 1")
    if isinstance(overlap, float):
        if not 0 < overlap < 1:
            raise ValueError("an overlap given as a share must lie between 0 and 1")
        overlap = math.floor(size * overlap)
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    return overlap


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def windows(tokens: Column, size: int, overlap: int | float) -> Column:
    """Overlapping windows of ``size`` tokens, the last one ending with the sequence; none of an empty sequence."""
    step = size - overlap_size(size, overlap)

    def cut(t: Column) -> Column:
        n = F.size(t)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, cut)  # once, not for each window


def greedy(items: Column, size: int, cost=None) -> Column:
    """Groups of words; a group ends with the word that brings its cost to ``size`` (one a word unless ``cost`` says)."""
    none = F.array().cast("array<array<string>>")
    if cost is None:
        part = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / size).cast("int")), lambda i: F.slice(t, i * size + 1, F.lit(size)))
        return let(items, lambda t: F.when(F.size(t) > 0, part(t)).otherwise(none))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(a: Column, w: Column) -> Column:  # the array only grows where a group ends
        ends = lambda full: F.when(full, F.array_append(a["ends"], a["at"] + 1)).otherwise(a["ends"])
        return let(a["used"] + cost(w), lambda u: F.struct(F.when(u >= size, 0).otherwise(u).alias("used"), (a["at"] + 1).alias("at"), ends(u >= size).alias("ends")))

    def split(t: Column) -> Column:
        ends = lambda e: F.when(F.coalesce(F.element_at(e, -1), F.lit(0)) < F.size(t), F.array_append(e, F.size(t))).otherwise(e)
        before = lambda e, i: F.when(i > 0, F.get(e, i - 1)).otherwise(0)
        groups = lambda e: F.transform(e, lambda end, i: F.slice(t, before(e, i) + 1, end - before(e, i)))
        return F.when(F.size(t) > 0, let(let(F.aggregate(t, zero, step, lambda a: a["ends"]), lambda e: F.when(F.size(e) > 0, ends(e)).otherwise(F.array(F.size(t)))), groups)).otherwise(none)

    return let(items, split)


def _rfind(text: Column, mark: str) -> Column:
    """Place from 0 of the last occurrence, -1 if there is none."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 1).otherwise(-1)


def trim_head(text: Column, reach: int = REACH, marks: tuple[str, ...] = BREAKS) -> Column:
    """After the first break mark, of the first kind that occurs near enough to the start."""
    cuts = [F.when((F.instr(text, m) > 0) & (F.instr(text, m) - 1 <= reach), F.instr(text, m) - 1 + len(m)) for m in marks]
    return let(F.coalesce(*cuts, F.lit(0)), lambda cut: F.substring(text, cut + 1, F.length(text)))


def trim_tail(text: Column, reach: int = REACH, marks: tuple[str, ...] = BREAKS) -> Column:
    """Up to the last break mark, of the first kind that occurs near enough to the end."""

    def cut(mark: str) -> Column:
        return let(_rfind(text, mark), lambda at: F.when((at >= 0) & (F.length(text) - at <= reach), at + len(mark)))

    cuts = [cut(m) for m in marks]
    return let(F.coalesce(*cuts, F.length(text)), lambda cut: F.substring(text, F.lit(1), cut.cast("int")))


def safe_breaks(chunks: Column, reach: int = REACH, marks: tuple[str, ...] = BREAKS) -> Column:
    """Chunks cut at safe breaks: every head but the first, then every tail but the last."""
    n = F.size(chunks)
    heads = F.transform(chunks, lambda c, i: F.when(i > 0, trim_head(c, reach, marks)).otherwise(c))
    return F.transform(heads, lambda c, i: F.when(i < n - 1, trim_tail(c, reach, marks)).otherwise(c))
