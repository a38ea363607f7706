"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (its expected number of copies) that departs as little as possible, in relative entropy,
from one copy each, subject to its source's token total meeting the source's target and to no rate passing ``most``.
The solution is the exponential tilt ``rate = min(most, exp(lambda * size / mean size))`` with one multiplier for each
source, found by Newton steps on the convex dual.  Rates are then rounded into whole copies so that a source's total
comes within a few words of its target where its documents allow.

The dual and the rounding need of the documents only how many of each size a source has, so both run on that histogram,
a table of (source, size) rows.  Each Newton step is one aggregation over it, for all sources at once; nothing but the
news that all have converged reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpimill.llm.common import Staged

BLOCKS = 1024  #: hash blocks in which documents of equal source and size are counted and ranked
STEPS = 60  #: most Newton steps; a step that leaves its bracket halves it, so these suffice
MENDERS = 16  #: sizes of each octave that make up what rounding the others leaves of a source's target


def token_size(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none in null."""
    one = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))  # n words are parted by n - 1 spaces
    spaces = F.octet_length(one) - F.octet_length(F.translate(one, " ", ""))
    return F.when(text.isNull() | (one == ""), F.lit(0)).otherwise(spaces + 1).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all sizes by weight; a
    target stops at ``most`` times its source's size and the excess is shared again until none is above.  That fixed
    point is the water level at which the capped targets add up, found in one pass over the sources ordered by the
    level that fills them.  One row for each source is ordered, in one task: meant for up to some ten million sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(all_rows) * float(share)
    # the level if exactly the sources before this one are capped; it holds at the first one that it doesn't fill
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("at", F.row_number().over(by_level)).withColumn("level", level)
    holds = F.when(F.col("level") <= F.col("full_at"), F.struct("at", "level"))
    s = s.withColumn("level", F.coalesce(F.min(holds).over(all_rows)["level"], F.max("full_at").over(all_rows)))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def newton_step(hist: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """The multipliers ``lam`` of ``state``, in the bracket ``lo`` to ``hi``, after one step on each source's dual.

    The gradient of the dual is the source's token total minus its target, which rises in lambda; its slope is the
    Hessian.  A step that leaves the bracket is replaced by the bracket's middle; ``done`` sources stay.
    """
    rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), most)
    got = F.col("n") * F.col("size") * rate
    sums = hist.join(state.select("key", "lam", "mean"), "key").groupBy("key").agg(F.sum(got).alias("total"), F.sum(F.when(rate < most, got * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
    s = state.join(sums, "key").withColumn("off", F.col("total") - F.col("target"))
    s = s.withColumn("done", F.col("done") | (F.abs("off") <= 1e-9 * F.greatest("target", F.lit(1.0))))
    s = s.withColumn("lo", F.when(F.col("off") <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("off") >= 0, F.col("lam")).otherwise(F.col("hi")))
    to = F.when(F.col("slope") > 0, F.col("lam") - F.col("off") / F.col("slope"))
    new = F.when(F.col("done"), F.col("lam")).when((to > F.col("lo")) & (to < F.col("hi")), to).otherwise((F.col("lo") + F.col("hi")) / 2)
    return s.select("key", "source_size", "target", "mean", new.alias("lam"), "lo", "hi", "done")


def multipliers(hist: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(key, source_size, target, mean, lam, ..) from (key, size, n) and (key, source_size, docs, target)."""
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    top = F.lit(50.0) * F.col("mean")  # there a document of one word has long reached ``most``
    full = F.col("target") >= F.col("source_size") * float(most)
    state = sources.select("key", "source_size", "target", mean.alias("mean"))
    state = state.select("*", F.when(full, top).otherwise(0.0).alias("lam"), (-top).alias("lo"), top.alias("hi"), full.alias("done"))
    held = Staged(state, "multipliers")
    for _ in range(STEPS):
        if held.df().where("not done").isEmpty():
            break
        new = Staged(newton_step(hist, held.df(), most), "multipliers")
        held.drop()
        held = new
    return held.df()


def _fold(sizes: Column, left: Column) -> Column:
    """Copies for each of ``sizes`` (size, n, rate, want, most; largest first): each takes up what ``left`` is owed so far."""

    def one(state: Column, h: Column) -> Column:
        owed = state["left"] + h["want"] * h["size"]
        k = F.when(h["size"] == 0, h["want"]).otherwise(F.least(F.greatest(F.round(owed / F.greatest(h["size"], F.lit(1))), F.lit(0.0)), h["most"].cast("double")))
        return F.transform(F.array(k.cast("long")), lambda k: F.struct((owed - k * h["size"]).alias("left"), F.concat(state["out"], F.array(k)).alias("out")))[0]

    return F.aggregate(sizes, F.struct(left.alias("left"), F.array().cast("array<bigint>").alias("out")), one)["out"]


def rounded(hist: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """(key, source_size, target, size, n, rate, k): ``k`` whole copies for the ``n`` documents of each size of a source.

    From the largest size down, a size takes one copy more whenever the fractions so far pass another half.  What that
    leaves of the target is made up by ``MENDERS`` sizes of each octave, those of most documents: from the largest of these
    down, each takes the copies that bring the total nearest to what it should be so far.  A source's rows meet in one
    task: as many as it has different sizes, and one array of some hundred entries.
    """
    s = hist.join(state.select("key", "source_size", "target", "mean", "lam"), "key")
    s = s.withColumn("rate", _rate(F.col("lam"), F.col("size"), F.col("mean"), most)).withColumn("most", F.col("n") * int(most))
    s = s.withColumn("want", F.least(F.when(F.col("size") == 0, F.col("n").cast("double")).otherwise(F.col("n") * F.col("rate")), F.col("most").cast("double")))
    common = Window.partitionBy("key", F.floor(F.log2(F.col("size") + 0.5))).orderBy(F.desc("n"), "size")
    s = Staged(s.withColumn("mends", F.row_number().over(common) <= MENDERS), "sizes").df()
    rest = s.where("not mends").withColumn("whole", F.floor(F.col("want") + 1e-9)).withColumn("part", F.greatest(F.col("want") - F.col("whole"), F.lit(0.0)))
    rest = rest.withColumn("upto", F.sum("part").over(Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)))
    rest = rest.withColumn("k", F.least(F.col("whole") + F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5), F.col("most")))
    rest = Staged(rest.select("key", "source_size", "target", "size", "n", "rate", "want", "k"), "rest").df()
    left = rest.groupBy("key").agg(F.sum((F.col("want") - F.col("k")) * F.col("size")).alias("left"))
    menders = s.where("mends").groupBy("key", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate", "want", "most")), asc=False).alias("h"))
    menders = menders.join(left, "key", "left").withColumn("k", _fold(F.col("h"), F.coalesce("left", F.lit(0.0))))
    menders = menders.select("key", "source_size", "target", F.explode(F.arrays_zip("h", "k")).alias("x")).select("key", "source_size", "target", "x.h.size", "x.h.n", "x.h.rate", "x.k")
    return rest.drop("want").unionByName(menders)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Source key, size, hash and block of each row."""
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    h = F.xxhash64(F.col(id_col).cast("long"), text)
    return [
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("key"), token_size(text).alias("size"), h.alias("hash"),
        F.shiftrightunsigned(h, 54).cast("int").alias("block"),
    ]


def _copies(rows: DataFrame, sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``rows`` (key, size, hash, block, ..) with source_size, target, rate and copies; ``sizes`` has their keys as a table."""
    counts = Staged(sizes.groupBy("key", "size", "block").count(), "counts").df()
    hist = Staged(counts.groupBy("key", "size").agg(F.sum("count").alias("n")), "histogram").df()
    name = F.when(F.col("key") != "-", F.expr("substring(key, 2)"))
    sources = Staged(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")), "sources").df()
    targets = source_targets(sources.select(name.alias("source"), "source_size"), weights, share, most)
    targets = targets.select(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")).alias("key"), "target")
    state = multipliers(hist, sources.join(targets, "key"), most)
    groups = Staged(rounded(hist, state, most), "rounded").df()
    before = Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "size", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")).join(groups.hint("merge"), ["key", "size"])
    out = rows.withColumn("at", F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("hash")) - 1).join(offsets.hint("merge"), ["key", "size", "block"])
    whole = F.floor(F.col("k") / F.col("n"))
    return out.withColumn("copies", (whole + (F.col("offset") + F.col("at") < F.col("k") - whole * F.col("n")).cast("long")).cast("int"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row for each row of ``docs``.

    ``size`` counts the words of the text; ``copies`` (0 to ``most``) is how often the mix takes the document, and
    ``taken`` the words that it so takes.  Targets: see :func:`source_targets`.  Which documents of equal source and
    size get one copy more is settled by a hash of id and text, so reruns agree.

    Null and empty texts have no words, and one copy.  A null source is a source of its own, the last.  Rows that repeat
    count each.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *_keyed(docs, id_col, text_col, source_col))
    d = Staged(d, "sizes").df()
    out = _copies(d, d, weights, share, most)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, each as often as :func:`mix_sources` takes it.

    Rows that repeat are taken each by itself, so the mix meets its targets whatever ids they share.
    """
    d = docs.select(F.struct(*docs.columns).alias("row"), *_keyed(docs, id_col, text_col, source_col))
    out = _copies(d, Staged(d.drop("row"), "sizes").df(), weights, share, most).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
