"""Mixing sources to target weights by Pareto order sampling (native).

A document expects copies in proportion to its words ** TILT, at most CAP of them, so that a source's expected words are its
target: longer documents are somewhat likelier.  The whole part of that is certain; for the rest documents are ranked by the
odds of a random number divided by the odds of their own inclusion, and the head of that ranking is taken until the source's
words are full; documents after it that fit into what is left are taken in rank order, until none fits.  Ranks come from a
histogram of the ranking key, so no task sees a whole source.

Defined results: null text has size 0, and documents without words are never taken; null source is a source of its own, last in order; identical rows (same doc_id and
text) stand or fall together; an empty table gives an empty result; other columns are carried by `mix` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, word_count

#: Weights of the sources, words of the mixture as a share of all, and most copies of a source's words and of a document.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: How much likelier long documents are: odds go with words ** TILT; 0 treats all alike.
TILT = 0.25
#: Histogram cells of the ranking key in each source; tasks that rank see about size / CELLS documents of a source.
CELLS = 4096
#: Documents after a cut that are tried one by one in a round; the next round cuts among those behind them that still fit.
FILL = 64
#: Up to so many rounds of all sources (at most FILL keys of 24 bytes each) are broadcast: 8 MB at most.
BROADCAST_ROUNDS = 5000


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _uniform(doc: Column, text: Column, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc, text), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source_size) -> target for each source: weights in source order, repeating; filled by weight up to cap x size.

    One row per source, so its windows run in one task: the sources are what a mixture lists by hand.
    """
    in_order = Window.orderBy(F.when(F.col("skey") == "n", 1).otherwise(0), "skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    # Water filling: sources that meet their cap are a prefix in the order of cap / weight.
    order = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "skey", "level"))).over(every)["level"])
    return rows.select("skey", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _sized(docs: DataFrame, source: str, text: str, seed: int) -> DataFrame:
    return docs.select("doc_id", _key(source).alias("skey"), word_count(F.col(text)).alias("size"), _uniform(F.col("doc_id"), F.col(text), seed).alias("u"))


def _rank(u: Column, rest: Column) -> Column:
    """Pareto key x = odds(u) / odds(inclusion), as x / (1 + x): 0.5 is where fixed sizes cut in the limit."""
    x = u / (1 - u) * (1 - rest) / rest
    return F.when(rest > 0, x / (1 + x)).otherwise(F.lit(1.0))


def _place() -> Column:
    return F.struct("v", "doc_id", "size")


def _cell(v: Column) -> Column:
    return F.least(F.floor(v * CELLS), F.lit(CELLS - 1)).cast("int")


def _round(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """state (skey, gap, after) -> (skey, gap, after, first_cell, last_place, fillers, left, tried) by source that has candidates.

    Candidates lie behind `after` and fit into the gap alone.  Those before first_cell or up to last_place are taken, all of
    them where first_cell is null, and so are the fillers; left is the gap then, tried the last document looked at.
    """
    rows = ranked.join(state, "skey").where((F.col("size") <= F.col("gap")) & (F.col("after").isNull() | ((_place() > F.col("after")) & (F.col("size") > 0))))
    upto = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("gap").alias("gap"))
    cells = cells.withColumn("sum_words", F.sum("words").over(upto)).withColumn("sum_n", F.sum("n").over(upto))
    cut = cells.groupBy("skey").agg(
        F.min(F.when(F.col("sum_words") > F.col("gap"), F.struct("cell", (F.col("sum_words") - F.col("words")).alias("before"), "sum_n"))).alias("c"),
        F.sort_array(F.collect_list(F.struct("sum_n", "cell"))).alias("all"),
    )
    # The cells of the cut and of the next FILL documents.
    last = F.element_at(F.filter("all", lambda x: x["sum_n"] >= F.least(F.col("c.sum_n") + FILL, F.element_at("all", -1)["sum_n"])), 1)["cell"]
    cut = staged(cut.select("skey", F.col("c.cell").alias("first_cell"), F.when(F.col("c").isNotNull(), last).alias("last_cell"), F.col("c.before").alias("before")).coalesce(1), "mix-cut")
    near = rows.join(cut.where("first_cell is not null"), "skey").where(F.col("cell").between(F.col("first_cell"), F.col("last_cell")))
    near = near.groupBy("skey", "v", "doc_id", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    order = Window.partitionBy("skey").orderBy("v", F.col("doc_id").asc_nulls_first(), "size")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("rk", F.row_number().over(order)).withColumn("run", F.col("before") + F.sum("words").over(sofar))
    near = near.withColumn("head", F.col("run") <= F.col("gap"))
    near = near.withColumn("late", F.col("rk") - F.sum(F.col("head").cast("int")).over(sofar))
    cuts = near.groupBy("skey").agg(
        F.first("gap").alias("gap"),
        F.first("before").alias("before"),
        F.max(F.when(F.col("head"), F.struct("rk", "run", _place().alias("place")))).alias("head"),
        F.sort_array(F.collect_list(F.when(~F.col("head") & (F.col("late") <= FILL), F.struct("rk", "words", _place().alias("place"))))).alias("tail"),
    )
    kind = near.select(_place().alias("x")).schema["x"].dataType.simpleString()
    start = F.struct((F.col("gap") - F.coalesce(F.col("head.run"), F.col("before"))).cast("double").alias("gap"), F.array().cast(f"array<{kind}>").alias("got"))
    fits = lambda a, x: F.struct((a["gap"] - x["words"]).alias("gap"), F.concat(a["got"], F.array(x["place"])).alias("got"))
    filled = F.aggregate("tail", start, lambda a, x: F.when(x["words"] <= a["gap"], fits(a, x)).otherwise(a))
    cuts = cuts.select("skey", F.col("head.place").alias("last_place"), filled["got"].alias("fillers"), filled["gap"].alias("left"), F.element_at("tail", -1)["place"].alias("tried"))
    found = state.join(cut.select("skey", "first_cell"), "skey").join(cuts, "skey", "left")
    return staged(found.coalesce(1), "mix-round")


def _expected(size: Column, cap: Column) -> Column:
    """Copies that a document expects; without a scale, the most."""
    return F.when(size > 0, F.least(cap, F.coalesce(F.col("scale") * F.pow(size, F.lit(TILT)), cap))).otherwise(F.lit(0.0))


def _scales(sources: DataFrame, by_size: DataFrame, cap: float) -> DataFrame:
    """sources get scale: expected copies of a document of one word, such that a source's expected words are its target.

    by_size has a row per source and size, n documents each; a source's sizes are sorted in one task, its documents aren't.
    Documents that come to the cap are the longest of their source, so the scale is that of the first size that doesn't.
    """
    order = Window.partitionBy("skey").orderBy(F.desc("size"))
    rows = by_size.where("size > 0").join(sources.where(F.col("target") < F.col("source_size") * cap * (1 - 1e-12)), "skey")
    words, each = F.col("n") * F.col("size"), F.pow(F.col("size"), F.lit(TILT))
    longer = F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("target") - cap * longer) / F.sum(words * each).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("skey", "size", level.alias("level")).where(F.col("level") * each <= cap * (1 + 1e-12))
    return sources.join(rows.groupBy("skey").agg(F.max(F.struct("size", "level"))["level"].alias("scale")), "skey", "left")


def plan(base: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: target, scale, the words open after certain copies, and the rounds in which documents get one copy more."""
    by_size = staged(base.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-by-size")
    sources = source_targets(by_size.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    sources = _scales(sources, by_size, cap)
    each = _expected(F.col("size"), F.lit(cap))
    certain = by_size.join(sources, "skey").groupBy("skey").agg(F.sum(F.floor(each) * F.col("size") * F.col("n")).alias("certain"))
    sources = sources.join(certain, "skey").withColumn("open", F.col("target") - F.col("certain"))
    sources = staged(sources.withColumn("cap", F.lit(cap)).coalesce(1), "mix-sources")
    ranked = base.join(sources.where("open > 0").select("skey", "scale", "cap"), "skey")
    each = _expected(F.col("size"), F.col("cap"))
    ranked = ranked.withColumn("rest", each - F.floor(each)).where("rest > 0")
    ranked = ranked.select("skey", "doc_id", "size", _rank(F.col("u"), F.col("rest")).alias("v"))
    kind = ranked.select(_place().alias("x")).schema["x"].dataType.simpleString()
    ranked = ranked.withColumn("cell", _cell(F.col("v")))
    state = sources.where("open > 0").select("skey", F.col("open").cast("double").alias("gap"), F.lit(None).cast(kind).alias("after"))
    rounds = None
    while True:  # each round ends behind where it began, and only sources with a document that fits go on
        found = _round(ranked, state)
        rounds = found if rounds is None else rounds.unionByName(found)
        state = found.where("tried is not null and left >= 1").select("skey", F.col("left").alias("gap"), F.col("tried").alias("after"))
        if state.isEmpty():
            break
    rounds = rounds.groupBy("skey").agg(F.collect_list(F.struct("gap", "after", "first_cell", "last_place", "fillers")).alias("rounds"))
    return staged(sources.join(rounds, "skey", "left").coalesce(1), "mix-plan")


def _copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows with skey, doc_id, size and u get source_size, target and copies."""
    small = (decided.agg(F.sum(F.greatest(F.size("rounds"), F.lit(1)))).first()[0] or 0) <= BROADCAST_ROUNDS
    rows = rows.join(F.broadcast(decided) if small else decided, "skey")
    each = _expected(F.col("size"), F.col("cap"))
    rest = each - F.floor(each)
    v = _rank(F.col("u"), rest)
    place = F.struct(v.alias("v"), F.col("doc_id"), F.col("size"))
    falls = lambda c: F.coalesce(c, F.lit(False))

    def taken(x: Column) -> Column:
        candidate = (F.col("size") <= x["gap"]) & (x["after"].isNull() | ((place > x["after"]) & (F.col("size") > 0)))
        return candidate & (x["first_cell"].isNull() | (_cell(v) < x["first_cell"]) | falls(place <= x["last_place"]) | falls(F.array_contains(x["fillers"], place)))

    more = falls(F.exists("rounds", taken))
    return rows.withColumn("copies", F.floor(each) + F.when((rest > 0) & more, 1).otherwise(0))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken (size x copies)."""
    base = staged(_sized(docs, source, text, seed), "mix-sizes")
    out = _copies(base, plan(base, weights, share, cap))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """The documents themselves, each as many times as the mixture takes it, with all their columns."""
    base = staged(_sized(docs, source, text, seed), "mix-sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _key(source).alias("skey"), word_count(F.col(text)).alias("size"), _uniform(F.col("doc_id"), F.col(text), seed).alias("u"))
    rows = _copies(rows, plan(base, weights, share, cap)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
