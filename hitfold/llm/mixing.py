"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a token target. Among all document rates between 0 and ``most`` that meet it, the
ones closest in relative entropy to taking every document once are ``min(most, exp(l * size / mean))``, with
one multiplier ``l`` a source: the solution of a convex dual. Newton steps find all multipliers together;
a step is one aggregation over the distinct (source, size) cells, never over documents or texts. Rates are rounded into whole copies
along falling size, so the error of a source is first of the order of one document, and is then paid
back with documents of ever smaller size classes.

Sums that decide anything are integers, so reruns agree whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitfold.llm.common import WORD_PATTERN, documents, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix against all sizes; most copies of a document.
SHARE, MOST = 1.5, 2
#: Documents of one (source, size) are dealt into this many parts, so that copies of one text don't meet in one task.
SALTS = 256
#: Unit of a rate, as a power of two: rates are rounded to it before they are summed.
UNIT = 1 << 20
STEPS, TOLERANCE = 60, 1e-6


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by weight, none above ``most`` times the source, the excess reshared.

    ``sources`` has one row a source (source, source_size). Sources sorted by cap per weight fill in this order, so two
    running sums find who is capped; the others share the rest by weight. A total of zero gives zero targets.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0))
    free = F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("capped", F.col("ratio") <= left / free)
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("free")))
        .select("source", "source_size", "target")
    )


def multipliers(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """The dual solution: (source, mean, l), by Newton steps kept inside a bracket that every step narrows.

    ``cells`` has (source, size, n), ``goals`` (source, source_size, target). Sources at their cap or without words are set directly.
    """
    mean = F.col("source_size") / F.greatest(F.col("rows"), F.lit(1))
    rows = cells.filter("size > 0").groupBy("source").agg(F.sum("n").alias("rows"))
    state = written(
        goals.alias("g").join(rows.alias("r"), F.expr("g.source <=> r.source"), "left")
        .select("g.source", "source_size", "target", F.coalesce("rows", F.lit(0)).alias("rows"))
        .select(
            "source", "target", mean.alias("mean"), F.lit(0.0).alias("l"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            ((F.col("target") >= F.col("source_size") * most) | (F.col("target") <= 0)).alias("still"),
        ),
        "dual",
    )
    tilt = F.exp(F.col("l") * F.col("size") / F.col("mean"))
    for _ in range(STEPS):
        sums = (
            cells.filter("size > 0").alias("c").join(state.filter("NOT still").alias("s"), F.expr("c.source <=> s.source"))
            .select(F.col("s.source").alias("source"), "n", "size", "mean", F.least(tilt, F.lit(float(most))).alias("w"), (tilt < most).alias("bends"))
            .groupBy("source")
            .agg(
                (F.sum(F.round(F.col("n") * F.col("size") * F.col("w") * 1024).cast("long")) / 1024.0).alias("have"),
                F.sum(F.when(F.col("bends"), F.round(F.col("n") * F.col("size") * (F.col("size") / F.col("mean")) * F.col("w")).cast("decimal(38,0)"))).cast("double").alias("slope"),
            )
        )
        off = F.col("have") - F.col("target")
        stepped = (
            state.alias("s").join(sums.alias("f"), F.expr("s.source <=> f.source"), "left")
            .select(
                "s.source", "target", "mean", "l", "have", "slope", "still",
                F.when(off < 0, F.col("l")).otherwise(F.col("low")).alias("low"),
                F.when(off > 0, F.col("l")).otherwise(F.col("high")).alias("high"),
                off.alias("off"),
            )
            .withColumn("newton", F.col("l") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope")))
            .withColumn("inside", F.col("newton").isNotNull() & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("high").isNull() | (F.col("newton") < F.col("high"))))
            .withColumn(
                "next",
                F.when(F.col("inside") & (F.abs(F.col("newton") - F.col("l")) <= 8.0), F.col("newton"))
                .when(F.col("high").isNull(), F.col("l") + 8.0)
                .when(F.col("low").isNull(), F.col("l") - 8.0)
                .otherwise((F.col("low") + F.col("high")) / 2),
            )
            .withColumn("done", F.col("still") | F.col("off").isNull() | (F.abs("off") <= F.greatest(F.col("target") * TOLERANCE, F.lit(1.0))))
            .select("source", "target", "mean", F.when(F.col("done"), F.col("l")).otherwise(F.col("next")).alias("l"), "low", "high", F.col("done").alias("still"))
        )
        state = written(stepped, "dual")
        if not state.filter("NOT still").limit(1).count():
            break
    return state.select("source", "mean", "l")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Copies of each document: (doc_id, source, size, source_size, target, rate, copies, taken).

    ``docs`` has doc_id, text and source; other columns are not read. Repeated rows are documents of their own, a
    null text has size 0 and is never taken, a null source is one source, and an empty table gives no rows.
    """
    own = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SALTS)).cast("int")),
        "sizes",
    )
    salted = written(own.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m")), "cells")
    cells = written(salted.groupBy("source", "size").agg(F.sum("m").alias("n")), "cells")
    goals = written(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "goals")
    dual = multipliers(cells, goals, most)

    rate = (
        F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most)))
        .when((F.col("target") <= 0) | (F.col("size") == 0), F.lit(0.0))
        .otherwise(F.least(F.exp(F.col("l") * F.col("size") / F.col("mean")), F.lit(float(most))))
    )
    falling = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = (
        cells.alias("c").join(goals.alias("g"), F.expr("c.source <=> g.source")).join(dual.alias("d"), F.expr("c.source <=> d.source"))
        .select("c.source", "size", "n", "source_size", "target", rate.alias("rate"))
        .withColumn("units", F.round(F.col("rate") * UNIT).cast("long") * F.col("n"))
        .withColumn("upto", F.sum("units").over(falling) + UNIT // 2)
        .withColumn("copies", F.expr(f"upto div {UNIT} - (upto - units) div {UNIT}"))
    )
    rated = written(rated.drop("units", "upto"), "cells")
    paid = settle(rated, most)
    shares = (
        rated.alias("c").join(paid.alias("p"), F.expr("c.source <=> p.source AND c.size = p.size"), "left")
        .select("c.source", "c.size", "n", "source_size", "target", "rate", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))
        .withColumn("each", F.expr("copies div n"))
        .withColumn("extra", F.expr("copies % n"))
    )
    # the extra copies of a cell over its salts, in proportion to their documents
    upto = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    dealt = (
        salted.alias("a").join(shares.alias("c"), F.expr("a.source <=> c.source AND a.size = c.size"))
        .select("a.source", "a.size", "salt", "m", "n", "source_size", "target", "rate", "each", "extra")
        .withColumn("seen", F.sum("m").over(upto))
        .withColumn("here", F.expr("CAST(seen AS DECIMAL(19,0)) * extra div n - CAST(seen - m AS DECIMAL(19,0)) * extra div n"))
    )
    inside = Window.partitionBy("o.source", "o.size", "o.salt").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    return (
        own.alias("o").join(dealt.alias("d"), F.expr("o.source <=> d.source AND o.size = d.size AND o.salt = d.salt"))
        .withColumn("copies", F.col("each") + (F.row_number().over(inside) <= F.col("here")).cast("long"))
        .select("doc_id", "o.source", "o.size", "source_size", "target", "rate", "copies", (F.col("o.size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, perhaps not at all; columns are unchanged.

    Rows that repeat a doc_id are told apart by size and source, so that each gets the copies of a row like it.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    turn = Window.partitionBy("__llm_key").orderBy("__llm_size", F.col("source").asc_nulls_last())
    left = docs.withColumn("__llm_key", key).withColumn("__llm_size", word_count(F.col("text"))).withColumn("__llm_turn", F.row_number().over(turn))
    right = mix(docs, weights, share, most).select(key.alias("__llm_key"), F.col("size").alias("__llm_size"), "source", "copies").withColumn("__llm_turn", F.row_number().over(turn))
    return (
        left.join(right.filter("copies > 0").select("__llm_key", "__llm_turn", F.col("copies").alias("__llm_copies")), ["__llm_key", "__llm_turn"])
        .withColumn("__llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_copies"))))
        .select(*docs.columns)
    )


def settle(cells: DataFrame, most: int = MOST) -> DataFrame:
    """Copies to add or take back, (source, size, more), so that each source meets its target to about half its smallest document.

    One cell stands for each power-of-two size class of a source, the one with the most documents; the error is paid from the
    largest class down, at most 63 steps over one short array a source.
    """
    miss = cells.groupBy("source").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
    stand = (
        cells.filter("size > 0").groupBy("source", F.floor(F.log2("size")).alias("class"))
        .agg(F.max_by(F.struct("size", "n", "copies"), F.struct("n", -F.col("size"))).alias("c"))
        .groupBy("source").agg(F.sort_array(F.collect_list("c"), False).alias("cells"))
    )

    def pay(state: Column, cell: Column) -> Column:
        want = F.round(state["miss"] / cell["size"]).cast("long")
        more = F.greatest(-cell["copies"], F.least(want, cell["n"] * most - cell["copies"]))
        return F.struct(
            (state["miss"] - more * cell["size"]).alias("miss"),
            F.concat(state["paid"], F.array(F.struct(cell["size"].alias("size"), more.alias("more")))).alias("paid"),
        )

    start = F.struct(F.col("miss"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("paid"))
    return (
        miss.alias("m").join(stand.alias("s"), F.expr("m.source <=> s.source"))
        .select("m.source", F.explode(F.aggregate("cells", start, pay)["paid"]).alias("p"))
        .select("source", "p.size", "p.more").filter("more <> 0")
    )


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: size, target of the source and words taken of each."""
    return mix(documents(spark, sf_dir, "doc_id", "text", "source"))
