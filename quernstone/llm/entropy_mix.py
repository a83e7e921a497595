"""Mixing sources to target weights by entropy balancing.

Documents get rates, as near to 1 as relative entropy allows, under one constraint a
source: the words taken are the source's target. The dual is convex with one
multiplier a source, and a document's rate is exponentially tilted by its size:

    rate = min(cap, exp(multiplier * size / mean size of the source))

Newton steps on the multipliers run on aggregates of all documents: rates depend on
source and size alone, so a table of (source, size, documents) is the whole of the
data, and each step sums gradient and curvature of every source over it. Steps that
leave the bracket known so far are replaced by halving it.

Rates become copies: a document has the whole part of its rate, and some documents of
a size have one more. How many is carried from size to size, largest first, so that
the words taken stay within about half a small document of the target; which ones
follows from a hash of the row, so reruns agree.

Defined cases: sizes are words; a null text has 0 and is taken as often as others of
size 0, which adds no words. A null source is a source, the last. Sources without
words have target 0 and multiplier 0. Repeated rows are documents of their own. An
empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, CAP = (5, 2, 1), 3.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last.

    A source's share of all words stops at `cap` times its own; the excess goes to
    the others by weight. Sources fill in the order of what they hold for their
    weight, so the sources at their cap are a prefix of that order: the longest
    whose every source still fills at the rate that those before it leave.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(fill), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)),
        }
    )
    full = F.col("limit") * F.col("open") <= F.col("left") * F.col("weight")
    rows = rows.withColumn("full", full)
    # What the first source below its cap finds is what all such sources share.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "left", "open"))).over(everything)
    share = F.col("weight") * first["left"] / first["open"]
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(share).cast("double").alias("target"))


def multipliers(tables: common.Scratch, cells: DataFrame, goals: DataFrame, cap: float = CAP, close: float = 1e-6, most: int = 400) -> DataFrame:
    """source and multiplier, by Newton steps over `cells` (source, size, n).

    A source whose target is its words times the cap has rate `cap` throughout: its
    multiplier is infinite. Each other one is stepped until its words are within `close`
    of its target, as a share, or its bracket has no number in between; a step doubles the
    multiplier at most, so a bracket is found and halved in far fewer than `most` turns,
    and reaching them is an error. Sources are a table too; nothing of them but how many
    are open reaches the driver.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    plain = (F.col("source_size") <= 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = goals.join(mean, goals["source"].eqNullSafe(mean["source"])).select(
        goals["source"],
        "source_size",
        "target",
        "mean",
        F.when(plain, F.when(F.col("source_size") <= 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(0.0).alias("multiplier"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        plain.alias("done"),
    )

    def step(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        table = tables.table(rows.observe(seen, F.count_if(~F.col("done")).alias("open")), "newton")
        return table, seen.get["open"]

    state, left = step(state)
    lean = cells.where("size > 0")
    turn = 0
    while left:
        if turn == most:
            raise RuntimeError(f"{left} sources have no multiplier after {most} steps")
        turn += 1
        at = state.where("not done").select(F.col("source").alias("s"), "mean", "multiplier")
        tilted = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(60.0)))
        words = F.col("size") * F.col("n")
        sums = (
            lean.join(at, lean["source"].eqNullSafe(at["s"]))
            .groupBy("s")
            .agg(F.sum(words * F.least(tilted, F.lit(cap))).alias("taken"), F.sum(F.when(tilted < cap, words * tilted * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        joined = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        gap, old = F.col("taken") - F.col("target"), F.col("multiplier")
        low, high = F.when(gap < 0, old).otherwise(F.col("low")), F.when(gap > 0, old).otherwise(F.col("high"))
        reach = F.greatest(F.abs(old), F.lit(2.0))  # how far a step may go where the bracket has no end
        newton = old - F.least(F.greatest(F.coalesce(F.try_divide(gap, F.col("slope")), F.lit(0.0)), -reach), reach)
        inside = (newton > low) & (newton < high)
        halved = (F.greatest(low, old - reach) + F.least(high, old + reach)) / 2
        new = F.when(inside, newton).otherwise(halved)
        stuck = (new == old) | (new == low) | (new == high)
        done = F.col("done") | F.coalesce((F.abs(gap) <= close * F.col("target")) | stuck, F.lit(True))
        kept = lambda c, moved: F.when(F.col("done"), F.col(c)).otherwise(moved).alias(c)
        state, left = step(joined.select("source", "source_size", "target", "mean", F.when(done, old).otherwise(new).alias("multiplier"), kept("low", low), kept("high", high), done.alias("done")))
    return state.select("source", "source_size", "target", "mean", "multiplier")


def whole_copies(cells: DataFrame, duals: DataFrame, cap: float = CAP, block: int = 256) -> DataFrame:
    """source, size, n, base, extra: each of n documents has `base` copies, `extra` of them one more.

    The words that whole copies leave over are carried through a source's sizes, the
    largest first, block by block. A source's sizes are as many as texts have different
    lengths, at most about the root of twice its words and not as many as it has
    documents, so they fit in one row.
    """
    rate = F.when(F.col("multiplier") == float("inf"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("multiplier") * F.col("size") / F.greatest("mean", F.lit(1e-9)), F.lit(60.0)))))
    rated = cells.join(duals.withColumnRenamed("source", "s"), cells["source"].eqNullSafe(F.col("s"))).withColumn("rate", rate)
    base = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(cap))).cast("bigint")
    part = F.greatest(F.col("rate") - base, F.lit(0.0))
    listed = rated.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n", base.alias("base"), part.alias("part"))), asc=False).alias("cells"))

    def carry(acc: F.Column, cell: F.Column) -> F.Column:
        want = cell["part"] * cell["n"] * cell["size"] + acc["owed"]
        room = F.when(cell["base"] >= int(cap), F.lit(0)).otherwise(cell["n"])
        extra = F.when(cell["size"] > 0, F.least(F.greatest(F.round(want / cell["size"]), F.lit(0.0)), room.cast("double"))).otherwise(0.0).cast("bigint")
        return F.struct((want - extra * cell["size"]).cast("double").alias("owed"), F.concat(acc["extras"], F.array(extra)).alias("extras"))

    none = F.array().cast("array<bigint>")

    def carried(acc: F.Column, cells: F.Column) -> F.Column:
        """One block after another, so that no list grows by single values beyond a block."""
        one = F.aggregate(cells, F.struct(acc["owed"].alias("owed"), none.alias("extras")), carry)
        return F.struct(one["owed"].alias("owed"), F.concat(acc["blocks"], F.array(one["extras"])).alias("blocks"))

    starts = F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda i: F.slice("cells", i * block + 1, F.lit(block)))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<array<bigint>>").alias("blocks"))
    extras = F.flatten(F.aggregate(blocks, start, carried, lambda acc: acc["blocks"]))
    zipped = listed.select("source", F.explode(F.arrays_zip("cells", extras.alias("extras"))).alias("c"))
    cell = F.col("c")["cells"]
    return zipped.select("source", cell["size"].alias("size"), cell["n"].alias("n"), cell["base"].alias("base"), F.col("c")["extras"].alias("extra"))


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt_rows: int = 20_000) -> DataFrame:
    """A row for every document: id, at_file, at_row, source, size, source_size, target, copies.

    Documents of one source and size are ranked in pieces of about `salt_rows` or fewer.
    """
    tables = common.Scratch(spark, "mix")
    rows = common.located(spark, docs, {"id": id_col, "t": text_col, "source": source_col}, "mix-docs")
    rows = rows.select(
        "id",
        "at_file",
        "at_row",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("t", F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("id", "t").alias("mix"),
    )
    rows = tables.table(rows, "sizes")
    salts = max(64, rows.count() // salt_rows)
    rows = rows.withColumn("salt", F.pmod("mix", F.lit(salts)))
    parts = tables.table(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "parts")
    cells = tables.table(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = tables.table(targets(sizes, weights, cap), "goals")
    duals = multipliers(tables, cells, goals, cap)
    copies = whole_copies(cells, duals, cap)

    # A cell's extra copies are dealt over its salted parts in proportion, exactly; a hot cell stays spread.
    of = [parts["source"].eqNullSafe(copies["source"]), parts["size"] == copies["size"]]
    dealt = parts.join(copies, of).select(parts["source"], parts["size"], "salt", parts["n"], copies["n"].alias("all"), "base", "extra")
    seen = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt"))
    upto = F.floor(seen * F.col("extra") / F.col("all"))
    before = F.floor((seen - F.col("n")) * F.col("extra") / F.col("all"))
    dealt = tables.table(dealt.select("source", "size", "salt", "base", (upto - before).cast("bigint").alias("more")), "dealt").alias("d")
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("mix", "id", "at_file", "at_row"))
    ranked = rows.withColumn("rank", rank).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size")) & (F.col("r.salt") == F.col("d.salt"))
    out = ranked.join(dealt, same).select("r.id", "r.at_file", "r.at_row", "r.source", "r.size", (F.col("d.base") + F.when(F.col("r.rank") <= F.col("d.more"), 1).otherwise(0)).alias("copies"))
    goals = goals.withColumnRenamed("source", "s")
    tables.drop_all_but("sizes", "dealt", "goals")
    return out.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("id", "at_file", "at_row", "source", "size", "source_size", "target", "copies")


def copied(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """`docs`, each row as often as the mix takes it; columns as they are."""
    if not common._reads_files(docs):
        docs = common.written(spark, docs, "mix-docs")
    copies = common.written(spark, mixed(spark, docs, **options).where("copies <> 1").select("at_file", "at_row", "copies"), "mix-copies")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = common.located(spark, docs, dict(zip(names, docs.columns, strict=True)), "mix-docs")
    joined = rows.join(common.broadcast_if_small(copies, copies.count()), ["at_file", "at_row"], "left")
    times = F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"), F.lit(1))
    kept = joined.where(F.coalesce("copies", F.lit(1)) > 0).withColumn("copy", F.explode(times))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixed(spark, common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
