"""Mixing sources to target weights by capped water-filling.

Every source gets its share of the budget by weight; a source above its cap (a number of epochs of its
own size) is clamped there and the excess is shared by the others in proportion to their weights, until
none is above. A source's rows are then repeated: a whole number of times each, and once more for a
seeded selection of rows whose sizes add up to the remaining fraction.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import global_positions
from .shared import discard, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: A table of so many sources is small enough to be broadcast; a larger one is joined by source.
FEW_SOURCES = 100_000
#: So many rows at the edge of a source's selection are added up in one task.
FEW_ROWS = 10_000
DIGITS = 3  # hex digits of the random place by which an edge is narrowed at a time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same_source() -> Column:
    return F.col("source").eqNullSafe(F.col("_source"))


def water_fill(sources: DataFrame, budget: Fraction, epochs: int) -> DataFrame:
    """``sources`` (_source, n, w) with ``target``: shares of ``budget`` by weight, none above ``epochs`` times its size.

    A round clamps every free source whose share is above its cap; what is left is shared by the others in the next. Only
    the totals of a round come to the driver, as whole numbers, so the number of sources is not limited."""
    cap = F.col("n").cast("decimal(38,0)") * epochs
    left, state = Fraction(budget), sources.withColumn("full", F.lit(False))
    while True:
        weight = state.filter("not full").agg(F.sum("w")).first()[0]
        if not weight:
            share = F.lit(0.0)
            break
        above = ~F.col("full") & (F.lit(left.numerator).cast("decimal(38,0)") * F.col("w") > cap * F.lit(left.denominator * int(weight)).cast("decimal(38,0)"))
        taken = state.filter(above).agg(F.sum(cap)).first()[0]
        if taken is None:
            share = F.lit(left.numerator).cast("double") * F.col("w") / F.lit(float(left.denominator * int(weight)))
            break
        left -= int(taken)
        after = written(state.withColumn("full", F.col("full") | above), "mix-round")
        if state is not sources:
            discard(state)
        state = after
    return state.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(share)).drop("full")


def with_draws(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """``docs`` with ``_draw``, a row's place in the random order of its source; the same on every run and engine.

    The key and the seed decide it. Rows without a key are drawn by their text, and equal ones among them by number: they
    are numbered within the tasks that read them, and tasks one after another, so the places are the same whichever row gets which."""
    named = docs.withColumn("_draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    loose = docs.filter(F.col(key).isNull())
    if loose.isEmpty():
        return named
    # written, so that counts and numbers see one and the same dealing of rows to tasks
    told = written(loose.withColumns({"_digest": F.md5(F.coalesce(F.col(text), F.lit(""))), "_task": F.spark_partition_id()}), "mix-loose")
    counts = told.groupBy("_digest", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_digest").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_digest").alias("_of"), F.col("_task").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_digest", "_task").orderBy("_digest"))
    drawn = told.withColumn("_nth", nth).join(offsets, (F.col("_digest") == F.col("_of")) & (F.col("_task") == F.col("_in"))).withColumn(
        "_draw", F.md5(F.concat("_digest", F.lit("#"), (F.col("_before") + F.col("_nth")).cast("string"), F.lit(f":{seed}"))))
    return named.filter(F.col(key).isNotNull()).unionByName(drawn.select(*docs.columns, "_draw"))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2),
             epochs: int = 2) -> DataFrame:
    """One row per source: ``_source``, ``source_size``, ``target``, ``_whole`` repetitions, and ``_cut``, the last
    place in random order whose rows are taken once more (null: none).

    ``sized``: (source, size, draw). Sources take ``weights`` in turn, by code point, null last. The row at which a source's
    rest is reached is found by narrowing its places digit by digit until few rows share them."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("n")).withColumn("_none", F.col("source").isNull()), "mix-sources")
    placed = global_positions(totals, ["_none", "source"], "_nth")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))
    sources = written(placed.select(F.col("source").alias("_source"), "n", turn.alias("w")), "mix-weights")
    words = sources.agg(F.sum("n")).first()[0] or 0
    filled = water_fill(sources, budget * int(words), epochs)
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("int")
    plan = written(filled.select("_source", F.col("n").alias("source_size"), "target", whole.alias("_whole"),
                                 (F.col("target") - whole * F.col("n")).alias("_rest")), "mix-targets")
    # (source, digits so far, words before them, rest): where the rest is reached, narrowed until few rows are left
    edge, depth = plan.filter("_rest > 0").select("_source", F.lit("").alias("_digits"), F.lit(0).cast("long").alias("_before"), "_rest"), 0
    opened = edge
    while depth + DIGITS <= 32:
        depth += DIGITS
        inside = _at_edge(sized, edge, depth - DIGITS)
        parts = inside.groupBy("_source", "_before", "_rest", F.substring("draw", 1, depth).alias("_digits")).agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"))
        up = Window.partitionBy("_source").orderBy("_digits")  # at most 16 ** DIGITS rows of a source
        ends = parts.withColumn("_upto", F.col("_before") + F.sum("_n").over(up)).withColumn("_from", F.col("_upto") - F.col("_n"))
        opened = written(ends.filter((F.col("_rest") > F.col("_from")) & (F.col("_rest") <= F.col("_upto")))
                         .select("_source", "_digits", F.col("_from").alias("_before"), "_rest", "_rows"), "mix-edges")
        edge = opened.drop("_rows")
        if opened.filter(F.col("_rows") > FEW_ROWS).isEmpty():
            break
    inside = _at_edge(sized, edge, depth).groupBy("_source", "draw", "_before", "_rest").agg(F.sum("size").alias("_n"))
    along = Window.partitionBy("_source").orderBy("draw")
    taken = (
        inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(along))
        .filter(F.col("_upto") - F.col("_n") / 2 <= F.col("_rest"))  # the middle of its words lies before the end
        .groupBy("_source").agg(F.max("draw").alias("_last"))
    )
    first = edge.select("_source", F.col("_digits").alias("_open"))
    return (
        plan.alias("p").join(first.alias("e"), F.expr("p._source <=> e._source"), "left")
        .join(taken.alias("t"), F.expr("p._source <=> t._source"), "left")
        # without a row inside its places, everything before them is taken
        .select("p._source", "source_size", "target", "_whole", F.coalesce("_last", "_open").alias("_cut"))
    )


def _at_edge(sized: DataFrame, edge: DataFrame, depth: int) -> DataFrame:
    """Rows of the sources in ``edge`` whose places begin with its digits; it has one row per source."""
    few = edge.count() <= FEW_SOURCES
    here = _same_source() & (F.substring("draw", 1, depth) == F.col("_digits")) if depth else _same_source()
    return sized.join(F.broadcast(edge) if few else edge, here)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
                **settings) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): one row per document with ``key``, ``source``, ``size``, ``draw``, and the plan of ``plan_mix``.

    * size is the number of words; a null text has none, and its row is repeated like others of its place
    * null sources form one source, the last; a source without words has target 0; any number of sources is mixed
    * rows with the same key have the same place in the random order and are taken together; rows without a key have
      places of their own, equal ones too
    * an empty table gives an empty plan; other columns play no part
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    sized = written(with_draws(rows, "key", "text", seed).select(
        "key", "source", word_count(F.col("text")).alias("size"), F.col("_draw").alias("draw")), "mix-sizes")
    return sized, written(plan_mix(sized, **settings), "mix-plan")


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with a ``source``, joined to its plan: broadcast if it has few sources, else by source."""
    return rows.join(F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan, _same_source())


def copies() -> Column:
    """How often a row joined to its source's plan is taken."""
    return F.col("_whole") + F.when(F.col("draw") <= F.col("_cut"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
                    **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the mix takes it."""
    _, plan = mix_sources(docs, key, text, source, seed, **settings)
    every = F.struct(*docs.columns).alias("_row")
    rows = with_draws(docs.select(every, F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(source).cast("string").alias("source")), "_id", "_text", seed)
    repeated = planned(rows.withColumnRenamed("_draw", "draw"), plan).withColumn("_copies", copies()).filter("_copies > 0")
    return repeated.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
