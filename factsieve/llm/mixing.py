"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality; small keys come first. A source whose
target is e whole epochs plus a rest takes every document e times, then the documents with the
smallest keys until their sizes reach the rest. ``u`` is a hash of the id, so reruns agree.

To find where the rest ends, keys are counted in slices per source and prefix-summed there; only the
one slice of each source in which the rest ends is sorted. No source is ever sorted as a whole, and
the rows themselves are never shuffled. Sizes and keys are written once beside the ids, so the texts are
read twice: for them and for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve.llm.common import WORD, Sealed, bounded, or_empty, stage

SYMBOLS = "#*$%&|<>!0123456789"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def symbol_quality(text: Column) -> Column:
    """Quality weight between 0.05 and 1: the share of characters that are no digits or junk symbols."""
    letters = F.char_length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, F.char_length(text)), F.lit(0.05)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> plus target: shares of the total by weight, at most max_epochs x size.

    Sources by code point, null last, get ``weights`` in turn. What a full source can't take is shared
    again by weight: with sources in order of size / weight, those before the first one that can take its
    share of what is left are full. Runs on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_place").asc())
    before, onward = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("_place", F.row_number().over(order)).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1)
    ).withColumn("_cap", max_epochs * F.col("source_size"))
    shared = weighed.withColumn(
        "_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
        / F.sum("_w").over(onward)
    ).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(everything)
    return shared.withColumn("_final", level).withColumn(
        "target", F.when(F.col("_final") * F.col("_w") <= F.col("_cap"), F.col("_final") * F.col("_w"))
        .otherwise(F.col("_cap").cast("double"))
    ).select("source", "source_size", "target")


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
        size_column: str | None = None, quality_column: str | None = None, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3,
        rows_per_slice: int = 1000, max_slices: int = 1 << 20) -> DataFrame:
    """All rows of ``docs`` plus size, source_size, target, taken (size x times), times.

    Sizes default to the words of the text, qualities (positive) to ``symbol_quality``. The last
    document of a rest is taken if at least half of it fits, so a source is off its target by at most
    half a document. Null text: size 0. Null quality: the least weight. Documents of size 0 take nothing.
    Null source: a source of its own, last. Ties of the key: smaller id first, then any order of equal
    rows; a null id hashes like an empty string. Result names replace columns of the same name.
    """
    sealed = Sealed(docs)
    text = or_empty(sealed.col(text_column))
    size = word_count(text) if size_column is None else F.coalesce(sealed.col(size_column), F.lit(0))
    quality = symbol_quality(text) if quality_column is None else sealed.col(quality_column)
    hashed = F.md5(F.concat_ws("|", F.lit(seed), sealed.col(id_column).cast("string")).cast("binary"))
    draw = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = sealed.rows.withColumns({"_size": size.cast("long"), "_source": sealed.col(source_column), "_id": sealed.col(id_column),
                              "_key": -F.log(draw) / F.greatest(F.coalesce(quality, F.lit(1e-6)), F.lit(1e-6))})
    # written once, without the texts: words are counted and keys drawn here and in the last pass only
    light = stage(keyed.select("_id", "_source", "_size", "_key"), "mix-keys")
    per_source = light.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"),
                                              F.avg("_key").alias("_mean"))
    per_source = stage(per_source, "mix-sources")
    plan = targets(per_source.select(F.col("_source").alias("source"), "source_size"), weights, max_epochs).join(
        per_source.select(F.col("_source").alias("_s"), "_rows", "_mean"), F.col("source").eqNullSafe(F.col("_s"))
    ).select("source", "source_size", "target", "_mean",
             F.greatest(F.lit(1), F.least(F.lit(max_slices), F.ceil(F.col("_rows") / rows_per_slice))).cast("long").alias("_slices"),
             F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_epochs"))
    plan = stage(plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-plan")
    # a rising function of the key that spreads keys about evenly over the slices
    slice_of = F.least(F.col("_slices") - 1, F.floor(
        F.col("_slices") * (1 - F.exp(-F.col("_key") / F.greatest(F.col("_mean"), F.lit(1e-300)))))).cast("long")
    same = F.col("_source").eqNullSafe(F.col("source"))
    slices = light.join(bounded(plan), same).groupBy("_source", slice_of.alias("_slice")).agg(F.sum("_size").alias("_sum"))
    running = Window.partitionBy("_source").orderBy("_slice")
    ends = slices.withColumn("_before", F.sum("_sum").over(running) - F.col("_sum")).join(bounded(plan), same).filter(
        (F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))
    ).groupBy("_source").agg(F.max_by("_slice", "_slice").alias("_slice"), F.max_by("_before", "_slice").alias("_before"))
    ends = stage(ends.select(F.col("_source").alias("_end_source"), F.col("_slice").alias("_end_slice"), F.col("_before").alias("_end_before")), "mix-ends")
    inside = light.join(bounded(plan), same).join(
        bounded(ends), F.col("_source").eqNullSafe(F.col("_end_source")) & (slice_of == F.col("_end_slice")))
    in_order = Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_last(), "_size")
    cut = inside.withColumn("_upto", F.col("_end_before") + F.sum("_size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).filter(
        F.col("_upto") - F.col("_size") / 2 <= F.col("_rest")
    ).groupBy("_source").agg(F.max(F.struct("_key", F.col("_id").isNull().alias("_none"), "_id", "_size")).alias("_last"))
    cut = stage(cut.select(F.col("_source").alias("_cut_source"), "_last"), "mix-cut")
    placed = keyed.join(bounded(plan.withColumnsRenamed({"source": "_plan_source", "source_size": "_source_size", "target": "_target"})),
                        F.col("_source").eqNullSafe(F.col("_plan_source"))).join(
        bounded(ends), F.col("_source").eqNullSafe(F.col("_end_source")), "left").join(
        bounded(cut), F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    here = F.struct("_key", F.col("_id").isNull().alias("_none"), "_id", "_size")
    first = F.col("_rest") > 0
    chosen = first & F.when(F.col("_end_slice").isNull(), True).when(slice_of < F.col("_end_slice"), True).when(
        slice_of > F.col("_end_slice"), False).otherwise(F.coalesce(here <= F.col("_last"), F.lit(False)))
    times = F.col("_epochs") + F.when(chosen, 1).otherwise(0)
    return sealed.opened(placed.withColumn("_times", times.cast("int")), size=F.col("_size"), source_size=F.col("_source_size"),
                         target=F.col("_target"), taken=F.col("_size") * F.col("_times"), times=F.col("_times"))
