"""Whole-table summaries of cutoffs and programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seatwise.dims import tables

SLICE = 1024
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def program_count(programs: DataFrame) -> DataFrame:
    return programs.agg(F.count("*").alias("programs"))


def load_summary(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows, years and rounds of a load, and how many rows the reduction removed."""
    both = rows.select("year", "round", F.lit(1).alias("loaded")).unionByName(
        kept.select(
            F.lit(None).cast(rows.schema["year"].dataType).alias("year"),
            F.lit(None).cast(rows.schema["round"].dataType).alias("round"),
            F.lit(-1).alias("loaded"),
        )
    )
    return both.agg(
        F.count_if(F.col("loaded") == 1).alias("n_rows"),
        F.count_distinct("year").alias("n_years"),
        F.array_sort(F.collect_set("round")).alias("rounds"),
        F.count_if(F.col("loaded") == -1).alias("n_kept"),
        F.sum("loaded").alias("n_removed"),
    )


def round_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year", "round").agg(F.count("*").alias("n_rows")).orderBy("year", "round")


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """Exact quantiles of a whole-number column, linear between neighbours.

    Values are counted first. Slices of ``SLICE`` values get running totals, and only the slices
    that hold a wanted rank are looked at value by value, so neither the rows nor the distinct
    values ever meet in one task.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("bigint").alias("v"))
        .agg(F.count("*").alias("n"))
        .withColumn("slice", F.floor(F.col("v") / F.lit(SLICE)))
    )
    slices = counts.groupBy("slice").agg(F.sum("n").alias("slice_n"))
    by_slice = Window.orderBy("slice")
    bounds = slices.select(
        "slice",
        F.sum("slice_n").over(by_slice).alias("upto"),
        F.sum("slice_n").over(by_slice.rowsBetween(*_WHOLE)).alias("total"),
        "slice_n",
    ).withColumn("before", F.col("upto") - F.col("slice_n"))
    holding = (
        bounds.select(
            "*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
        )
        .withColumn("at", F.col("probability") * (F.col("total") - 1))
        .select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank_no"))
        .where((F.col("rank_no") >= F.col("before")) & (F.col("rank_no") < F.col("upto")))
        .select("slice", "before", "probability", "at", "rank_no")
    )
    within = (
        Window.partitionBy("slice", "probability", "rank_no")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = (
        counts.join(holding, "slice")
        .withColumn("value_upto", F.col("before") + F.sum("n").over(within))
        .where(
            (F.col("rank_no") < F.col("value_upto"))
            & (F.col("rank_no") >= F.col("value_upto") - F.col("n"))
        )
    )
    low, high = F.min("v"), F.max("v")
    share = F.first("at") - F.floor(F.first("at"))
    return hits.groupBy("probability").agg((low + (high - low) * share).alias("value"))


def spread_profile(programs: DataFrame) -> DataFrame:
    """Quartile, median and upper third of closing - opening, and the inverted windows."""
    spreads = programs.select((F.col("closing_rank") - F.col("opening_rank")).alias("spread"))
    names = {0.25: "p25", 0.5: "median", 0.66: "p66"}
    name = F
    for probability, text in names.items():
        name = name.when(F.col("probability") == probability, text)
    quantiles = exact_quantiles(spreads, "spread", list(names)).select(
        name.alias("measure"), "value"
    )
    inverted = spreads.agg(F.count_if(F.col("spread") <= 0).cast("double").alias("value"))
    return quantiles.unionByName(inverted.select(F.lit("inverted").alias("measure"), "value"))


def distinct_dims(cutoffs: DataFrame) -> DataFrame:
    """All form options; reserved categories are available once there is multi-year data."""
    flag = cutoffs.agg((F.count_distinct("year") > 1).alias("multi_year"))
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(i).alias("position"),
            F.lit(value).alias("value"),
            F.lit(label).alias("label"),
            F.lit(available).alias("always"),
        )
        for kind, i, value, label, available in tables.option_rows()
    ]
    return flag.select("multi_year", F.inline(F.array(*rows))).select(
        "kind",
        "position",
        "value",
        "label",
        (F.col("always") | F.col("multi_year")).alias("available"),
    )
