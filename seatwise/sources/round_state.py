"""Last rounds kept as a table by year, to which each new file is folded.

The table has the last row of each key with what decides ties, so folding loads one by one, in any order, gives the
rows of a reduction of all of them. Only the years that a load has are read and written again. Folding a load twice
changes nothing; if a driver is lost while it replaces a year, that year's loads are to be folded again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seatwise.operators.rounds import HISTORY_KEY, RULES
from seatwise.session import written
from seatwise.sources.cutoffs import require_columns


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table, or none where nothing has been folded yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fold_rounds(rows: DataFrame, path: str, rule: str, lines: Sequence[str] = ("line",)) -> None:
    """Adds ``rows`` to the table at ``path``; ``rule`` is a name of ``RULES``, which says what rows it takes.

    All loads have the same columns. The driver gets the distinct years of the load. Rows with a null year, where the
    rule keeps them, are a year of their own.
    """
    require_columns(rows, ["year", "round", *lines])
    spark, reduce = rows.sparkSession, RULES[rule]
    load = written(reduce.last(reduce.rows(rows, lines), lines))
    years = [r["year"] for r in load.select("year").distinct().collect()]
    if not years:
        return
    known = [y for y in years if y is not None]
    touched = F.col("year").isin(known)
    if None in years:
        touched = touched | F.col("year").isNull()
    before, merged = _stored(spark, path, load.schema), load
    if before is not None:
        # the load has one row per key already, so it is only merged with what is there
        both = before.where(touched).unionByName(load)
        merged = reduce.last(both, lines).select(*load.columns)
    # the years of the load are replaced when all of them are written
    writer = merged.hint("rebalance", "year").write.partitionBy("year").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def folded_rounds(spark: SparkSession, path: str, rule: str, schema: T.StructType | None = None) -> DataFrame:
    """What the reduction of all folded rows gives, unsorted; with ``programs``, for every year.

    Without ``schema`` the types are those of the files, and that of the year as Spark infers it.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path).drop("_round")
    return rows.select(*HISTORY_KEY, "year", "closing_rank") if rule == "history" else rows
