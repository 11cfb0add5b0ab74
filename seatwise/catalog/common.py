"""Spark counterparts of the shared oracle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise import fixtures as fx
from seatwise.functions import classify, eligibility
from seatwise.operators.profiles import preference_tag_sets
from seatwise.plans.recommend import recommend


def applications(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order line: its customer as the candidate, its cutoff as the program."""
    lines = fx.cutoffs(spark, sf, applicant=True)
    people = fx.profiles(spark, sf, preferences=True)
    return lines.join(people, lines["applicant"] == people["profile_id"]).withColumn(
        "rank",
        eligibility.relevant_rank(F.col("exam"), F.col("adv_rank"), F.col("mains_rank")),
    )


def tagged_applications(spark: SparkSession, sf: str) -> DataFrame:
    wanted = preference_tag_sets(applications(spark, sf))
    return wanted.withColumn("tags", classify.branch_tags(F.col("program")))


def recs(spark: SparkSession, sf: str, texts: bool = False, preferences: bool = False) -> DataFrame:
    return recommend(fx.profiles(spark, sf, preferences), fx.seats(spark, sf), texts=texts)


def history_text():
    """{year -> rank, ...} in year order; casts have generated code, higher-order functions not"""
    return F.col("history").cast("string")
