"""Cutoffs, programs, profiles and links derived from the TPC-H-like test tables.

The column expressions are plain SQL that Spark and DuckDB read alike, so both engines see the
same derived tables; everything computed *from* those tables is written separately per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.dims import values as V
from seatwise.functions import classify
from seatwise.functions.text import program_branch, program_degree
from seatwise.operators import programs as P
from seatwise.operators.rounds import first_row
from seatwise.plans.recommend import ready_seats, seat_table
from seatwise.session import task_count, written

YEAR = 2000


def _pick(number: str, texts: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE {number} % {len(texts)} {arms} END"


# nations stand for states, so that regions and home-state rules have something to tell apart
STATE = _pick("n_nationkey", V.STATES[:25])

CUTOFF_COLUMNS = {
    "institute": "s_name",
    "institute_state": STATE,
    "institute_type": "CASE s_suppkey % 4 WHEN 0 THEN 'IIT' WHEN 1 THEN 'NIT' WHEN 2 THEN 'IIIT' "
    "ELSE 'GFTI' END",
    "exam": "CASE WHEN s_suppkey % 4 = 0 THEN 'advanced' ELSE 'mains' END",
    "program": "CASE p_type WHEN 'ECONOMY' THEN 'Economics' "
    "WHEN 'SMALL' THEN 'Computer Science and Engineering' "
    "WHEN 'MEDIUM' THEN 'Mechanical Engineering' "
    "WHEN 'PROMO' THEN 'Electronics and Communication Engineering' "
    "WHEN 'STANDARD' THEN 'Civil Engineering' ELSE 'Mathematics and Computing' END "
    "|| ' (4 Years, Bachelor of Technology)'",
    "quota": "CASE l_returnflag WHEN 'A' THEN 'AI' WHEN 'N' THEN 'HS' ELSE 'OS' END",
    "seat_type": "CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'OBC-NCL' ELSE 'SC' END",
    "gender_pool": "CASE l_linestatus WHEN 'F' THEN 'female' ELSE 'neutral' END",
    "year": "CAST(year(l_shipdate) AS INT)",
    "round": "CAST(l_linenumber AS INT)",
    "closing_rank": "CAST(floor(l_extendedprice) AS BIGINT)",
    "opening_rank": "CAST(floor(l_extendedprice * (1.0 - 5.0 * l_discount + 4.0 * l_tax)) AS BIGINT)",
    "line": "l_orderkey",
}

_NAMES = [
    "Indian Institute of Technology Bombay",
    "Indian Institute of Technology Tirupati",
    "National Institute of Technology, Warangal",
    "National Institute of Technology Delhi",
    "Indian Institute of Information Technology Guwahati",
    "National Institute of Electronics and Information Technology, Patna (Bihar)",
    "Jawaharlal Nehru University, Delhi",
    "College of Tamil Nadu and Kerala",
    "Riverside Institute",
    "University of Hyderabad",
    "Institute of Chemical Technology, Mumbai: Indian Oil Odisha Campus, Bhubaneswar",
    "Pune City College",
    "Indian Institute of Technology (BHU) Varanasi",
    "National Institute of Technology Karnataka, Surathkal",
    "Indian institute of information technology, Raichur, Karnataka",
    "National Institute of Technology Goa",
]
_PROGRAMS = [
    "Computer Science and Engineering (4 Years, Bachelor of Technology)",
    "Mathematics and Computing (4 Years, Bachelor of Technology)",
    "Artificial Intelligence and Data Science (4 Years, Bachelor of Technology)",
    "Information Technology (4 Years, Bachelor of Technology)",
    "Electronics and VLSI Engineering (4 Years, Bachelor of Technology)",
    "Electrical Engineering (5 Years, Bachelor and Master of Technology (Dual Degree))",
    "Mechanical Engineering (Hons) (4 Years, Bachelor of Engineering)",
    "Civil Engineering",
    "Chemical Engineering (Bachelor of Technology)",
    "Aerospace Engineering (4 Years, Bachelor of Technology)",
    "Metallurgical and Materials Engineering (4 Years, Bachelor of Technology)",
    "Production and Industrial Engineering (4 Years, Bachelor of Technology)",
    "Energy Engineering (4 Years, Bachelor of Technology)",
    "Biotechnology (4 Years, Bachelor of Technology)",
    "Engineering Physics (4 Years, Bachelor of Technology)",
    "Chemistry (5 Years, Bachelor of Science and Master of Science (Dual Degree))",
    "BS in Mathematics (4 Years, Bachelor of Science)",
    "Economics (4 Years, Bachelor of Science)",
    "Architecture (5 Years, Bachelor of Architecture)",
    "Planning (4 Years, Bachelor of Planning)",
    "Design (4 Years, Bachelor of Design)",
    "Smart Manufacturing Design (4 Years, Bachelor of Technology)",
    "Ceramic Engineering (4 Years, Bachelor of Technology)",
    "Instrumentation and Control (4 Years, Bachelor of Technology",
]


_SPACED = "CASE l_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(9) ELSE '' END"

# raw text rows as a cutoff file would hold them, with defects
RAW_COLUMNS = {
    "institute": f"CASE WHEN l_orderkey % 97 <> 0 THEN {_SPACED} || "
    f"{_pick('s_suppkey', _NAMES)} || "
    "CASE WHEN s_suppkey < 16 OR s_suppkey % 2 = 0 THEN '' "
    "ELSE ' Campus ' || CAST(s_suppkey AS VARCHAR(20)) END || "
    f"{_SPACED} END",
    "program": f"CASE WHEN l_orderkey % 89 <> 0 THEN {_pick('p_partkey', _PROGRAMS)} || {_SPACED} END",
    "quota": "CASE WHEN l_orderkey % 13 <> 0 THEN CASE l_returnflag WHEN 'A' THEN 'AI' "
    "WHEN 'N' THEN ' HS' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'GO' ELSE 'OS' END END END",
    "seat_type": "CASE WHEN l_orderkey % 17 <> 0 THEN CASE o_orderstatus WHEN 'O' THEN 'OPEN' "
    "WHEN 'F' THEN 'OBC-NCL ' ELSE 'SC' END END",
    "gender": "CASE WHEN l_linestatus = 'F' THEN CASE l_orderkey % 3 "
    "WHEN 0 THEN 'Female-only (including Supernumerary)' WHEN 1 THEN ' F' ELSE 'FEMALE' END "
    "ELSE CASE WHEN l_orderkey % 11 <> 0 THEN 'Gender-Neutral' END END",
    "opening_rank": "CASE l_orderkey % 101 WHEN 1 THEN '12P' WHEN 2 THEN '12d' WHEN 3 THEN 'inf' "
    "WHEN 4 THEN '1,234' ELSE CAST(CAST(floor(l_extendedprice * "
    "(1.0 - 5.0 * l_discount + 4.0 * l_tax)) AS BIGINT) AS VARCHAR(20)) || "
    "CASE WHEN l_orderkey % 2 = 0 THEN '.0' ELSE ' ' END END",
    "closing_rank": "CASE WHEN l_orderkey % 103 <> 1 THEN "
    "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) END",
    "year": "CASE WHEN l_orderkey % 19 = 0 THEN 'n/k' WHEN l_orderkey % 23 <> 0 THEN "
    "CAST(year(l_shipdate) AS VARCHAR(20)) END",
    "round": "CASE WHEN l_orderkey % 29 = 0 THEN 'final' WHEN l_orderkey % 31 <> 0 THEN "
    "CAST(l_linenumber AS VARCHAR(20)) END",
    "line": "l_orderkey",
}
LINES = ["line", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

PROFILE_COLUMNS = {
    "profile_id": "c_custkey",
    "home_state": STATE,
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END",
    "goal": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'coding' WHEN 'BUILDING' THEN 'research' "
    "WHEN 'FURNITURE' THEN 'mba' WHEN 'HOUSEHOLD' THEN 'core' ELSE 'undecided' END",
    "seat_category": "CASE c_custkey % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'OBC-NCL' ELSE 'SC' END",
    "brand_branch_ratio": "CAST(c_custkey % 5 AS DOUBLE) / 4.0",
    "mains_rank": "CASE WHEN c_custkey % 4 <> 1 THEN "
    "CAST(floor(10 * (c_acctbal + 1000)) AS BIGINT) END",
    "adv_rank": "CASE WHEN c_custkey % 4 <> 2 THEN "
    "CAST(floor(10 * (c_acctbal + 1000)) AS BIGINT) END",
    "data_mode": "'extended'",
    "max_results": "60",
    "lang": "CASE c_custkey % 7 WHEN 0 THEN 'hi' WHEN 1 THEN 'gu' WHEN 2 THEN 'kn' ELSE 'en' END",
}
# comma list, split per engine
PREFERENCES = (
    "CASE c_custkey % 6 WHEN 1 THEN 'cs_it' WHEN 2 THEN 'mechanical,civil' "
    "WHEN 3 THEN 'any,unknown' WHEN 4 THEN 'ece,cs_it,math_computing' ELSE '' END"
)

CUTOFF_TABLES = {
    "orders": "l_orderkey = o_orderkey",
    "part": "l_partkey = p_partkey",
    "supplier": "l_suppkey = s_suppkey",
    "nation": "s_nationkey = n_nationkey",
}
# tables with a key of their own, and the rows beyond which they are too large to broadcast
UNIQUE = ["orders", "part"]
HASHED_ROWS = 2_000_000
PROFILE_TABLES = {"nation": "c_nationkey = n_nationkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(
    spark, sf_dir, base: str, tables: dict[str, str], columns: dict[str, str], spread: str | None = None
):
    """``spread`` is the column that the first of ``tables`` is joined by."""
    df = table(spark, sf_dir, base)
    if spread:
        # a table of one row group would be one task for all the costly columns; the first join needs no other shuffle
        df = df.repartition(task_count(spark), spread)
    for name, condition in tables.items():
        other = table(spark, sf_dir, name)
        if name in UNIQUE and other.count() > HASHED_ROWS:
            # a hash table of its keys, so that the rows of the base table are not sorted for the join
            other = other.hint("shuffle_hash")
        df = df.join(other, F.expr(condition))
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def cutoffs(spark: SparkSession, sf_dir: str, applicant: bool = False) -> DataFrame:
    columns = {**CUTOFF_COLUMNS, "applicant": "o_custkey"} if applicant else CUTOFF_COLUMNS
    return _derived(spark, sf_dir, "lineitem", CUTOFF_TABLES, columns, spread="l_orderkey")


_LANDED: dict[tuple[str, str], DataFrame] = {}


def raw_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of a raw file, plus the columns that stand for the source line.

    The rows are landed once in a session, as a file would be: what reads them does not make them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        columns = {**RAW_COLUMNS, **{c: c for c in LINES[1:]}}
        _LANDED[key] = written(_derived(spark, sf_dir, "lineitem", CUTOFF_TABLES, columns, "l_orderkey"))
    return _LANDED[key]


def profiles(spark: SparkSession, sf_dir: str, preferences: bool = False) -> DataFrame:
    wanted = PREFERENCES if preferences else "''"
    df = _derived(
        spark, sf_dir, "customer", PROFILE_TABLES, {**PROFILE_COLUMNS, "wanted": wanted}
    )
    known = F.filter(F.split("wanted", ","), lambda p: p != "")
    return df.withColumn("branch_preferences", known).drop("wanted")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-round seats of the target year as a program table."""
    key = ["institute", "program", "quota", "seat_type", "gender_pool"]
    order = [F.desc(c) for c in ("round", "line", "closing_rank", "opening_rank")]
    last = first_row(cutoffs(spark, sf_dir).where(F.col("year") == YEAR), key, order)
    return last.select(
        "institute",
        "institute_type",
        "institute_state",
        "exam",
        program_branch(F.col("program")).alias("branch"),
        F.col("program").alias("branch_full"),
        program_degree(F.col("program")).alias("degree"),
        "quota",
        "gender_pool",
        "seat_type",
        "opening_rank",
        "closing_rank",
        classify.brand_score(F.col("institute"), F.col("institute_type")).alias("brand_score"),
        classify.branch_tags(F.col("program")).alias("tags"),
    )


def year_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing rank per seat and year.

    Rows are spread by seat, so that neither the last rounds nor the history of a seat need another shuffle.
    """
    seat = ["institute", "program", "quota", "seat_type", "gender_pool"]
    key = [*seat, "year"]
    order = [F.desc(c) for c in ("round", "line", "closing_rank", "opening_rank")]
    return first_row(cutoffs(spark, sf_dir).repartition(*seat), key, order).select(*key, "closing_rank")


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written seat table of the derived programs."""
    history = P.program_history(year_ends(spark, sf_dir))
    return ready_seats(seat_table(programs(spark, sf_dir), "extended", history, YEAR))
