"""Derived attributes: institutes, programs, display formats, profile values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise import fixtures as fx
from seatwise.catalog.common import applications, tagged_applications
from seatwise.catalog.registry import (
    CATEGORY, CONFIDENCE, CTES, METRO, REGION, query, quoted, trimmed, values_table,
)
from seatwise.dims.wording import GOAL_LABELS
from seatwise.dims import tables, values as V
from seatwise.functions import classify, eligibility, scoring, text as X
from seatwise.operators import profiles as PR, programs as P, results

_TYPE = """CASE WHEN contains(lower(institute), 'indian institute of technology')
        AND NOT contains(lower(institute), 'information') THEN 'IIT'
    WHEN contains(lower(institute), 'national institute of technology') THEN 'NIT'
    WHEN contains(lower(institute), 'information technology') THEN 'IIIT' ELSE 'GFTI' END"""
_OLD = ", ".join(quoted(n) for n in V.OLD_IITS)
_TOP = ", ".join(quoted(n) for n in V.TOP_NITS)
_NAMED = "CASE " + " ".join(
    f"WHEN contains(lower(institute), {quoted(s.lower())}) THEN {quoted(s)}" for s in V.STATES
) + " ELSE 'Unknown' END"

CTES["names"] = f"""
    SELECT institute, {_TYPE} AS institute_type, count(*) AS n
    FROM (SELECT {trimmed('institute')} AS institute FROM raw WHERE institute IS NOT NULL)
    GROUP BY institute"""
CTES["mapped"] = values_table(list(V.INSTITUTE_STATES.items()), "institute, state")
CTES["placed"] = f"""
    SELECT n.institute, institute_type, n.n, coalesce(m.state, {_NAMED.replace('institute)', 'n.institute)')})
        AS institute_state FROM names n LEFT JOIN mapped m ON m.institute = n.institute"""


def names(spark, sf) -> DataFrame:
    """Distinct institute names first, so that each name is classified once."""
    rows = fx.raw_cutoffs(spark, sf).where("institute is not null")
    return (
        rows.groupBy(X.trimmed(F.col("institute")).alias("institute"))
        .agg(F.count("*").alias("n"))
        .withColumn("institute_type", classify.institute_type(F.col("institute")))
    )


def placed(spark, sf) -> DataFrame:
    return P.with_institute_state(names(spark, sf))


@query("institute_type", "SELECT institute, institute_type, n FROM names")
def institute_type(spark, sf):
    return names(spark, sf)


@query(
    "brand_score",
    f"""SELECT institute, CAST(CASE institute_type
        WHEN 'IIT' THEN CASE WHEN institute IN ({_OLD}) THEN 1.0 ELSE 0.88 END
        WHEN 'NIT' THEN CASE WHEN institute IN ({_TOP}) THEN 0.78 ELSE 0.68 END
        WHEN 'IIIT' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS brand_score FROM names""",
)
def brand_score(spark, sf):
    score = classify.brand_score(F.col("institute"), F.col("institute_type"))
    return names(spark, sf).select("institute", score.alias("brand_score"))


@query(
    "brand_tier",
    f"""SELECT institute, CASE institute_type
        WHEN 'IIT' THEN CASE WHEN institute IN ({_OLD}) THEN 'top_iit' ELSE 'iit' END
        WHEN 'NIT' THEN CASE WHEN institute IN ({_TOP}) THEN 'top_nit' ELSE 'nit' END
        ELSE lower(institute_type) END AS tier FROM names""",
)
def brand_tier(spark, sf):
    kind = F.col("institute_type")
    score = classify.brand_score(F.col("institute"), kind)
    return names(spark, sf).select("institute", classify.brand_tier(kind, score).alias("tier"))


@query(
    "exam_of",
    "SELECT institute, CASE WHEN institute_type = 'IIT' THEN 'advanced' ELSE 'mains' END AS exam "
    "FROM names",
)
def exam_of(spark, sf):
    return names(spark, sf).select(
        "institute", classify.exam_of(F.col("institute_type")).alias("exam")
    )


@query("institute_state", "SELECT institute, institute_state, n FROM placed")
def institute_state(spark, sf):
    return placed(spark, sf).select("institute", "institute_state", "n")


@query(
    "join_state_dim",
    "SELECT n.institute, m.state AS mapped_state FROM names n LEFT JOIN mapped m "
    "ON m.institute = n.institute",
)
def join_state_dim(spark, sf):
    return names(spark, sf).join(tables.institute_states(spark), "institute", "left").select(
        "institute", "mapped_state"
    )


@query("region_of", f"SELECT institute, institute_state, {REGION} AS region FROM placed")
def region_of(spark, sf):
    return placed(spark, sf).select(
        "institute", "institute_state", classify.region_of(F.col("institute_state")).alias("region")
    )


@query("is_metro", f"SELECT institute, {METRO} AS is_metro FROM placed")
def is_metro(spark, sf):
    metro = classify.is_metro(F.col("institute"), F.col("institute_state"))
    return placed(spark, sf).select("institute", metro.alias("is_metro"))


@query(
    "college_location",
    """SELECT institute, CASE WHEN contains(institute, ',')
        THEN trim(string_split(institute, ',')[2])
        WHEN starts_with(institute, 'Indian Institute of Technology')
            THEN trim(substr(institute, length('Indian Institute of Technology') + 1))
        WHEN starts_with(institute, 'Indian Institute of Information Technology')
            THEN trim(substr(institute, length('Indian Institute of Information Technology') + 1))
        ELSE institute_state END AS location FROM placed""",
)
def college_location(spark, sf):
    place = classify.college_location(F.col("institute"), F.col("institute_state"))
    return placed(spark, sf).select("institute", place.alias("location"))


def _tag_sql() -> str:
    arms = []
    for tag, (wanted, unwanted) in V.TAG_KEYWORDS.items():
        hit = " OR ".join(
            [f"contains(low, {quoted(w)})" for w in wanted]
            + [f"starts_with(trim(low), {quoted(p)})" for p in V.TAG_PREFIXES.get(tag, [])]
        )
        miss = "".join(f" AND NOT contains(low, {quoted(w)})" for w in unwanted)
        arms.append(f"CASE WHEN ({hit}){miss} THEN '{tag}' END")
    return f"array_to_string(list_sort([x FOR x IN [{', '.join(arms)}] IF x IS NOT NULL]), ',')"


@query(
    "branch_tags",
    f"""SELECT program, coalesce(nullif({_tag_sql()}, ''), 'other') AS tags, n
    FROM (SELECT program, lower(program) AS low, count(*) AS n
        FROM (SELECT {trimmed('program')} AS program FROM raw WHERE program IS NOT NULL)
        GROUP BY program)""",
)
def branch_tags(spark, sf):
    rows = fx.raw_cutoffs(spark, sf).where("program is not null")
    distinct = rows.groupBy(X.trimmed(F.col("program")).alias("program")).agg(
        F.count("*").alias("n")
    )
    tags = F.array_join(classify.branch_tags(F.col("program")), ",")
    return distinct.select("program", tags.alias("tags"), "n")


@query(
    "is_dual_degree",
    f"SELECT program, contains(lower(program), 'dual') AS is_dual, count(*) AS n "
    f"FROM (SELECT {trimmed('program')} AS program FROM raw WHERE program IS NOT NULL) "
    "GROUP BY ALL",
)
def is_dual_degree(spark, sf):
    rows = fx.raw_cutoffs(spark, sf).where("program is not null")
    distinct = rows.groupBy(X.trimmed(F.col("program")).alias("program")).agg(
        F.count("*").alias("n")
    )
    # all fixture names that mention a dual degree do so in their degree
    degree = X.program_degree(F.col("program"))
    return distinct.select("program", classify.is_dual_degree(degree).alias("is_dual"), "n")


@query(
    "confidence_band",
    f"SELECT institute, branch_full, quota, seat_type, gender_pool, {CONFIDENCE} AS confidence "
    "FROM programs",
)
def confidence_band(spark, sf):
    band = classify.confidence_band(F.col("opening_rank"), F.col("closing_rank"))
    return fx.programs(spark, sf).select(
        "institute", "branch_full", "quota", "seat_type", "gender_pool", band.alias("confidence")
    )


_APPLICATION = "line, profile_id, opening_rank, closing_rank, round"
_COLUMNS = _APPLICATION.split(", ")


@query("rank_category", f"SELECT {_APPLICATION}, rank, {CATEGORY} AS category FROM applications")
def rank_category(spark, sf):
    category = classify.rank_category(F.col("rank"), F.col("opening_rank"), F.col("closing_rank"))
    return applications(spark, sf).select(*_COLUMNS, "rank", category.alias("category"))


@query(
    "band_filter",
    f"SELECT {_APPLICATION}, rank FROM applications "
    "WHERE rank <= 1.25 * closing_rank AND rank >= 0.5 * opening_rank",
)
def band_filter(spark, sf):
    kept = classify.in_band(F.col("rank"), F.col("opening_rank"), F.col("closing_rank"))
    return applications(spark, sf).where(kept).select(*_COLUMNS, "rank")


@query(
    "relevant_rank",
    "SELECT profile_id, 'advanced' AS exam, adv_rank AS rank FROM profiles "
    "WHERE adv_rank IS NOT NULL UNION ALL SELECT profile_id, 'mains', mains_rank FROM profiles "
    "WHERE mains_rank IS NOT NULL",
)
def relevant_rank(spark, sf):
    return PR.profile_ranks(fx.profiles(spark, sf)).select("profile_id", "exam", "rank")


@query(
    "gender_filter",
    f"SELECT {_APPLICATION}, gender, gender_pool FROM applications "
    "WHERE gender = 'female' OR gender_pool = 'neutral'",
)
def gender_filter(spark, sf):
    kept = eligibility.passes_gender(F.col("gender_pool"), F.col("gender"))
    return applications(spark, sf).where(kept).select(*_COLUMNS, "gender", "gender_pool")


_SPECIAL_QUOTA = "CASE WHEN round = 7 THEN 'GO' WHEN round = 6 THEN 'ZZ' ELSE quota END"
_SPECIAL_HOME = "CASE WHEN profile_id % 4 = 0 THEN 'Goa' ELSE home_state END"


@query(
    "quota_filter",
    f"""SELECT {_APPLICATION}, q AS quota, h AS home_state FROM
        (SELECT *, {_SPECIAL_QUOTA} AS q, {_SPECIAL_HOME} AS h FROM applications)
    WHERE institute_type = 'IIT' OR q IN ('AI', 'ZZ') OR (q = 'HS' AND institute_state = h)
        OR (q = 'OS' AND institute_state <> h) OR (q = 'GO' AND h = 'Goa')""",
)
def quota_filter(spark, sf):
    rows = applications(spark, sf).withColumns(
        {"quota": F.expr(_SPECIAL_QUOTA), "home_state": F.expr(_SPECIAL_HOME)}
    )
    kept = eligibility.passes_quota(
        F.col("institute_type"), F.col("quota"), F.col("institute_state"), F.col("home_state")
    )
    return rows.where(kept).select(*_COLUMNS, "quota", "home_state")


@query(
    "seat_filter",
    f"""SELECT {_APPLICATION}, seat_type FROM applications
    WHERE profile_id % 3 = 1 OR profile_id % 5 = 0 OR seat_type = seat_category""",
)
def seat_filter(spark, sf):
    rows = applications(spark, sf).withColumns(
        {
            "data_mode": F.when(F.col("profile_id") % 3 == 1, "basic").otherwise("extended"),
            "seat_category": F.when(F.col("profile_id") % 5 == 0, "").otherwise(
                F.col("seat_category")
            ),
        }
    )
    kept = eligibility.passes_seat(
        F.col("data_mode"), F.col("seat_category"), F.col("seat_type")
    )
    return rows.where(kept).select(*_COLUMNS, "seat_type")


_TAG = (
    "CASE split_part(program, ' (', 1) WHEN 'Economics' THEN 'economics' "
    "WHEN 'Mechanical Engineering' THEN 'mechanical' "
    "WHEN 'Computer Science and Engineering' THEN 'cse' WHEN 'Civil Engineering' THEN 'civil' "
    "WHEN 'Mathematics and Computing' THEN 'math_computing' ELSE 'ece' END"
)


@query(
    "branch_pref_filter",
    f"""SELECT {_APPLICATION}, program FROM (SELECT *, {_TAG} AS tag FROM applications) a
    WHERE NOT EXISTS (SELECT 1 FROM preference_tags t
            WHERE list_contains(a.branch_preferences, t.preference))
        OR EXISTS (SELECT 1 FROM preference_tags t
            WHERE list_contains(a.branch_preferences, t.preference) AND t.tag = a.tag)""",
)
def branch_pref_filter(spark, sf):
    kept = eligibility.shares_tag(F.col("tags"), F.col("wanted_tags"))
    return tagged_applications(spark, sf).where(kept).select(*_COLUMNS, "program")


@query(
    "join_prefs",
    """SELECT profile_id, coalesce(string_agg(DISTINCT t.tag, ',' ORDER BY t.tag), '') AS wanted
    FROM choosy p LEFT JOIN preference_tags t ON list_contains(p.branch_preferences, t.preference)
    GROUP BY profile_id""",
)
def join_prefs(spark, sf):
    return PR.preference_tag_sets(fx.profiles(spark, sf, preferences=True)).select(
        "profile_id", F.array_join("wanted_tags", ",").alias("wanted")
    )


@query(
    "join_goal_weights",
    f"""SELECT {_APPLICATION}, coalesce(w.weight, 0.0) AS weight
    FROM (SELECT *, {_TAG} AS tag FROM applications) a
    LEFT JOIN weights w ON w.goal = a.goal AND w.tag = a.tag""",
)
def join_goal_weights(spark, sf):
    mask = classify.tag_mask(F.col("tags"))
    weight = F.get(scoring.goal_weight_array(mask), scoring.goal_index(F.col("goal")))
    return tagged_applications(spark, sf).select(*_COLUMNS, weight.alias("weight"))


_BRAND = (
    "CAST(CASE institute_type WHEN 'IIT' THEN 0.88 WHEN 'NIT' THEN 0.68 WHEN 'IIIT' THEN 0.6 "
    "ELSE 0.5 END AS DOUBLE)"
)


@query(
    "interest_score",
    f"""SELECT {_APPLICATION}, coalesce(w.weight, 0.0) > 0 AS matched,
        round((1.0 - brand_branch_ratio) * coalesce(w.weight, 0.0)
            + brand_branch_ratio * ({_BRAND} * 10.0), 2) AS score
    FROM (SELECT *, {_TAG} AS tag FROM applications) a
    LEFT JOIN weights w ON w.goal = a.goal AND w.tag = a.tag""",
)
def interest_score(spark, sf):
    mask = classify.tag_mask(F.col("tags"))
    weight = F.get(scoring.goal_weight_array(mask), scoring.goal_index(F.col("goal")))
    brand = classify.brand_score(F.col("institute"), F.col("institute_type"))
    rows = tagged_applications(spark, sf).withColumns({"weight": weight, "brand": brand})
    return rows.select(
        *_COLUMNS,
        (F.col("weight") > 0).alias("matched"),
        scoring.interest_score(
            F.col("weight"), F.col("brand"), F.col("brand_branch_ratio")
        ).alias("score"),
    )


_SIGMA = "greatest(0.08 * closing_rank, 10.0, 0.05 * closing_rank)"
_CHANCE = f"round(1.0 / (1.0 + exp(-1.7 * ((closing_rank - rank) / {_SIGMA}))) * 100.0, 1)"


def chances(spark, sf) -> DataFrame:
    sigma = scoring.volatility(F.lit(1), F.lit(None).cast("double"), F.col("closing_rank"))
    chance = scoring.admission_probability(F.col("rank"), F.col("closing_rank"), sigma)
    return applications(spark, sf).select(*_COLUMNS, chance.alias("probability"))


@query("admission_probability", f"SELECT {_APPLICATION}, {_CHANCE} AS probability FROM applications")
def admission_probability(spark, sf):
    return chances(spark, sf)


@query(
    "probability_band",
    f"""SELECT {_APPLICATION}, CASE WHEN probability >= 75 THEN 'high'
        WHEN probability >= 35 THEN 'medium' WHEN probability IS NOT NULL THEN 'low' END AS band
    FROM (SELECT *, {_CHANCE} AS probability FROM applications)""",
)
def probability_band(spark, sf):
    band = classify.probability_band(F.col("probability"))
    return chances(spark, sf).select(*_COLUMNS, band.alias("band"))


@query(
    "quota_label",
    f"""SELECT quota, coalesce(w.text, quota) AS label, n FROM
        (SELECT coalesce({trimmed('quota')}, 'ZZ') AS quota, count(*) AS n FROM raw GROUP BY 1) q
        LEFT JOIN wording w ON w.lang = 'en' AND w.key = 'quota.' || q.quota""",
)
def quota_label(spark, sf):
    code = F.coalesce(X.trimmed(F.col("quota")), F.lit("ZZ"))
    codes = fx.raw_cutoffs(spark, sf).groupBy(code.alias("quota")).agg(F.count("*").alias("n"))
    labelled = results.with_quota_label(codes.withColumn("lang", F.lit("en")))
    return labelled.select("quota", F.col("quota_label").alias("label"), "n")


_TYPED = (
    "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN ' 1,2' || o_orderkey "
    "WHEN 3 THEN o_orderkey || '.5' ELSE 'rank ' || o_orderkey END"
)


@query(
    "parse_rank",
    f"""SELECT o_orderkey, CASE WHEN r > 0 THEN r END AS rank FROM (SELECT o_orderkey,
        TRY_CAST(regexp_replace({_TYPED}, '[^0-9]', '', 'g') AS BIGINT) AS r FROM orders)""",
)
def parse_rank(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return orders.select("o_orderkey", X.parsed_rank(F.expr(_TYPED)).alias("rank"))


@query(
    "format_rank_in",
    """SELECT o_orderkey, CASE WHEN length(v) <= 3 THEN v
        ELSE ltrim(reverse(regexp_replace(reverse(left(v, length(v) - 3)), '([0-9][0-9])', '\\1,',
            'g')), ',') || ',' || right(v, 3) END AS shown
    FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice * (o_orderkey % 50)) AS BIGINT)
        AS VARCHAR) AS v FROM orders)""",
)
def format_rank_in(spark, sf):
    number = F.expr("CAST(floor(o_totalprice * (o_orderkey % 50)) AS BIGINT)")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", X.indian_grouping(number).alias("shown")
    )


_STATE_LIST = "[" + ", ".join(quoted(s) for s in V.STATES) + "]"
CTES["state_names"] = values_table([(s,) for s in V.STATES], "state")


@query(
    "canonical_state",
    f"""SELECT profile_id, coalesce(s.state, typed) AS home_state FROM
        (SELECT profile_id, CASE WHEN profile_id % 9 = 8 THEN ' nowhere '
            WHEN profile_id % 2 = 0 THEN chr(9) || upper({_STATE_LIST}[profile_id % 34 + 1])
            ELSE lower({_STATE_LIST}[profile_id % 34 + 1]) || ' ' END AS typed FROM profiles) p
        LEFT JOIN state_names s ON lower(s.state) = lower({trimmed('typed')})""",
)
def canonical_state(spark, sf):
    name = F.element_at(F.array(*map(F.lit, V.STATES)), (F.col("profile_id") % 34 + 1).cast("int"))
    typed = (
        F.when(F.col("profile_id") % 9 == 8, " nowhere ")
        .when(F.col("profile_id") % 2 == 0, F.concat(F.lit("\t"), F.upper(name)))
        .otherwise(F.concat(F.lower(name), F.lit(" ")))
    )
    people = fx.profiles(spark, sf).select("profile_id", typed.alias("home_state"))
    return PR.canonical_state(people)


CTES["goal_names"] = values_table(list(GOAL_LABELS.items()), "goal, label")


@query(
    "canonical_goal_label",
    "SELECT profile_id, label AS goal_label FROM profiles JOIN goal_names USING (goal)",
)
def canonical_goal_label(spark, sf):
    return fx.profiles(spark, sf).join(tables.goal_labels(spark), "goal").select(
        "profile_id", "goal_label"
    )


_DEFECTS = {
    "adv_rank": "CASE profile_id % 23 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE adv_rank END",
    "mains_rank": "CASE profile_id % 23 WHEN 2 THEN NULL WHEN 3 THEN -5 ELSE mains_rank END",
    "gender": "CASE profile_id % 23 WHEN 4 THEN 'other' ELSE gender END",
    "home_state": "CASE profile_id % 23 WHEN 5 THEN NULL ELSE home_state END",
    "goal": "CASE profile_id % 23 WHEN 6 THEN 'art' ELSE goal END",
    "data_mode": "CASE profile_id % 23 WHEN 7 THEN 'full' WHEN 8 THEN NULL ELSE data_mode END",
    "brand_branch_ratio": "CASE profile_id % 23 WHEN 9 THEN 1.5 ELSE brand_branch_ratio END",
    "max_results": "CASE profile_id % 23 WHEN 10 THEN 301 WHEN 11 THEN 0 WHEN 12 THEN NULL "
    "ELSE max_results END",
    "lang": "CASE profile_id % 23 WHEN 13 THEN 'fr' ELSE lang END",
}


@query(
    "validate_profiles",
    f"""SELECT profile_id, CASE WHEN adv_rank < 1 THEN 'adv_rank below 1'
        WHEN mains_rank < 1 THEN 'mains_rank below 1'
        WHEN adv_rank IS NULL AND mains_rank IS NULL THEN 'no rank'
        WHEN gender NOT IN ('male', 'female') THEN 'gender'
        WHEN home_state IS NULL THEN 'home_state'
        WHEN goal = 'art' THEN 'goal' WHEN data_mode = 'full' THEN 'data_mode'
        WHEN brand_branch_ratio > 1 THEN 'brand_branch_ratio'
        WHEN max_results NOT BETWEEN 1 AND 300 THEN 'max_results'
        WHEN lang = 'fr' THEN 'lang' ELSE 'valid' END AS outcome
    FROM (SELECT profile_id, {', '.join(f'{sql} AS {c}' for c, sql in _DEFECTS.items())}
        FROM profiles)""",
)
def validate_profiles(spark, sf):
    broken = fx.profiles(spark, sf).withColumns({c: F.expr(sql) for c, sql in _DEFECTS.items()})
    valid, rejected = PR.validate_profiles(broken)
    return valid.select("profile_id", F.lit("valid").alias("outcome")).unionByName(
        rejected.select("profile_id", F.col("reason").alias("outcome"))
    )
