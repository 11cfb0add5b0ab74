"""Registration of queries and the common table expressions of their oracle SQL (DuckDB)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seatwise import fixtures as fx
from seatwise.dims import values as V
from seatwise.dims.wording import WORDING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any name of ``CTES`` as a table."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return run

    return register


def _names(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", text)]


def with_ctes(body: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        for inner in _names(CTES[name]):
            if inner != name:
                add(inner)
        wanted.append(name)

    for name in _names(body):
        add(name)
    if not wanted:
        return body
    recursive = "RECURSIVE " if any(n in _names(CTES[n]) for n in wanted) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted) + "\n" + body


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_table(rows: list[tuple], columns: str) -> str:
    def cell(v) -> str:
        return quoted(v) if isinstance(v, str) else str(v)

    listed = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({columns})"


def trimmed(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def numeric(c: str) -> str:
    pattern = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return (
        f"CASE WHEN regexp_full_match({trimmed(c)}, '{pattern}') "
        f"THEN TRY_CAST({trimmed(c)} AS DOUBLE) END"
    )


def pool(c: str) -> str:
    low = f"lower({trimmed(c)})"
    return f"CASE WHEN contains({low}, 'female') OR {low} = 'f' THEN 'female' ELSE 'neutral' END"


def _select(base: str, tables: dict[str, str], columns: dict[str, str]) -> str:
    joins = " ".join(f"JOIN {name} ON {on}" for name, on in tables.items())
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {listed} FROM {base} {joins}"


_LAST = (
    "row_number() OVER (PARTITION BY institute, program, quota, seat_type, gender_pool, year "
    "ORDER BY round DESC, line DESC, closing_rank DESC, opening_rank DESC) = 1"
)

CTES["cutoffs"] = _select(
    "lineitem", fx.CUTOFF_TABLES, {**fx.CUTOFF_COLUMNS, "applicant": "o_custkey"}
)
CTES["raw"] = _select(
    "lineitem", fx.CUTOFF_TABLES, {**fx.RAW_COLUMNS, **{c: c for c in fx.LINES[1:]}}
)
CTES["profiles"] = _select(
    "customer",
    fx.PROFILE_TABLES,
    {**fx.PROFILE_COLUMNS, "branch_preferences": "CAST([] AS VARCHAR[])"},
)
CTES["choosy"] = _select(
    "customer",
    fx.PROFILE_TABLES,
    {
        **fx.PROFILE_COLUMNS,
        "branch_preferences": f"[x FOR x IN string_split({fx.PREFERENCES}, ',') IF x <> '']",
    },
)
CTES["year_ends"] = f"SELECT * FROM cutoffs QUALIFY {_LAST}"
CTES["programs"] = f"""
    SELECT institute, institute_type, institute_state, exam,
        replace(program, ' (4 Years, Bachelor of Technology)', '') AS branch,
        program AS branch_full, 'Bachelor of Technology' AS degree, quota, gender_pool, seat_type,
        opening_rank, closing_rank,
        CAST(CASE institute_type WHEN 'IIT' THEN 0.88 WHEN 'NIT' THEN 0.68 WHEN 'IIIT' THEN 0.6
            ELSE 0.5 END AS DOUBLE) AS brand_score,
        CASE replace(program, ' (4 Years, Bachelor of Technology)', '')
            WHEN 'Economics' THEN 'economics' WHEN 'Mechanical Engineering' THEN 'mechanical'
            WHEN 'Computer Science and Engineering' THEN 'cse' WHEN 'Civil Engineering' THEN 'civil'
            WHEN 'Mathematics and Computing' THEN 'math_computing' ELSE 'ece' END AS tag
    FROM cutoffs WHERE year = {fx.YEAR} QUALIFY {_LAST}"""
CTES["weights"] = values_table(
    [(g, t, float(w)) for g, tags in V.GOAL_WEIGHTS.items() for t, w in tags.items()],
    "goal, tag, weight",
)
CTES["preference_tags"] = values_table(
    [(p, t) for p, tags in V.PREFERENCE_TAGS.items() for t in tags], "preference, tag"
)
CTES["wording"] = values_table(
    [(lang, k, text) for lang, table in WORDING.items() for k, text in table.items()],
    "lang, key, text",
)
# every key in every language, English where a language has none
CTES["texts"] = """
    SELECT l.lang, e.key, coalesce(w.text, e.text) AS text
    FROM (SELECT DISTINCT lang FROM wording) l
    CROSS JOIN (SELECT key, text FROM wording WHERE lang = 'en') e
    LEFT JOIN wording w ON w.lang = l.lang AND w.key = e.key"""
CTES["history"] = """
    SELECT institute, program, quota, seat_type, gender_pool,
        '{' || string_agg(CAST(year AS VARCHAR) || ' -> ' || CAST(closing_rank AS VARCHAR), ', '
            ORDER BY year) || '}' AS history,
        count(*) AS years, stddev_pop(closing_rank) AS deviation
    FROM year_ends GROUP BY ALL"""
CTES["home_advantage"] = """
    SELECT institute, branch_full, exam, gender_pool,
        coalesce(max(closing_rank) FILTER (quota = 'OS'), max(closing_rank) FILTER (quota = 'AI'))
            - max(closing_rank) FILTER (quota = 'HS') AS advantage
    FROM programs GROUP BY ALL HAVING advantage > 0"""
CTES["female_advantage"] = """
    SELECT institute, branch_full, exam, quota,
        max(closing_rank) FILTER (gender_pool = 'female')
            - max(closing_rank) FILTER (gender_pool = 'neutral') AS advantage
    FROM programs GROUP BY ALL HAVING advantage > 0"""
CTES["seats"] = f"""
    SELECT s.*, coalesce(h.history, '{{{fx.YEAR} -> ' || CAST(s.closing_rank AS VARCHAR) || '}}') AS history,
        coalesce(h.years, 1) AS years, h.deviation,
        greatest(
            CASE WHEN coalesce(h.years, 1) >= 2 THEN h.deviation ELSE 0.08 * s.closing_rank END,
            10.0, 0.05 * s.closing_rank) AS sigma,
        CASE WHEN s.quota = 'HS' THEN a.advantage END AS home_state_advantage,
        CASE WHEN s.gender_pool = 'female' THEN f.advantage END AS female_seat_advantage
    FROM programs s
    LEFT JOIN history h ON h.institute = s.institute AND h.program = s.branch_full
        AND h.quota = s.quota AND h.seat_type = s.seat_type AND h.gender_pool = s.gender_pool
    LEFT JOIN home_advantage a ON a.institute = s.institute AND a.branch_full = s.branch_full
        AND a.exam = s.exam AND a.gender_pool = s.gender_pool
    LEFT JOIN female_advantage f ON f.institute = s.institute AND f.branch_full = s.branch_full
        AND f.exam = s.exam AND f.quota = s.quota"""

CATEGORY = (
    "CASE WHEN rank IS NULL OR rank > 1.25 * closing_rank OR rank < 0.5 * opening_rank THEN NULL "
    "WHEN rank <= opening_rank THEN 'Safe' WHEN rank <= closing_rank THEN 'Target' "
    "ELSE 'Reach' END"
)
REGION = "CASE " + " ".join(
    f"WHEN institute_state IN ({', '.join(quoted(s) for s in members)}) THEN '{name}'"
    for name, members in V.REGIONS.items()
) + f" ELSE '{V.DEFAULT_REGION}' END"
METRO = (
    "(" + " OR ".join(f"contains(lower(institute), '{c}')" for c in V.METRO_CITIES)
    + " OR institute_state = 'Delhi')"
)
CONFIDENCE = (
    "CASE WHEN closing_rank - opening_rank < 1000 THEN 'fragile' "
    "WHEN closing_rank - opening_rank >= 6000 THEN 'high' ELSE 'medium' END"
)
PROBABILITY = "round(1.0 / (1.0 + exp(-1.7 * ((closing_rank - rank) / sigma))) * 100.0, 1)"


def matched(profiles: str, seat: str = "s.seat_type = p.seat_category") -> str:
    return f"""
    SELECT p.profile_id, p.lang, p.max_results, p.goal, p.brand_branch_ratio, s.*,
        CASE WHEN s.exam = 'advanced' THEN p.adv_rank ELSE p.mains_rank END AS rank
    FROM {profiles} p JOIN seats s ON {seat}
    WHERE (p.gender = 'female' OR s.gender_pool = 'neutral')
        AND (s.institute_type = 'IIT' OR s.quota = 'AI'
            OR (s.quota = 'HS' AND s.institute_state = p.home_state)
            OR (s.quota = 'OS' AND s.institute_state <> p.home_state))
        AND (NOT EXISTS (SELECT 1 FROM preference_tags t
                WHERE list_contains(p.branch_preferences, t.preference))
            OR EXISTS (SELECT 1 FROM preference_tags t
                WHERE list_contains(p.branch_preferences, t.preference) AND t.tag = s.tag))"""


def scored(matches: str) -> str:
    return f"""
    SELECT m.*, {CATEGORY} AS category, coalesce(w.weight, 0.0) > 0 AS matched_interest,
        round((1.0 - brand_branch_ratio) * coalesce(w.weight, 0.0)
            + brand_branch_ratio * (brand_score * 10.0), 2) AS interest_score
    FROM {matches} m LEFT JOIN weights w ON w.goal = m.goal AND w.tag = m.tag
    WHERE rank BETWEEN 0.5 * opening_rank AND 1.25 * closing_rank"""


def ranked(matches: str) -> str:
    return f"""
    SELECT * EXCLUDE (total), CAST(total AS BIGINT) AS total,
        {PROBABILITY} AS admission_probability, {CONFIDENCE} AS confidence,
        {REGION} AS region, {METRO} AS is_metro
    FROM (SELECT *, count(*) OVER (PARTITION BY profile_id) AS total,
            row_number() OVER (PARTITION BY profile_id ORDER BY
                CASE category WHEN 'Target' THEN 0 WHEN 'Reach' THEN 1 ELSE 2 END,
                interest_score DESC, closing_rank, institute, branch, branch_full, quota,
                gender_pool, seat_type, opening_rank) AS position
        FROM {matches})
    WHERE position <= max_results"""


CTES["eligible"] = matched("profiles")
CTES["matches"] = scored("eligible")
CTES["recs"] = ranked("matches")
CTES["any_eligible"] = matched("profiles", "s.exam IS NOT NULL")
CTES["any_matches"] = scored("any_eligible")
CTES["any_recs"] = ranked("any_matches")
CTES["choosy_eligible"] = matched("choosy")
CTES["choosy_matches"] = scored("choosy_eligible")
CTES["choosy_recs"] = ranked("choosy_matches")
CTES["counted"] = """
    SELECT p.profile_id, p.lang, coalesce(max(total), 0) AS total, count(r.profile_id) AS shown,
        count(*) FILTER (category = 'Target') AS n_target,
        count(*) FILTER (category = 'Reach') AS n_reach,
        count(*) FILTER (category = 'Safe') AS n_safe,
        count(*) FILTER (institute_type = 'IIT') AS n_iit,
        count(*) FILTER (institute_type = 'NIT') AS n_nit,
        count(*) FILTER (institute_type = 'IIIT') AS n_iiit,
        count(*) FILTER (institute_type = 'GFTI') AS n_gfti
    FROM profiles p LEFT JOIN recs r USING (profile_id) GROUP BY p.profile_id, p.lang"""
# one row per order line: its customer as the candidate, its cutoff as the program
CTES["applications"] = """
    SELECT p.profile_id, p.gender, p.home_state, p.goal, p.seat_category, p.brand_branch_ratio,
        p.branch_preferences, c.*,
        CASE WHEN exam = 'advanced' THEN adv_rank ELSE mains_rank END AS rank
    FROM cutoffs c JOIN choosy p ON p.profile_id = c.applicant"""
