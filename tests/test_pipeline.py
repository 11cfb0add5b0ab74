import csv
import glob
import random
import re

import pytest
from pyspark.sql import functions as F

import helpers as H
from seatwise import fixtures as fx
from seatwise.dims import values as V
from seatwise.operators import (
    choices as C, cleaning, links, matching as M, profiles as PR, programs as P, results,
    rounds as R, summaries as S,
)
from seatwise.plans.recommend import basic_programs, ingest, ready_seats, recommend, respond
from seatwise.sources import cutoffs as src
from seatwise.sources.records import read_csv_records
from seatwise.sources.round_state import fold_rounds, folded_rounds


def pairs(df):
    return sorted(tuple(r) for r in df.select("profile_id", "program_id").collect())


def test_matching_paths_agree(spark, sf_dir):
    """The join by nodes, with large and small blocks, and literal predicates find the same pairs, each once."""
    seats = fx.seats(spark, sf_dir)
    people = fx.profiles(spark, sf_dir, preferences=True)
    literal = pairs(H.match_programs_unbinned(people, seats))
    assert literal
    assert pairs(M.match_programs(people, seats)) == literal
    assert pairs(M.match_programs(people, seats, block=3)) == literal


def test_hot_key(spark):
    """All profiles and programs on one join key still make every pair once."""
    seats = H.seats(spark, *[{"institute": f"I{i}"} for i in range(70)])
    people = H.profiles(spark, *[{"profile_id": i} for i in range(50)])
    got = pairs(M.match_programs(people, seats, block=8))
    assert len(got) == len(set(got)) == 70 * 50
    narrow = M.narrow_profiles(people)
    left, right = M.split_keys(M.probes_of(narrow), M.listed_programs(seats, narrow), 8)
    worst = right.groupBy(*M.ROUTE, "cell").count().agg(F.max("count")).first()[0]
    assert worst < 35


def test_covering_nodes(spark):
    """The nodes of a stretch of leaves have exactly those below them, at most two a level below octaves."""
    depth = 4
    wide = 1 << depth
    spans = [(a, b) for a in range(0, 4 * wide, 3) for b in range(a - 2, 4 * wide)]
    df = spark.createDataFrame(spans, "first long, last long")
    for a, b, nodes in df.select("*", M.covering_nodes("first", "last", depth)).collect():
        level = [n % (depth + 1) for n in nodes]
        assert all(level.count(k) <= 2 for k in range(depth))
        below = [range((n // (depth + 1)) << k, (n // (depth + 1) + 1) << k) for n, k in zip(nodes, level)]
        assert sorted(leaf for r in below for leaf in r) == list(range(a, b + 1))


def test_covering_nodes_of_wider_trees(spark):
    """With nodes at every second or third level the leaves are the same, and a rank probes fewer nodes."""
    for depth, step in ((4, 2), (5, 2), (5, 3)):
        wide = 1 << depth
        spans = [(a, b) for a in range(0, 3 * wide, 3) for b in range(a - 2, 3 * wide, 2)]
        df = spark.createDataFrame(spans, "first long, last long")
        for a, b, nodes in df.select("*", M.covering_nodes("first", "last", depth, step)).collect():
            level = [n % (depth + 1) for n in nodes]
            assert set(level) <= set(M.levels_of(depth, step))
            assert all(level.count(k) <= 2 * ((1 << step) - 1) for k in range(depth))
            below = [range((n // (depth + 1)) << k, (n // (depth + 1) + 1) << k) for n, k in zip(nodes, level)]
            assert sorted(leaf for r in below for leaf in r) == list(range(a, b + 1))
    person = M.narrow_profiles(H.profiles(spark, {"adv_rank": 1000, "mains_rank": None}))
    reach = person.select(F.size("reach")).first()[0]
    assert M.probes_of(person, 6).count() == 4 * reach


def test_history_of_year_ends_is_one_shuffle(spark, sf_dir):
    """The last rounds of a seat and its history are made where the rows of the seat are."""
    plan = P.program_history(fx.year_ends(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?:_hash#\d+L, )?institute", plan)) == 1


def test_leaves_never_fall(spark):
    ranks = sorted({r for k in range(40) for r in range((1 << k) - 3, (1 << k) + 4)} | set(range(3000)))
    df = spark.createDataFrame([(r,) for r in ranks], "rank long")
    leaves = [r[0] for r in df.orderBy("rank").select(F.expr(M.leaf_of("rank", 4))).collect()]
    assert leaves == sorted(leaves) and leaves[0] == 0
    assert len(set(leaves[ranks.index(1024):ranks.index(2048)])) == 1 << 4


def test_counts_are_those_of_all_pairs(spark, sf_dir):
    """Totals and closing bounds by class from the counted nodes, without making a pair."""
    seats = fx.seats(spark, sf_dir)
    people = fx.profiles(spark, sf_dir, preferences=True)
    narrow = M.narrow_profiles(people)
    alike = M.alike_programs(M.listed_programs(seats, narrow, 3, by_category=True))
    probes = M.probes_of(narrow, 3)
    classes = seats.select("program_id", M._score_classes().alias("classes"))
    goals = narrow.select("profile_id", "goal_no")
    code = F.col("category_no") * M._CATEGORY_UNIT + F.get("classes", "goal_no")
    wanted = (
        M.match_programs(people, seats).join(classes, "program_id").join(goals, "profile_id")
        .groupBy("profile_id", code.alias("class"))
        .agg(F.count("*").alias("n"), F.max("closing_rank").alias("worst_closing"))
    )
    wanted = sorted(map(tuple, wanted.collect()))
    for block in (20, 10_000):
        assert sorted(map(tuple, M.match_counts(probes, alike, block).collect())) == wanted


def test_few_candidates_are_no_match(spark, sf_dir):
    """Nodes bring together few pairs whose rank is outside the band."""
    seats, people = fx.seats(spark, sf_dir), fx.profiles(spark, sf_dir)
    narrow = M.narrow_profiles(people)
    met = M.probes_of(narrow, 4).join(M.listed_programs(seats, narrow, 4), M.ROUTE)
    inside = (F.col("rank") >= F.col("opening_rank") * 0.5) & (F.col("rank") <= F.col("closing_rank") * 1.25)
    found = met.agg(F.count("*").alias("all"), F.count_if(inside).alias("good")).first()
    assert 0 < found["all"] < 1.1 * found["good"]


def test_top_n_is_exact(spark, sf_dir):
    """The counted bound never loses a row: compared with ranking all pairs."""
    seats = fx.seats(spark, sf_dir)
    for limit, block in ((1, 3), (7, 10_000), (500, 20)):
        people = fx.profiles(spark, sf_dir).withColumn("max_results", F.lit(limit))
        got = M.top_matches(people, seats, block).select("profile_id", "position", "institute", "total")
        allpairs = M.match_programs(people, seats).join(
            seats.select("program_id", "institute"), "program_id"
        )
        from pyspark.sql import Window
        from seatwise.functions.scoring import interest_score

        score = interest_score(F.col("weight"), F.col("brand_score"), F.col("ratio"))
        w = Window.partitionBy("profile_id")
        order = w.orderBy("category_no", score.desc(), "closing_rank", "program_id")
        wanted = (
            allpairs.withColumn("position", F.row_number().over(order))
            .withColumn("total", F.count("*").over(w))
            .where(F.col("position") <= limit)
            .select("profile_id", "position", "institute", "total")
        )
        assert got.exceptAll(wanted).count() == 0
        assert wanted.exceptAll(got).count() == 0


def test_candidates_do_not_grow_with_programs(spark):
    """The bound lies close to the N-th match, and a node lists N programs of a score."""
    seats = H.seats(
        spark, *[{"institute": f"I{i}", "opening_rank": 1000, "closing_rank": 30_001 + 10 * i} for i in range(2000)]
    )
    people = H.profiles(spark, {"mains_rank": 30_000, "max_results": 5})
    narrow = M.narrow_profiles(people)
    listed = M.listed_programs(seats, narrow, 5, by_category=True)
    counts = M.match_counts(M.probes_of(narrow, 5), M.alike_programs(listed, 64), 1000, 64)
    bound = M._cutoffs(counts, narrow).first()
    assert bound["total"] == 2000 and 30_041 <= bound["worst_closing"] < 30_700
    first = M.first_listed(listed, 5)
    per_node = first.where("NOT at_end").groupBy(*M.ROUTE, "category_no").count()
    assert per_node.agg(F.max("count")).first()[0] == 5
    assert first.where("at_end").exceptAll(listed.where("at_end")).count() == 0
    got = M.top_matches(people, seats).orderBy("position").select("closing_rank", "total").collect()
    assert [tuple(r) for r in got] == [(30_001 + 10 * i, 2000) for i in range(5)]


def test_only_the_bounds_category_is_counted_in_detail(spark, monkeypatch):
    """Other categories are one class a profile, a wide one gets a closer bound, and octaves nobody asks for are not listed."""
    rows = [{"institute": f"S{i}", "brand_score": 0.4 + i % 5 / 10, "opening_rank": 1100 + i, "closing_rank": 1500 + 7 * i}
            for i in range(60)]
    rows += [{"institute": f"T{i}", "opening_rank": 500, "closing_rank": 1001 + i} for i in range(9)]
    rows += [{"institute": f"L{i}", "opening_rank": 900_000, "closing_rank": 990_000} for i in range(9)]
    seats = H.seats(spark, *rows)
    people = H.profiles(
        spark, {"mains_rank": 1000, "max_results": 5}, {"profile_id": 2, "mains_rank": 1000, "max_results": 12},
        {"profile_id": 3, "mains_rank": 1000, "max_results": 99}, {"profile_id": 4, "mains_rank": 1000, "max_results": 0},
        {"profile_id": 5, "mains_rank": 700, "max_results": 3},
    )
    narrow = M.narrow_profiles(people)
    listed = M.listed_programs(seats, narrow, 5, by_category=True)
    counts = M.match_counts(M.probes_of(narrow, 5), M.alike_programs(listed, 16, 0), 1000, 16)
    whole = counts.where(F.col("class") >= M._CATEGORY_UNIT).groupBy("profile_id").count()
    assert {r["count"] for r in whole.collect()} == {1}
    bounds = {r["profile_id"]: r for r in M.bounded_profiles(seats, narrow, 5, 16, 1000).collect()}
    assert [bounds[i]["worst_category"] for i in (1, 2, 3)] == [0, 2, 2]
    assert bounds[2]["worst_score"] > 0 and bounds[3]["worst_score"] == 0
    safe = M.listed_programs(seats, narrow.withColumn("category_no", F.lit(2)), 5, by_category=True)
    assert safe.select("category_no").distinct().collect()[0][0] == 2
    assert safe.where("closing_rank = 990000").isEmpty() and not listed.where("closing_rank = 990000").isEmpty()
    got = M.top_matches(people, seats).groupBy("profile_id").agg(F.count("*"), F.max("total")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 69), (2, 12, 69), (3, 69, 69), (5, 3, 69)]
    best = M.top_matches(people, seats).where("profile_id = 2").orderBy("position").select("institute").collect()
    assert [r[0] for r in best] == [f"T{i}" for i in range(9)] + ["S4", "S9", "S14"]


def test_a_node_s_alike_programs_are_summed_before_the_shuffle(spark):
    """Programs that share nodes and kinds are in one task, wherever their institutes are in the sort order."""
    kinds = [{"seat_type": s, "closing_rank": c} for s in ("OPEN", "SC") for c in (20_000, 45_000)]
    seats = H.seats(
        spark, *[{"institute": f"I{i}", "opening_rank": k["closing_rank"] - 5000, **k} for i in range(40) for k in kinds]
    )
    spread = seats.repartition(8, "institute")
    near_by = M.clustered_programs(spread)
    assert near_by.count() == seats.count() == 160
    assert {r[0] for r in near_by.select("program_id").collect()} == {r[0] for r in seats.select("program_id").collect()}
    files = near_by.select("seat_type", "closing_rank", F.input_file_name().alias("file")).distinct()
    assert files.count() == 4


def test_seats_are_made_once_for_the_sort(spark, monkeypatch):
    """A sort by ranges reads its input twice, so what it reads is written."""
    sorted_rows, found = [], M.with_match_columns
    monkeypatch.setattr(M, "with_match_columns", lambda df: sorted_rows.append(df) or found(df))
    seats = H.seats(spark, {}, {"institute": "Other"})
    assert seats.count() == 2 and sorted_rows[0].inputFiles()


def test_programs_of_a_kind_are_judged_together(spark):
    """A node has a row for the programs of a kind, at most N in each, and loses none that it listed."""
    seats = H.seats(spark, *[{"institute": f"I{i}", "opening_rank": 1000, "closing_rank": 30_001 + i // 4} for i in range(90)])
    narrow = M.narrow_profiles(H.profiles(spark, {"mains_rank": 30_000}))
    listed = M.listed_programs(seats, narrow, 5, by_category=True)
    groups = M.first_groups(listed, 7)
    one = [*M.ROUTE, "category_no", "at_end", "program_id"]
    single = groups.select("*", F.col("programs.program_id").alias("id")).select(*one[:-1], F.explode("id").alias("program_id"))
    first = M.first_listed(listed, 7).select(*one)
    assert single.exceptAll(first).isEmpty() and first.exceptAll(single).isEmpty() and not first.isEmpty()
    assert groups.agg(F.max(F.size("programs"))).first()[0] == 7
    assert groups.where("NOT at_end").groupBy(*M.ROUTE, "category_no").count().agg(F.max("count")).first()[0] == 1


def test_kinds_do_not_grow_with_states(spark):
    """Seats barred for their own state are counted for all, less those of the home state, wherever that is unknown."""
    rows = [{"institute": f"I{s}", "quota": "OS", "institute_state": s, "closing_rank": 9000} for s in [*V.STATES[:9], None]]
    seats = H.seats(spark, *rows, {"institute": "A", "closing_rank": 9000})
    homes = [V.STATES[0], V.STATES[1], "Elsewhere", None]
    people = H.profiles(spark, *[{"profile_id": i, "home_state": s, "mains_rank": 2000} for i, s in enumerate(homes)])
    narrow = M.narrow_profiles(people)
    alike = M.alike_programs(M.listed_programs(seats, narrow, 5, by_category=True), 16)
    out = M._by_home_state(alike).where("route LIKE '%|out' AND NOT at_end")
    assert out.groupBy(*M.ROUTE, "category_no").count().agg(F.max("count")).first()[0] == 1
    counts = M.match_counts(M.probes_of(narrow, 5), alike, 1000, 16).groupBy("profile_id").agg(F.sum("n"))
    made = M.match_programs(people, seats).groupBy("profile_id").count()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, made.collect())) == [(0, 10), (1, 10), (2, 11), (3, 2)]
    top = M.top_matches(people, seats).groupBy("profile_id").agg(F.count("*"), F.max("total")).collect()
    assert sorted(map(tuple, top)) == [(0, 10, 10), (1, 10, 10), (2, 11, 11), (3, 2, 2)]


def test_routes_of_different_keys_differ(spark):
    """Texts that run into each other make no common route."""
    keys = [("extended", "mains", "A", "B|any"), ("extended", "mains", "AB", "|any"), ("extended", "mains", "1:A", "B|any"),
            ("extended", "mains", "", "AB|any"), ("extended", "mains", "A1", ":B|any")]
    df = spark.createDataFrame(keys, "data_mode string, exam string, seat_key string, access string")
    assert df.select(M._route()).distinct().count() == len(keys)
    nulls = spark.createDataFrame([("extended", "mains", None, "x")], df.schema)
    assert nulls.select(M._route()).first()[0] is None


def test_derived_rows_are_shuffled_once_and_not_sorted(spark, sf_dir, monkeypatch):
    """Large tables are joined by hash tables of their keys, and the rows are spread by the first of these keys."""
    plain = fx.cutoffs(spark, sf_dir)
    assert "RoundRobin" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(fx, "HASHED_ROWS", 0)
    large = fx.cutoffs(spark, sf_dir)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == 1
    assert large.count() == plain.count() > 0 and large.exceptAll(plain).count() == 0


def test_first_load_is_reduced_once(spark, tmp_path, monkeypatch):
    """Where nothing has been folded yet, the load is the table; later loads are merged with it."""
    reduce, calls = R.LastRound.last, []
    monkeypatch.setattr(R.LastRound, "last", lambda *args: calls.append(1) or reduce(*args))
    df = raw(spark, {"round": "1"}, {"round": "2"})
    fold_rounds(df, str(tmp_path / "t"), "clean")
    assert len(calls) == 1 and folded_rounds(spark, str(tmp_path / "t"), "clean").count() == 1
    fold_rounds(df, str(tmp_path / "t"), "clean")
    assert len(calls) == 3 and folded_rounds(spark, str(tmp_path / "t"), "clean").count() == 1


def test_results_properties(spark, sf_dir):
    people = fx.profiles(spark, sf_dir)
    recs = recommend(people, fx.seats(spark, sf_dir)).cache()
    bad = recs.where(
        (F.col("rank") < 0.5 * F.col("opening_rank"))
        | (F.col("rank") > 1.25 * F.col("closing_rank"))
        | (F.col("reason") == "")
        | F.col("reason").contains("{")
    )
    assert bad.count() == 0
    counts = results.result_counts(people, recs)
    wrong = counts.where(
        "n_target + n_reach + n_safe <> shown or n_iit + n_nit + n_iiit + n_gfti <> shown "
        "or shown <> least(total, 60)"
    )
    assert wrong.count() == 0
    assert counts.count() == people.count()
    recs.unpersist()


def test_row_order_does_not_matter(spark, sf_dir):
    people = fx.profiles(spark, sf_dir)
    seats = fx.seats(spark, sf_dir)
    shuffled = ready_seats(
        seats.drop("program_id", "tag_mask", "goal_weights", "access").orderBy(F.rand(7))
    )
    columns = ["profile_id", "position", "institute", "branch", "quota", "opening_rank"]
    a = recommend(people, seats, texts=False).select(*columns)
    b = recommend(people.orderBy(F.rand(3)), shuffled, texts=False).select(*columns)
    assert a.exceptAll(b).count() == 0


def test_seat_categories_and_modes(spark):
    seats = H.seats(spark, {"seat_type": "OPEN"}, {"seat_type": "SC"})
    basic = ready_seats(
        H.seats(spark, {"seat_type": "OPEN"}, {"seat_type": "SC"}, mode="basic").drop("program_id")
    )
    people = H.profiles(
        spark,
        {"profile_id": 1},
        {"profile_id": 2, "seat_category": ""},
        {"profile_id": 3, "seat_category": "PwD"},
    )
    found = recommend(people, seats).groupBy("profile_id").count().collect()
    assert dict(found) == {1: 1, 2: 2}
    both = ready_seats(
        seats.select(basic.columns).unionByName(basic).drop("program_id")
    )
    mixed = people.withColumn(
        "data_mode", F.when(F.col("profile_id") == 3, "basic").otherwise("extended")
    )
    found = recommend(mixed, both).groupBy("profile_id").count().collect()
    assert dict(found) == {1: 1, 2: 2, 3: 2}
    in_basic = people.withColumn("data_mode", F.lit("basic"))
    found = recommend(in_basic, basic).groupBy("profile_id").count().collect()
    assert dict(found) == {1: 2, 2: 2, 3: 2}


def test_reference_cases(spark):
    iit = {
        "institute": "Indian Institute of Technology Bombay", "institute_type": "IIT",
        "exam": "advanced",
    }
    mech = {"branch": "ME", "branch_full": "Mechanical Engineering"}
    far = {"institute": "Far", "opening_rank": 50000, "closing_rank": 60000}
    seats = H.seats(spark, {}, iit, mech, far)

    def found(**profile):
        rows = recommend(H.profiles(spark, profile), seats).orderBy("position").collect()
        return [(r["institute"], r["branch"]) for r in rows]

    # no Advanced rank: no IIT; interest puts the computing branch first
    assert found() == [("Test Institute", "CSE"), ("Test Institute", "ME")]
    assert found(mains_rank=None, adv_rank=1500) == [(iit["institute"], "CSE")]
    assert found(branch_preferences=["cs_it"]) == [("Test Institute", "CSE")]
    assert len(found(branch_preferences=["any", "not-a-branch"])) == 2
    assert found(mains_rank=100) == []
    assert found(max_results=1) == [("Test Institute", "CSE")]


def test_advantages(spark):
    seats = P.with_advantages(
        H.programs(
            spark,
            {"quota": "HS", "closing_rank": 5000},
            {"quota": "OS", "closing_rank": 9000},
            {"quota": "AI", "closing_rank": 3000},
            {"quota": "AI", "closing_rank": 5500, "gender_pool": "female"},
        )
    )
    rows = {(r.quota, r.gender_pool): r for r in seats.collect()}
    assert rows["HS", "neutral"].home_state_advantage == 4000
    assert rows["OS", "neutral"].home_state_advantage is None
    assert rows["AI", "female"].female_seat_advantage == 2500
    assert rows["AI", "neutral"].female_seat_advantage is None


def test_special_quota_reason(spark):
    seats = H.seats(spark, {"quota": "GO"})
    row = recommend(H.profiles(spark, {"home_state": "Goa"}), seats).first()
    assert ", and the GO quota is open to you. " in row["reason"]


RAW = "institute string, program string, quota string, seat_type string, gender string, " \
    "opening_rank string, closing_rank string, year string, round string, line bigint"


def raw(spark, *rows):
    base = ("I", "P (4 Years, B)", "AI", "OPEN", "Gender-Neutral", "1", None, "2025", "1")
    names = [f.split()[0] for f in RAW.split(", ")]
    full = []
    for i, change in enumerate(rows):
        row = dict(zip(names, (*base, i)))
        row["closing_rank"] = str(100 + i)
        full.append(tuple({**row, **change}.values()))
    return spark.createDataFrame(full, RAW)


def kept(df):
    return sorted(int(r.closing_rank) for r in df.collect())


def test_tied_rounds(spark):
    df = raw(spark, {}, {})
    assert kept(R.last_round_programs(cleaning.typed_cutoffs(df))) == [100]
    assert kept(R.last_round_history(cleaning.typed_cutoffs(df))) == [101]
    assert kept(R.last_round_clean(df)) == [101]
    assert kept(R.last_round_notebook(df)) == [100]


def test_unparseable_round(spark):
    df = raw(spark, {"round": "final"}, {})
    assert kept(R.last_round_programs(cleaning.typed_cutoffs(df))) == [101]
    assert kept(R.last_round_history(cleaning.typed_cutoffs(df))) == [101]
    assert kept(R.last_round_clean(df)) == [100]
    assert kept(R.last_round_notebook(df)) == [101]
    only = raw(spark, {"round": "final"})
    assert kept(R.last_round_programs(cleaning.typed_cutoffs(only))) == [100]
    assert kept(R.last_round_notebook(only)) == []


def test_null_quota(spark):
    df = raw(spark, {"quota": None})
    assert kept(R.last_round_programs(cleaning.typed_cutoffs(df))) == []
    assert R.last_round_history(cleaning.typed_cutoffs(df)).first()["quota"] == "AI"
    assert kept(R.last_round_clean(df)) == [100]
    assert kept(R.last_round_notebook(df)) == []
    # without a round column nothing is reduced and the default shows
    no_round = cleaning.typed_cutoffs(df.drop("round"))
    assert P.build_programs(R.last_round_programs(no_round)).first()["quota"] == "AI"


def test_history_of_two_spellings(spark):
    df = cleaning.typed_cutoffs(
        raw(
            spark,
            {"gender": "Female", "round": "5"},
            {"gender": "F", "round": "6"},
            {"gender": "F", "round": "2", "year": "2024"},
            {"gender": "F", "year": None, "round": "7"},
        )
    )
    rows = P.program_history(R.last_round_history(df)).collect()
    assert [(r.history, r.years) for r in rows] == [({2024: 102, 2025: 103}, 2)]


@pytest.mark.parametrize("rule", ["programs", "history", "clean", "notebook"])
def test_folded_loads(spark, tmp_path, rule):
    """Loads in any order give the rows of one reduction, and leave the files of other years alone."""
    df = raw(
        spark,
        {}, {"round": "2"}, {"round": "2"}, {"round": "final"}, {"round": None, "quota": None},
        {"year": "2024"}, {"year": "2024", "gender": "F"}, {"year": "2024", "gender": "Female "}, {"year": None},
        {"year": "2023", "institute": None}, {"year": "2023", "round": "3"}, {"year": "2023", "round": "3"},
    )
    if rule in ("programs", "history"):
        df = cleaning.typed_cutoffs(df)
    loads = [df.where(F.col("line") % 3 == k) for k in (2, 0, 1)]
    path = str(tmp_path / "state")
    for load in loads:
        fold_rounds(load, path, rule)
    wanted = R.RULES[rule].last(R.RULES[rule].rows(df, ["line"]), ["line"])
    columns = [c for c in [*R.HISTORY_KEY, "gender", "year", "closing_rank", "line"] if c in wanted.columns]
    rows_of = lambda d: sorted(map(tuple, d.select(*columns).collect()), key=repr)
    state = lambda: rows_of(spark.read.schema(wanted.schema).parquet(path))
    assert state() == rows_of(wanted) and len(state()) > 2
    files = lambda year: set(glob.glob(f"{path}/year={year}*/*.parquet"))
    before = {y: files(y) for y in (2023, 2024, 2025)}
    assert all(before.values())
    fold_rounds(df.where("year = 2024"), path, rule)
    fold_rounds(df.where("year = 1900"), path, rule)
    assert state() == rows_of(wanted)
    assert files(2023) == before[2023] and files(2025) == before[2025] and files(2024) != before[2024]
    assert len(folded_rounds(spark, path, rule).columns) >= 7


def test_incomplete_rows(spark):
    df = raw(spark, {}, {"closing_rank": "12P"}, {"institute": None}, {"opening_rank": "inf"})
    assert kept(cleaning.typed_cutoffs(df)) == [100]


def test_ingest_to_recommendations(spark):
    df = raw(
        spark,
        {"year": "2024", "closing_rank": "1000"},
        {"closing_rank": "2000", "opening_rank": "1000"},
    )
    seats = ingest(df)
    row = recommend(H.profiles(spark, {}), seats).first()
    assert row["history"] == {2024: 1000, 2025: 2000}
    assert row["sigma"] == 500.0
    assert (row["branch"], row["degree"]) == ("P", "B")


def test_basic_null_quota_is_open_to_all(spark):
    seats = ready_seats(basic_programs(cleaning.typed_cutoffs(
        raw(spark, {"quota": None, "closing_rank": "2000", "opening_rank": "1000"})
    )))
    people = H.profiles(spark, {"data_mode": "basic"})
    assert recommend(people, seats).count() == 1


def test_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "Seat Type,Institute,Academic Program Name,Quota,Gender,Opening Rank,Closing Rank,Year,Round\n"
        'OPEN,"I, ""A""",P (B),AI,F,1,2,2025,1\n'
        "OPEN,I2,P,NA,n/a,3,4,,2\n"
    )
    df = src.read_cutoffs(spark, str(path), with_line=True)
    rows = df.orderBy("line").collect()
    assert rows[0]["institute"] == 'I, "A"'
    assert (rows[1]["quota"], rows[1]["gender"], rows[1]["year"]) == (None, None, None)
    with pytest.raises(ValueError, match="Quota"):
        src.require_columns(spark.read.csv(str(path), header=True).drop("Quota"), list(V.SOURCE_COLUMNS))
    out = str(tmp_path / "out")
    src.write_last_round(R.last_round_clean(df), out)
    back = src.read_cutoffs(spark, out)
    assert sorted(r.institute for r in back.collect()) == ['I, "A"', "I2"]
    assert "year" not in src.read_snapshot(spark, str(path)).columns


def test_materialise_and_load(spark, tmp_path):
    path = str(tmp_path / "programs")
    df = cleaning.typed_cutoffs(raw(spark, {}, {"year": "2024"}))
    assert src.materialise(df, path).count() == 2
    assert glob.glob(path + "/year=2024/*.parquet")
    assert src.materialise(df).where("year = 2024").count() == 1
    other = str(tmp_path / "basic")
    src.materialise(df.limit(1), other)
    paths = {"extended": path, "basic": other}
    assert src.load_programs(spark, paths, "extended").count() == 2
    assert src.load_programs(spark, paths, "anything").count() == 1
    assert src.load_programs(spark, paths, "extended", allow_toggle=False).count() == 1


def test_validation(spark):
    people = H.profiles(
        spark,
        {"profile_id": 1, "home_state": " tamil nadu "},
        {"profile_id": 2, "mains_rank": None},
        {"profile_id": 3, "lang": "fr"},
        {"profile_id": 4, "max_results": 0},
        {"profile_id": 5, "lang": None, "max_results": None},
    )
    valid, rejected = PR.validate_profiles(people)
    states = {r.profile_id: (r.home_state, r.lang, r.max_results) for r in valid.collect()}
    assert states == {1: ("Tamil Nadu", "en", 60), 5: ("Rajasthan", "en", 60)}
    assert {r.profile_id: r.reason for r in rejected.collect()} == {
        2: "no rank", 3: "lang", 4: "max_results",
    }


def test_notes(spark):
    people = H.profiles(
        spark,
        {"profile_id": 1},
        {"profile_id": 2, "seat_category": "SC", "data_mode": "basic", "home_state": "Mars"},
        {"profile_id": 3, "branch_preferences": ["civil", "x"], "adv_rank": 3},
    )
    seats = H.seats(spark, {})
    summary = results.result_counts(people, recommend(people, seats))
    notes = {}
    for r in results.profile_notes(people, summary).orderBy("profile_id", "note_no").collect():
        notes.setdefault(r.profile_id, []).append(r.note)
    assert len(notes[1]) == 1 and "Advanced" in notes[1][0]
    assert "SC" in notes[2][1] and "Mars" in notes[2][2]
    assert notes[3] == ["Nothing fits your preferred branches: Civil."]


def test_quantiles(spark):
    values = [5, 1, 1, 2000, 7, 90000, 3]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = dict(
        (r.probability, r.value)
        for r in S.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.66, 1.0]).collect()
    )
    import numpy as np

    for p, v in got.items():
        assert abs(v - np.quantile(values, p)) < 1e-6


@pytest.mark.parametrize("length, places", [(1000, 1024), (7, 1024), (3, 2)])
def test_reorder_runs(spark, monkeypatch, length, places):
    """Folding in runs gives what one pass over the moves gives, for several run lengths."""
    import random

    monkeypatch.setattr(C, "PLACES", places)
    rng = random.Random(5)
    users = {1: 6, 2: 3, 3: 1, 4: 90}
    rows = [(u, f"I{i}", "B", i) for u, n in users.items() for i in range(n)]
    moves = [(rng.choice([1, 1, 2, 3]), s, rng.randrange(7), rng.randrange(7)) for s in range(150)]
    moves += [(4, s, rng.randrange(95), rng.randrange(95)) for s in range(150, 250)]
    expected = {u: list(range(n)) for u, n in users.items()}
    for u, _, a, b in moves:
        items = expected[u]
        if a != b and a < len(items) and b < len(items):
            items.insert(b, items.pop(a))
    choices = spark.createDataFrame(rows, "user_id bigint, institute string, branch string, seq bigint")
    steps = spark.createDataFrame(moves, "user_id bigint, seq bigint, from_no int, to_no int")
    got = {}
    out = C.choice_reorder(choices, steps, length).orderBy("user_id", "position")
    for r in out.collect():
        got.setdefault(r.user_id, []).append(r.seq)
    assert got == expected


def test_numbering_slices(spark):
    df = spark.range(0, 500, 3).select(
        F.lit(1).alias("user_id"), F.col("id").alias("seq")
    )
    got = C.numbered_by(df).orderBy("seq").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))


def test_numbering_spreads_one_user(spark):
    """Sequence numbers far apart, in several ranges."""
    df = spark.range(0, 3000, numPartitions=6).selectExpr(
        "cast(id % 2 as int) user_id", "1700000000000000 + id * 1000003 seq"
    )
    ranged = df.repartitionByRange(5, "user_id", "seq")
    got = C.numbered_by(ranged).orderBy("user_id", "seq").collect()
    assert [r.position for r in got] == [*range(1, 1501)] * 2


def test_one_response(spark, sf_dir):
    people = fx.profiles(spark, sf_dir)
    answer = respond(people, fx.seats(spark, sf_dir))
    rows = answer["rows"].count()
    assert rows and answer["counts"].agg(F.sum("shown")).first()[0] == rows
    for name in ("share", "flags", "guidance", "goal_guidance"):
        assert answer[name].count() == people.count(), name
    assert answer["colleges"].count() and answer["notes"].columns and answer["category_guidance"].count()


def test_export(spark, tmp_path):
    rows = [(1, 'I "x", y', "B", "D", "Safe", 5), (1, "J", "B", "D", "Reach", 2)]
    df = spark.createDataFrame(
        rows, "user_id bigint, institute string, branch string, degree string, category string, seq bigint"
    )
    path = str(tmp_path / "csv")
    src.export_choices(df, path, [1])
    lines = [
        line for f in sorted(glob.glob(path + "/user_id=1/*.txt")) for line in open(f).read().splitlines()
    ]
    assert lines == [
        "Preference Number,Institute,Branch,Degree,Category",
        '1,"J","B","D","Reach"',
        '2,"I ""x"", y","B","D","Safe"',
    ]


def test_export_of_all_users(spark, tmp_path):
    rows = [(u, "I", "B", "D", "Safe", u) for u in (3, 1)]
    df = spark.createDataFrame(
        rows, "user_id bigint, institute string, branch string, degree string, category string, seq bigint"
    )
    src.export_choices(df, str(tmp_path / "csv"))
    files = sorted(glob.glob(str(tmp_path / "csv/*.txt")))
    lines = [line for f in files for line in open(f).read().splitlines()]
    assert lines == [
        f"1,{src.EXPORT_HEADER}", '1,1,"I","B","D","Safe"', f"3,{src.EXPORT_HEADER}", '3,1,"I","B","D","Safe"'
    ]


def test_links_like_a_browser(spark):
    """Odd characters, stray percent signs, repeated keys and fragments lose no link."""
    base = "https://example.org/"
    urls = {
        "?m=5&q=a b": "a b", "?m=5&q=100%": "100%", "?m=5&q=x|y": "x|y", "?m=5&q=%zz": "%zz",
        "?m=5&q=a+b%20c&q=later#q=frag": "a b c", "?m=5&q": "", "?m=5&q=a=b": "a=b", "?%6d=5&q=%C3%A9": "é",
    }
    rows = [(base + u, w) for u, w in urls.items()] + [(base, "none"), (base + "#?m=5", "none"), (base + "?", "none")]
    df = spark.createDataFrame(rows, "url string, expected string")
    got = links.linked_profiles(df).collect()
    assert sorted((r.expected, r.needle, r.mains_rank) for r in got) == sorted((w, w, 5) for w in urls.values())


@pytest.mark.parametrize("multiline", [True, "split"])
def test_files_with_other_columns_and_line_breaks(spark, tmp_path, multiline):
    one, two = tmp_path / "in/a.csv", tmp_path / "in/b.csv"
    one.parent.mkdir()
    names = list(V.SOURCE_COLUMNS)
    one.write_text(",".join(names) + "\n" + ",".join(f"x{n}" for n in names) + "\n")
    other = names[::-1]
    two.write_text(",".join(other) + "\n" + ",".join(f'"y\n{n}"' for n in other) + "\n")
    rows = src.read_cutoffs(spark, str(one.parent), with_line=True, multiline=multiline).orderBy("line").collect()
    assert len(rows) == 2
    for source, name in V.SOURCE_COLUMNS.items():
        assert (rows[0][name], rows[1][name]) == (f"x{source}", f"y\n{source}")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        src.read_cutoffs(spark, str(two)).collect()
    src.read_cutoffs(spark, str(one)).write.parquet(str(tmp_path / "kept"))
    back = spark.read.parquet(str(tmp_path / "kept")).withColumnsRenamed({v: k for k, v in V.SOURCE_COLUMNS.items()})
    back.write.parquet(str(tmp_path / "plain"))
    assert src.read_cutoffs(spark, str(tmp_path / "plain"), format="parquet").count() == 1


@pytest.mark.parametrize("piece", ["64b", "1kb", "1mb"])
def test_records_over_lines_and_splits(spark, tmp_path, piece):
    """As read whole by Spark, whatever the splits; line ends, quotes, commas and empty lines within texts."""
    rng = random.Random(7)
    bits = ["a", "bb", "\n", "\n\n", '"', '""', ",", " ", "é", "\n,\"x\"\n", "c" * 90]
    for name, count in [("a", 120), ("b", 40), ("empty", 0)]:
        rows = [["".join(rng.choices(bits, k=rng.randrange(6))) or "-" for _ in range(3)] for _ in range(count)]
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            table = csv.writer(file, lineterminator="\r\n" if name == "b" else "\n")
            table.writerows([["x", "y", "z"], *rows])
    plain = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found, = read_csv_records(spark, str(tmp_path))
        ours = found.orderBy("_line").select("x", "y", "z", "_line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    in_order = plain.select("*", "_metadata.file_path", F.monotonically_increasing_id().alias("n"))
    theirs = in_order.orderBy("file_path", "n").collect()
    assert [r[:3] for r in ours] == [r[:3] for r in theirs]
    assert len({r["_line"]["offset"] for r in ours}) > 1 or piece == "1mb"


def test_broken_records(spark, tmp_path):
    open_end, wide, none = tmp_path / "open.csv", tmp_path / "wide.csv", tmp_path / "none.csv"
    open_end.write_text('x,y\n1,"2\n3,4\n')
    wide.write_text('x,y\n1,"2\n",3\n')
    none.write_text("")
    with pytest.raises(ValueError, match="never closed"):
        read_csv_records(spark, str(open_end))
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_records(spark, str(wide))[0].collect()
    with pytest.raises(ValueError, match="no header"):
        read_csv_records(spark, str(none))


def test_both_datasets_from_files(spark, tmp_path):
    """The example of the README: profiles get the dataset they ask for, and basic by default."""
    multi, single = tmp_path / "multi.csv", tmp_path / "single.csv"
    head = "Institute,Academic Program Name,Quota,Seat Type,Gender,Opening Rank,Closing Rank"
    multi.write_text(f"{head},Year,Round\nI2,P (B),AI,OPEN,F,1000,2000,2025,1\n")
    single.write_text(f"{head}\nI1,P (B),AI,OPEN,Gender-Neutral,1000,2000\n")
    seats = ingest(
        src.read_cutoffs(spark, str(multi), with_line=True), snapshot=src.read_snapshot(spark, str(single))
    )
    rows = [(1, None), (2, "extended"), (3, "basic")]
    people = H.profiles(spark, *[{"profile_id": i, "data_mode": m, "gender": "female"} for i, m in rows])
    valid, rejected = PR.validate_profiles(people)
    found = lambda **k: sorted((r.profile_id, r.institute) for r in recommend(valid, seats, **k).collect())
    assert rejected.count() == 0
    assert found() == [(1, "I1"), (2, "I2"), (3, "I1")]
    assert found(allow_toggle=False) == [(1, "I1"), (2, "I1"), (3, "I1")]
    assert found(allow_toggle=False, default="extended") == [(1, "I2"), (2, "I2"), (3, "I2")]


def test_repeated_profiles_are_rejected(spark):
    people = H.profiles(spark, {"profile_id": 1}, {"profile_id": 1}, {"profile_id": 2}, {"profile_id": None})
    valid, rejected = PR.validate_profiles(people)
    assert [r.profile_id for r in valid.collect()] == [2]
    assert sorted(r.reason for r in rejected.collect()) == ["profile_id", "profile_id repeated", "profile_id repeated"]


def test_links_round_trip(spark):
    people = H.profiles(
        spark,
        {"profile_id": 1, "home_state": "Tamil Nadu", "branch_preferences": ["ee", "civil"]},
        {"profile_id": 2, "adv_rank": 7, "mains_rank": None, "gender": "female", "brand_branch_ratio": 1.0},
    ).withColumns(
        {"step": F.lit("results"), "region": F.lit("metro"), "needle": F.lit("x+y & z"), "type": F.lit("")}
    )
    back = links.linked_profiles(links.profile_links(people, "https://example.org/"))
    columns = ["profile_id", "mains_rank", "adv_rank", "gender", "home_state", "goal",
               "branch_preferences", "region", "brand_branch_ratio", "needle", "type", "lang"]
    assert back.select(*columns).exceptAll(people.select(*columns)).count() == 0


def test_shared_folder(spark, monkeypatch):
    from seatwise import session

    monkeypatch.setattr(session, "CHECKPOINT_DIR", "spark.not.set")
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.written(spark.range(3)).count() == 3
    assert glob.glob(folder + "/*/*.parquet")
