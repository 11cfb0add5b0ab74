"""Counts and generated text of recommendation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.dims import tables, values as V
from seatwise.functions import classify
from seatwise.functions.text import filled, western_grouping


def result_counts(profiles: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per profile: the total before truncation, everything else after it.

    A profile has at most ``MAX_RESULTS_CAP`` recommendation rows.
    """
    counted = recommendations.groupBy("profile_id").agg(
        F.max("total").alias("total"),
        F.count("*").alias("shown"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in V.CATEGORIES],
        *[
            F.count_if(F.col("institute_type") == t).alias(f"n_{t.lower()}")
            for t in V.INSTITUTE_TYPES
        ],
    )
    kept = [c for c in ("profile_id", "lang") if c in profiles.columns]
    return profiles.select(*kept).join(counted, "profile_id", "left").fillna(0)


def with_texts(df: DataFrame) -> DataFrame:
    """``texts``, the key -> text map of the row's language, English for an unknown one."""
    maps = tables.wording_maps(df.sparkSession)
    lang = F.when(F.col("lang").isin(V.LANGUAGES), F.col("lang")).otherwise("en")
    return df.withColumn("_lang", lang).join(maps, F.col("_lang") == F.col("text_lang")).drop(
        "_lang", "text_lang"
    )


def text_of(key: Column) -> Column:
    """The text of a key, or the key itself."""
    return F.coalesce(F.try_element_at("texts", key), key)


def join_templates(df: DataFrame, lang: str, key: str) -> DataFrame:
    """``text`` by (language, key), else by (English, key), else the key."""
    dim = tables.wording(df.sparkSession)
    own = dim.select(
        F.col("lang").alias("_own_lang"), F.col("key").alias("_own_key"), F.col("text").alias("_own")
    )
    english = dim.where("lang = 'en'").select(
        F.col("key").alias("_en_key"), F.col("text").alias("_english")
    )
    return (
        df.join(
            F.broadcast(own),
            (F.col(lang) == F.col("_own_lang")) & (F.col(key) == F.col("_own_key")),
            "left",
        )
        .join(F.broadcast(english), F.col(key) == F.col("_en_key"), "left")
        .withColumn("text", F.coalesce("_own", "_english", key))
        .drop("_own_lang", "_own_key", "_own", "_en_key", "_english")
    )


def with_quota_label(df: DataFrame) -> DataFrame:
    """``quota_label`` in the row's language; an unknown code is its own label."""
    label = F.try_element_at("texts", F.concat(F.lit("quota."), "quota"))
    return with_texts(df).withColumn("quota_label", F.coalesce(label, "quota")).drop("texts")


def category_guidance(summary: DataFrame) -> DataFrame:
    """Count and blurb of each category that has rows, in display order."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("category_no"),
            F.lit(c).alias("category"),
            F.col(f"n_{c.lower()}").alias("n"),
        )
        for i, c in enumerate(V.CATEGORIES)
    ])
    listed = summary.select("profile_id", "lang", F.inline(rows)).where("n > 0")
    return with_texts(listed).select(
        "profile_id",
        "category_no",
        "category",
        "n",
        text_of(F.concat(F.lit("blurb."), "category")).alias("blurb"),
    )


def guidance_text(summary: DataFrame) -> DataFrame:
    found = filled(text_of(F.lit("guidance.found")), total=F.col("total"), shown=F.col("shown"))
    return with_texts(summary).select(
        "profile_id",
        F.when(F.col("total") == 0, text_of(F.lit("guidance.empty")))
        .otherwise(found)
        .alias("guidance"),
    )


def goal_guidance(profiles: DataFrame) -> DataFrame:
    return with_texts(profiles).select(
        "profile_id",
        F.coalesce(
            F.try_element_at("texts", F.concat(F.lit("goal."), "goal")), F.lit("")
        ).alias("interest_guidance"),
    )


def profile_notes(profiles: DataFrame, summary: DataFrame) -> DataFrame:
    """Numbered notes per profile, in the fixed order of the conditions."""
    known = F.filter("branch_preferences", lambda p: p.isin(list(V.PREFERENCE_TAGS)))
    wants = F.size(known) > 0
    branches = F.concat_ws(
        ", ", F.transform(known, lambda p: text_of(F.concat(F.lit("pref."), p)))
    )
    category = filled(text_of(F.lit("note.category")), cat=F.col("seat_category"))
    state = filled(text_of(F.lit("note.home_state")), state=F.col("home_state"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("adv_rank").isNull(), text_of(F.lit("note.no_adv"))),
            F.when(F.col("mains_rank").isNull(), text_of(F.lit("note.no_mains"))),
            F.when(
                (F.col("data_mode") == "basic")
                & (F.col("seat_category") != V.DEFAULT_SEAT_CATEGORY),
                category,
            ),
            F.when(~F.col("home_state").isin(V.STATES), state),
            F.when(
                wants & (F.col("total") > 0),
                filled(text_of(F.lit("note.branch_filter")), branches=branches),
            ),
            F.when(
                wants & (F.col("total") == 0),
                filled(text_of(F.lit("note.branch_filter_empty")), branches=branches),
            ),
        )
    )
    totals = summary.select("profile_id", "total")
    return (
        with_texts(profiles.join(totals, "profile_id"))
        .select("profile_id", F.posexplode(notes).alias("note_no", "note"))
    )


def _phrases(spark) -> DataFrame:
    """Ready sentences per language, category, goal match, brand tier and confidence.

    Some hundred rows, so that a result row needs one lookup instead of one per text.
    """

    def each(values: list) -> Column:
        return F.explode(F.array(*map(F.lit, values)))

    rows = spark.range(1).select(each(V.LANGUAGES).alias("lang"))
    for name, values in {
        "category": V.CATEGORIES,
        "matched_interest": [True, False],
        "tier": list(V.BRAND_SCORES),
        "confidence": ["fragile", "medium", "high"],
    }.items():
        rows = rows.select("*", each(values).alias(name))
    fit = F.when(F.col("matched_interest"), text_of(F.lit("reason.matched"))).otherwise(
        text_of(F.lit("reason.unmatched"))
    )
    lead = filled(
        text_of(F.lit("reason.lead")),
        category=F.col("category"),
        fit=fit,
        brand=text_of(F.concat(F.lit("brand."), "tier")),
    )
    then = text_of(F.lit("reason.join"))
    return with_texts(rows).select(
        "lang",
        "category",
        "matched_interest",
        "tier",
        "confidence",
        text_of(F.concat(F.lit("fit."), "category")).alias("fit_label"),
        lead.alias("_lead"),
        F.concat(then, text_of(F.lit("reason.hs"))).alias("_home"),
        F.concat(then, text_of(F.lit("reason.female"))).alias("_female"),
        F.concat(then, text_of(F.lit("reason.special"))).alias("_special"),
        F.concat(F.lit(". "), text_of(F.concat(F.lit("tail."), "confidence"))).alias("_tail"),
    )


def with_reason(df: DataFrame) -> DataFrame:
    """``fit_label``, and ``reason``: lead, the advantages that apply, confidence."""
    keys = ["lang", "category", "matched_interest", "tier", "confidence"]
    lang = F.when(F.col("lang").isin(V.LANGUAGES), F.col("lang")).otherwise("en")
    tier = classify.brand_tier(F.col("institute_type"), F.col("brand_score"))
    rows = df.withColumns({"lang": lang, "tier": tier})
    home, female = F.col("home_state_advantage"), F.col("female_seat_advantage")
    special = home.isNull() & F.col("quota").isin(list(V.SPECIAL_QUOTA_STATES))
    reason = F.concat(
        filled(F.col("_lead"), branch=F.col("branch")),
        F.when(home.isNull(), "").otherwise(filled(F.col("_home"), n=western_grouping(home))),
        F.when(female.isNull(), "").otherwise(
            filled(F.col("_female"), n=western_grouping(female))
        ),
        F.when(special, filled(F.col("_special"), quota=F.col("quota"))).otherwise(""),
        "_tail",
    )
    return (
        rows.join(F.broadcast(_phrases(df.sparkSession)), keys)
        .withColumn("reason", reason)
        .drop("_lead", "_home", "_female", "_special", "_tail", "tier")
    )


def headline(n_target: Column, n_safe: Column, total: Column) -> Column:
    return (
        F.when(total == 0, "adjust")
        .when((n_target > 0) & (n_safe > 0), "good")
        .when(n_target > 0, "options")
        .when(n_safe > 0, "solid")
        .otherwise("stretch")
    )


def share_summary(summary: DataFrame, picks: DataFrame) -> DataFrame:
    """Title, the best matches and the Safe and Reach counts, one line each."""
    listed = F.array_join("picks", ", ")
    target = filled(text_of(F.lit("share.target")), count=F.col("n_target"), picks=listed)
    best = filled(text_of(F.lit("share.picks")), picks=listed)
    counts = filled(
        text_of(F.lit("share.counts")), safe=F.col("n_safe"), reach=F.col("n_reach")
    )
    line = F.when(
        F.col("picks").isNotNull(), F.when(F.col("n_target") > 0, target).otherwise(best)
    )
    return with_texts(summary.join(picks, "profile_id", "left")).select(
        "profile_id",
        F.concat_ws("\n", text_of(F.lit("share.title")), line, counts).alias("share"),
    )
