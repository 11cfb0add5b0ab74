import pytest
from pyspark.sql import functions as F

from helpers import one
from seatwise.functions import classify, eligibility, scoring, text as X

c = F.col


def table(spark, build, cases, names):
    """Check many (inputs..., expected) rows in one query."""
    rows = [tuple(case) for case in cases]
    kinds = []
    for i, _ in enumerate([*names, "expected"]):
        sample = next((r[i] for r in rows if r[i] is not None), "")
        kinds.append(
            {bool: "boolean", int: "bigint", float: "double", list: "array<string>"}.get(
                type(sample), "string"
            )
        )
    schema = ", ".join(f"{n} {k}" for n, k in zip([*names, "expected"], kinds))
    df = spark.createDataFrame(rows, schema)
    wrong = df.withColumn("got", build(*map(c, names))).where("not (got <=> expected)")
    assert wrong.collect() == []


def test_band(spark):
    cases = [
        (900, 1000, 2000, "Safe"),
        (1000, 1000, 2000, "Safe"),
        (1500, 1000, 2000, "Target"),
        (2000, 1000, 2000, "Target"),
        (2400, 1000, 2000, "Reach"),
        (2500, 1000, 2000, "Reach"),
        (2501, 1000, 2000, None),
        (2600, 1000, 2000, None),
        (500, 1000, 2000, "Safe"),
        (499, 1000, 2000, None),
        (4500, 5000, 4000, "Safe"),
        (5100, 5000, 4000, None),
        (5500, 6000, 4000, None),
    ]
    table(spark, classify.rank_category, cases, ["rank", "opening", "closing"])


def test_confidence(spark):
    cases = [
        (1000, 1500, "fragile"),
        (1000, 1000, "fragile"),
        (5000, 4000, "fragile"),
        (1000, 4000, "medium"),
        (1000, 8000, "high"),
        (1000, 2000, "medium"),
        (1000, 7000, "high"),
    ]
    table(spark, classify.confidence_band, cases, ["opening", "closing"])


def test_region_and_metro(spark):
    table(
        spark,
        classify.region_of,
        [
            ("Delhi", "north"),
            ("Tamil Nadu", "south"),
            ("West Bengal", "east"),
            ("Maharashtra", "west"),
            ("Assam", "northeast"),
            ("Unknown", "northeast"),
            ("Madhya Pradesh", "northeast"),
        ],
        ["state"],
    )
    table(
        spark,
        classify.is_metro,
        [
            ("IIT Bombay, Mumbai", "Maharashtra", True),
            ("IIT Madras, Chennai", "Tamil Nadu", True),
            ("IIT Delhi", "Delhi", True),
            ("IIT Kharagpur", "West Bengal", False),
            ("NIT Trichy", "Tamil Nadu", False),
        ],
        ["institute", "state"],
    )


def test_institute_type(spark):
    table(
        spark,
        classify.institute_type,
        [
            ("Indian Institute of Technology Bombay", "IIT"),
            ("National Institute of Technology, Warangal", "NIT"),
            ("Indian Institute of Information Technology Guwahati", "IIIT"),
            ("National Institute of Electronics and Information Technology, Ajmer", "IIIT"),
            ("University of Hyderabad", "GFTI"),
        ],
        ["name"],
    )


def test_numeric(spark):
    table(
        spark,
        X.numeric,
        [
            ("123", 123.0),
            (" 12 ", 12.0),
            ("1e3", 1000.0),
            ("12.5", 12.5),
            ("-.5", -0.5),
            ("123P", None),
            ("123d", None),
            ("1,234", None),
            ("inf", None),
            ("nan", None),
            ("0x1p3", None),
            ("", None),
            (None, None),
        ],
        ["text"],
    )


def test_trim(spark):
    table(spark, X.trimmed, [("\t a b  \n", "a b"), ("", ""), (None, None)], ["text"])


def test_gender(spark):
    cases = [
        ("Female-only (including Supernumerary)", "female"),
        (" F ", "female"),
        ("Gender-Neutral", "neutral"),
        (None, "neutral"),
    ]
    table(spark, X.normalised_gender, cases, ["gender"])


def test_split_program(spark):
    cases = [
        ("X (4 Years, B)", "X", "B"),
        ("X (Hons) (4 Years, B)", "X", "B"),
        ("X", "X", ""),
        ("X (B)", "X", "B"),
        (" X (5 Years, A and B (Dual Degree)) ", "X", "A and B (Dual Degree)"),
        ("X (4 Years", "X (4 Years", ""),
    ]
    table(spark, X.program_branch, [(a, b) for a, b, _ in cases], ["program"])
    table(spark, X.program_degree, [(a, d) for a, _, d in cases], ["program"])


def test_rank_texts(spark):
    table(
        spark,
        X.parsed_rank,
        [("12,345", 12345), ("1.5", 15), ("abc", None), ("0", None), ("", None)],
        ["text"],
    )
    table(
        spark,
        X.indian_grouping,
        [(1, "1"), (999, "999"), (1234, "1,234"), (1234567, "12,34,567"), (12345678, "1,23,45,678")],
        ["n"],
    )


def test_tags(spark):
    cases = [
        ("Computer Science and Engineering", ["cse"]),
        ("Mathematics and Computing", ["math_computing"]),
        ("Mathematics", ["math_science"]),
        ("BS in Physics", ["bs_science", "physics"]),
        ("Ceramic Engineering", ["other"]),
        ("Design and Manufacturing", ["production"]),
        ("Engineering CS", ["other"]),
        ("Applied CS Engineering", ["cse"]),
        ("National Institute of Information Technology", ["other"]),
    ]
    table(spark, classify.branch_tags, cases, ["program"])


def test_location(spark):
    cases = [
        ("NIT, Warangal, India", "Telangana", "Warangal"),
        ("Indian Institute of Technology Bombay", "Maharashtra", "Bombay"),
        ("Indian Institute of Information Technology Surat", "Gujarat", "Surat"),
        ("University of Hyderabad", "Telangana", "Telangana"),
    ]
    table(spark, classify.college_location, cases, ["institute", "state"])


def test_quota(spark):
    cases = [
        ("NIT", "HS", "Goa", "Goa", True),
        ("NIT", "HS", "Goa", "Delhi", False),
        ("NIT", "OS", "Goa", "Delhi", True),
        ("NIT", "OS", "Goa", "Goa", False),
        ("NIT", "AI", "Goa", "Delhi", True),
        ("IIT", "HS", "Goa", "Delhi", True),
        ("NIT", "GO", "Kerala", "Goa", True),
        ("NIT", "GO", "Goa", "Kerala", False),
        ("NIT", "JK", "Delhi", "Jammu and Kashmir", True),
        ("NIT", "LA", "Delhi", "Delhi", False),
        ("NIT", "ZZ", "Delhi", "Goa", True),
        ("NIT", "HS", "Unknown", "Unknown", True),
        ("NIT", "OS", "Goa", "nowhere", True),
    ]
    table(spark, eligibility.passes_quota, cases, ["kind", "quota", "state", "home"])
    # the join keys say the same
    def by_key(kind, quota, state, home):
        seat = eligibility.seat_access(F.lit("neutral"), kind, quota, state)
        barred = F.endswith(seat, F.lit("|out")) & (state == home)
        reach = eligibility.profile_access(F.lit("male"), home)
        return F.array_contains(reach, seat) & ~barred

    table(spark, by_key, cases, ["kind", "quota", "state", "home"])


def test_gender_rule(spark):
    cases = [
        ("neutral", "male", True),
        ("female", "male", False),
        ("neutral", "female", True),
        ("female", "female", True),
    ]
    table(spark, eligibility.passes_gender, cases, ["pool", "gender"])


@pytest.mark.parametrize(
    "brand,tags,ratio,score",
    [(0.9, ["cse"], 0.0, 10.0), (0.7, ["civil"], 1.0, 7.0), (0.8, ["cse"], 0.5, 9.0)],
)
def test_score(spark, brand, tags, ratio, score):
    weight = F.get(scoring.goal_weight_array(classify.tag_mask(c("tags"))), scoring.goal_index(F.lit("coding")))
    got = scoring.interest_score(weight, c("brand"), c("ratio"))
    assert one(spark, got, brand=brand, tags=tags, ratio=ratio) == score


def test_probability(spark):
    cases = [
        (5000, 5000, 400.0, 50.0),
        (1, 100000, 5000.0, 100.0),
        (1000000, 1000, 80.0, 0.0),
    ]
    table(spark, scoring.admission_probability, cases, ["rank", "closing", "sigma"])
    steps = [
        r[0]
        for r in spark.range(1, 20000, 250)
        .orderBy("id")
        .select(scoring.admission_probability(c("id"), F.lit(9000), F.lit(700.0)))
        .collect()
    ]
    assert steps == sorted(steps, reverse=True)


def test_volatility(spark):
    cases = [
        (1, 0.0, 10000, 800.0),
        (2, 0.0, 10000, 500.0),
        (3, 900.0, 10000, 900.0),
        (1, 0.0, 50, 10.0),
    ]
    table(spark, scoring.volatility, cases, ["years", "deviation", "closing"])


def test_filled(spark):
    got = X.filled(F.lit("{a} and {b} and {a}"), a=c("a"), b=F.lit(None).cast("string"))
    assert one(spark, got, a="x") == "x and {b} and x"


def test_filled(spark):
    """One pass: values are never read as slots; slots without a value, and unknown ones, stay."""
    cases = [
        ("{a} and {b}", "{b}", "x", "{b} and x"),
        ("{a}{a}{b}", "1", None, "11{b}"),
        ("no slot", "1", "2", "no slot"),
        ("{c} {a", "1", "2", "{c} {a"),
        ("", "1", "2", ""),
        ("}{a}{", "$1\\", "2", "}$1\\{"),
        (None, "1", "2", None),
    ]
    table(spark, lambda t, a, b: X.filled(t, a=a, b=b), cases, ["t", "a", "b"])
