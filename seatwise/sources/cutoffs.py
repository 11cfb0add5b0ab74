"""Reading cutoff tables, choosing a dataset, and writing results."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seatwise.dims import values as V
from seatwise.operators.choices import numbered_choices
from seatwise.session import written
from seatwise.sources.records import read_csv_records

# Texts that count as missing in a cutoff file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def rename_columns(df: DataFrame) -> DataFrame:
    """Source headers to column names; headers that are not there are skipped."""
    return df.withColumnsRenamed({**V.SOURCE_COLUMNS, **V.OPTIONAL_SOURCE_COLUMNS})


def read_cutoffs(
    spark: SparkSession,
    path: str,
    with_line: bool = False,
    format: str | None = None,
    multiline: bool | str = False,
) -> DataFrame:
    """A multi-year cutoff table, every column a string, missing texts as null.

    ``format`` is ``csv`` or ``parquet``; without it the ending of the path decides. CSV columns are
    found by the header of each file, so files may order them differently. A record that spans lines
    needs ``multiline``; without it such a record is an error. ``True`` reads each file in one task.
    ``split`` reads a large file in many, at several times the work: the source is read once, its lines
    are landed, and quotes may stand in quoted texts only.
    ``with_line`` adds an orderable ``line`` that follows the source order, which decides ties
    between rows of one round.
    """
    kind = format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        return _source_columns(spark.read.parquet(path), with_line)
    if multiline == "split":
        tables = [_source_columns(t, with_line, "_line") for t in read_csv_records(spark, path)]
    else:
        tables = [
            _source_columns(_csv_files(spark, header, files, bool(multiline)), with_line)
            for header, files in _headers(spark, path).items()
        ]
    df = tables[0]
    for other in tables[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each header line. As in listing them, the driver gets a row per file."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(row["header"], []).append(row["file"])
    if not found:
        raise ValueError(f"no header in {path}")
    return found


def _csv_files(spark: SparkSession, header: str, files: list[str], multiline: bool) -> DataFrame:
    """Files of one header, which Spark checks against each of them."""
    fields = next(csv.reader([header.removeprefix("\ufeff")]))
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    # a record that was cut at a line break has too few fields
    reader = reader.option("escape", '"').option("multiLine", multiline).option("mode", "FAILFAST")
    return reader.csv(files)


def _source_columns(df: DataFrame, with_line: bool, line: str | None = None) -> DataFrame:
    """Texts of the source; ``line`` names a column that has the place in the file already."""
    require_columns(df, list(V.SOURCE_COLUMNS))
    columns = [_present(c).alias(c) for c in df.columns if c != line]
    if with_line:
        columns.append((F.col(line) if line else source_line()).alias("line"))
    return rename_columns(df.select(*columns))


def source_line() -> Column:
    """File, offset of the split in it, and row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def _present(name: str) -> Column:
    text = F.col(f"`{name}`").cast("string")
    return F.when(~text.isin(MISSING_TEXTS), text)


def read_snapshot(spark: SparkSession, path: str, with_line: bool = False, **options) -> DataFrame:
    """A single-year table without year and round; ``options`` as for ``read_cutoffs``."""
    return read_cutoffs(spark, path, with_line, **options).drop("year", "round")


def effective_mode(requested: Column, allow_toggle: bool, default: str) -> Column:
    """The mode to use: the requested one, unless the caller locks it."""
    mode = requested if allow_toggle else F.lit(default)
    return F.when(mode == "extended", "extended").otherwise("basic")


def load_programs(
    spark: SparkSession,
    paths: dict[str, str],
    mode: str,
    allow_toggle: bool = True,
    default: str = "basic",
) -> DataFrame:
    """The program table of a mode; anything but ``extended`` means ``basic``."""
    chosen = mode if allow_toggle else default
    return spark.read.parquet(paths["extended" if chosen == "extended" else "basic"])


def materialise(df: DataFrame, path: str | None = None, by: str | None = "year") -> DataFrame:
    """Compute once: Parquet at ``path`` (else in the shared folder), split by year if present."""
    parts = [by] if by and by in df.columns else []
    if path is None:
        return written(df, parts)
    writer = df.hint("rebalance", *parts).write.partitionBy(*parts) if parts else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_last_round(df: DataFrame, path: str) -> None:
    names = {v: k for k, v in {**V.SOURCE_COLUMNS, **V.OPTIONAL_SOURCE_COLUMNS}.items()}
    df.drop("line").withColumnsRenamed(names).write.option("header", True).option(
        "escape", '"'
    ).csv(path)


def choice_lines(choices: DataFrame) -> DataFrame:
    """The export's text lines: number bare, texts quoted with inner quotes doubled."""

    def quoted(name: str) -> Column:
        text = F.replace(F.col(name), F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), text, F.lit('"'))

    return numbered_choices(choices).select(
        "user_id",
        "position",
        F.concat_ws(
            ",",
            F.col("position").cast("string"),
            *[quoted(c) for c in ("institute", "branch", "degree", "category")],
        ).alias("line"),
    )


EXPORT_HEADER = "Preference Number,Institute,Branch,Degree,Category"


def export_choices(choices: DataFrame, path: str, users: list[int] | None = None) -> None:
    """Text files with the header and the numbered choices of each user, in order.

    Range partitioning keeps a user's lines in file order even when they span several files. Each
    line starts with the user; only for a given, short list of ``users`` there is a folder each.
    """
    lines = choice_lines(choices)
    if users is not None:
        lines = lines.where(F.col("user_id").isin(users))
    header = lines.where("position = 1").select(
        "user_id", F.lit(0).alias("position"), F.lit(EXPORT_HEADER).alias("line")
    )
    ordered = (
        lines.unionByName(header)
        .repartitionByRange("user_id", "position")
        .sortWithinPartitions("user_id", "position")
    )
    if users is not None:
        ordered.select("user_id", "line").write.partitionBy("user_id").text(path)
    else:
        ordered.select(F.concat_ws(",", F.col("user_id").cast("string"), "line")).write.text(path)
