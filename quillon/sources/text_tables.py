"""Tables in text files: tracks by timestep, logs, result scans, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def track_rows(spark: SparkSession, path: str, time_column: int = 0, id_column: int | None = None, valid: dict[int, list[str]] | None = None, ignored: dict[int, list[str]] | None = None, convert: dict[int, dict[str, str]] | None = None, drop_negative: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, regions to ignore), each with file, t and fields (strings).

    Fields are parted by commas, semicolons, tabs or blanks, as each line has
    them; blanks at a line's end don't count.  A row is to be ignored where any
    column of `ignored` has one of its values.  Of the others only those stay
    that have a listed value in every column of `valid`, and, with
    `drop_negative`, an id of 0 or more.  `convert` replaces a column's values.
    """
    line = F.rtrim("value")
    comma, semicolon, tab = (F.contains(line, F.lit(c)) for c in ",;\t")
    parts = F.when(comma, F.split(line, r",\s*")).when(semicolon, F.split(line, r";\s*")).when(tab, F.split(line, "\t *")).otherwise(F.split(line, r" +"))
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), parts.alias("fields"))

    def is_in(column: int, values: list[str]):
        return F.lower(F.get("fields", column)).isin(values)

    skip = F.lit(False)
    for c, values in (ignored or {}).items():
        skip = skip | is_in(c, values)
    keep = F.lit(True)
    for c, values in (valid or {}).items():
        keep = keep & is_in(c, values)
    if drop_negative:
        keep = keep & (F.get("fields", id_column).cast("double") >= 0)
    def replaced(fields: Column, column: int, mapping: dict[str, str]) -> Column:
        lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return F.transform(fields, lambda v, i: F.when(i == column, F.coalesce(F.try_element_at(lookup, F.lower(v)), F.raise_error(F.concat(F.lit("no value for "), v)).cast("string"))).otherwise(v))

    converted = F.col("fields")
    for c, mapping in (convert or {}).items():
        converted = replaced(converted, c, mapping)
    shaped = rows.withColumn("t", F.get("fields", time_column).cast("double").cast("int")).withColumn("__q_skip", skip)
    shape = lambda df: df.select("file", "t", converted.alias("fields"))
    return shape(shaped.where(~F.col("__q_skip") & keep)), shape(shaped.where("__q_skip"))


def last_log_row(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file and the values of `keys` in the last line of each JSON-lines file, as strings."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value")
    last = lines.groupBy("file").agg(F.max_by("value", "at").alias("value"))
    return last.select("file", *[F.get_json_object("value", f"$.{k}").alias(k) for k in keys])


def configurations(spark: SparkSession, path: str, name: str, section: str, keys: list[str], skip: str = "/code/") -> DataFrame:
    """path and the values of plain `key: value` lines below `section` of each configuration file of that name."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value").where(~F.contains("path", F.lit(skip)))
    body = F.regexp_extract("value", rf"(?m)^{section}:[ \t]*\r?\n((?:[ \t]+.*\r?\n?|[ \t]*\r?\n)*)", 1)
    rows = files.withColumn("__q_body", body)
    value = lambda k: F.nullif(F.btrim(F.regexp_extract("__q_body", rf"(?m)^[ \t]+{k}:[ \t]*([^#\r\n]*)", 1), F.lit(" '\"")), F.lit(""))
    return rows.select("path", *[value(k).alias(k) for k in keys])


def index_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of CSV files with a header, as strings: quoted fields may hold commas, quotes and line ends; a column that a file lacks is null, empty fields too."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def detailed_rows(spark: SparkSession, path: str, key: str, combined: str = "COMBINED") -> tuple[DataFrame, DataFrame]:
    """(scores per sequence, combined scores) of a detailed CSV report: the key, and all other columns as doubles."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(key, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in rows.columns if c != key])
    return rows.where(F.col(key) != combined), rows.where(F.col(key) == combined).drop(key)


def result_scan(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """subset (the document's folder), metric and value: of each JSON map those entries whose key ends in `suffix`."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    d = d.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("subset"), F.explode(F.from_json("value", "map<string, double>")).alias("metric", "value"))
    return d.where(F.endswith("metric", F.lit(suffix)))


def with_average(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's mean and, with a null key, the mean over the keys."""
    per = scores.groupBy(key).agg(F.avg(value).alias(value))
    return per.unionByName(per.agg(F.avg(value).alias(value)).withColumn(key, F.lit(None).cast(scores.schema[key].dataType)))


def rows_at(tracks: DataFrame, video: str, frame: int, arrays: list[str], default=None) -> DataFrame:
    """The values of one frame of a track's arrays, `default` where it is beyond their end."""
    def at(c):
        value = F.get(F.col(c), frame)
        return value if default is None else F.coalesce(value, F.lit(default))

    return tracks.withColumns({c: at(c) for c in arrays})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that repeat their keys the last one by `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__q_n", n).where("__q_n = 1").drop("__q_n")
