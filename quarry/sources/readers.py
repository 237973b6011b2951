"""Sources: CSV with explicit policies, JSON, model files, checkpoint listings, literals, synthetic tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import episode_number


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], *, ignore_extra: bool = True, ignore_missing: bool = False, trim: bool = True, quote: str | None = None, comment: str | None = None, skip_empty: bool = True, overflow: str = "throw", decimal_comma: bool = False) -> DataFrame:
    """Named columns of a CSV file with a header, cast to the types given (DDL names), whatever their order in the file.

    Header policies: columns that aren't asked for are ignored, or an error; missing ones an error, or null. `quote` None: no
    quotes; '"': doubled quotes are unescaped. `comment`: lines that begin with it are skipped. `overflow` for numbers that
    don't parse or fit: throw, null, or clamp (whole numbers, to the type's limits). Files are split over tasks; CRLF is fine. Blank lines
    of the file are no rows; with `skip_empty`, lines of nothing but separators aren't either. A row stays whatever its cast columns are.
    """
    reader = spark.read.option("header", True).option("quote", quote or "").option("escape", quote or "\\").option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("enforceSchema", False)
    raw = (reader.option("comment", comment) if comment else reader).csv(path)
    names = [c.strip() for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError("a column stands twice in the header")
    missing, extra = [c for c in columns if c not in names], [c for c in names if c not in columns]
    if missing and not ignore_missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if extra and not ignore_extra:
        raise ValueError(f"columns that weren't asked for: {', '.join(extra)}")
    raw = raw.toDF(*names)
    raw = raw.dropna("all") if skip_empty and len(names) > 1 else raw
    cast = [number(F.col(c), kind, overflow, decimal_comma).alias(c) if c in names else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]
    return raw.select(*cast)


def number(text: Column, kind: str, overflow: str = "throw", decimal_comma: bool = False) -> Column:
    """A text cast to a type under an overflow policy."""
    text = F.regexp_replace(text, ",", ".") if decimal_comma and kind in ("float", "double") else text
    if overflow == "throw" or kind == "string":
        return text.cast(kind)
    if overflow == "null":
        return text.try_cast(kind)
    limits = {"byte": 8, "tinyint": 8, "short": 16, "smallint": 16, "int": 32, "long": 64, "bigint": 64}
    if overflow == "clamp" and kind in limits:
        top = (1 << (limits[kind] - 1)) - 1
        wide = text.try_cast("decimal(38,0)")
        return F.when(wide > top, F.lit(top)).when(wide < -top - 1, F.lit(-top - 1)).otherwise(wide).cast(kind)
    return text.try_cast(kind)


def read_lines(spark: SparkSession, path: str, single_comment: str | None = None, skip_empty: bool = False, longest: int | None = None) -> DataFrame:
    """(value): lines without carriage returns; optionally without comment lines and empty ones. A line of more than `longest`
    characters is an error."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"))
    lines = lines.filter(~F.ltrim("value").startswith(single_comment)) if single_comment else lines
    lines = lines.filter(F.trim("value") != "") if skip_empty else lines
    if longest is None:
        return lines
    return lines.select(F.when(F.length("value") > longest, F.raise_error(F.lit(f"a line of more than {longest} characters")).cast("string")).otherwise(F.col("value")).alias("value"))


def literal(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """(row_id, x) of a matrix given in the program; rows of unequal length raise ValueError."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of unequal length")
    schema = T.StructType([T.StructField("row_id", T.LongType(), False), T.StructField("x", T.ArrayType(T.DoubleType()), False)])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], schema)


def iris(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, x of four features, species, y 0/1/2) of an Iris table; features are parsed as 32-bit floats."""
    columns = ["SepalLengthCm", "SepalWidthCm", "PetalLengthCm", "PetalWidthCm"]
    raw = read_csv(spark, path, {"Id": "long", **dict.fromkeys(columns, "float"), "Species": "string"})
    species = ["Iris-setosa", "Iris-versicolor", "Iris-virginica"]
    label = F.coalesce(*[F.when(F.col("Species") == s, F.lit(float(k))) for k, s in enumerate(species)])
    return raw.select((F.col("Id") - 1).alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col("Species").alias("species"), label.alias("y"))


def tracks(spark: SparkSession, path: str, limit: int = 170_000) -> DataFrame:
    """(name, artists, x of seven audio features) of a track table, at most `limit` rows as read."""
    columns = ["valence", "acousticness", "danceability", "energy", "instrumentalness", "liveness", "speechiness"]
    raw = read_csv(spark, path, {**dict.fromkeys(columns, "float"), "name": "string", "artists": "string"}, quote='"')
    return raw.limit(limit).select("name", "artists", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def checkpoints(spark: SparkSession, path: str, suffix: str = ".model") -> DataFrame:
    """(path, episode) of the models under a folder, files or folders of files: -2 for the best, -1 for the final one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    models = files.select(F.regexp_extract("path", f"^(.*?[^/]{re.escape(suffix)})(/|$)", 1).alias("path")).filter("path != ''").distinct()
    return models.select("path", episode_number(F.col("path")).alias("episode"))


def grid(spark: SparkSession, side: int, low: float, high: float) -> DataFrame:
    """(row_id, x): side * side points, evenly spaced."""
    step = (high - low) / (side - 1)
    return spark.range(side * side).select(F.col("id").alias("row_id"), F.array(F.lit(low) + F.floor(F.col("id") / side) * F.lit(step), F.lit(low) + (F.col("id") % side) * F.lit(step)).alias("x"))


def xor_grid(spark: SparkSession, side: int = 10, cross: bool = False) -> DataFrame:
    points = grid(spark, side, -1.0, 1.0)
    a, b = F.col("x")[0], F.col("x")[1]
    out = points.withColumn("y", ((a > 0) != (b > 0)).cast("double"))
    return out.withColumn("x", F.array(a, b, a * b)) if cross else out


def logistic_grid(spark: SparkSession, side: int = 8) -> DataFrame:
    return grid(spark, side, -1.5, 1.5).withColumn("y", (F.col("x")[0] + F.lit(0.75) * F.col("x")[1] > 0.1).cast("double"))


def circles(spark: SparkSession, n: int = 1000, inner: float = 1.0, outer: float = 3.0) -> DataFrame:
    """Two circles, interleaved: label -1 on the inner, +1 on the outer."""
    angle, out = F.lit(2 * math.pi) * F.floor(F.col("id") / 2) / F.lit(n / 2), F.col("id") % 2 == 1
    radius = F.when(out, F.lit(outer)).otherwise(F.lit(inner))
    return spark.range(n).select(F.col("id").alias("row_id"), F.array(radius * F.cos(angle), radius * F.sin(angle)).alias("x"), F.when(out, 1.0).otherwise(-1.0).alias("y"))


def noisy_line(spark: SparkSession, n: int = 16, slope: float = 2.5, intercept: float = -0.7, noise: float = 0.03, seed: int = 0) -> DataFrame:
    x = F.rand(seed) * 4 - 2
    return spark.range(n).select(F.col("id").alias("row_id"), x.alias("v")).select("row_id", F.array("v").alias("x"), (F.lit(slope) * F.col("v") + F.lit(intercept) + F.randn(seed + 1) * F.lit(noise)).alias("y"))


def two_blobs(spark: SparkSession, n: int = 16, spread: float = 0.25, seed: int = 0) -> DataFrame:
    right = F.col("id") % 2 == 1
    at = lambda v, s: F.when(right, F.lit(v)).otherwise(F.lit(-v)) + F.randn(s) * F.lit(spread)
    return spark.range(n).select(F.col("id").alias("row_id"), F.array(at(1.2, seed), at(1.0, seed + 1)).alias("x"), right.cast("double").alias("y"))


def wave_surface(spark: SparkSession, side: int = 8) -> DataFrame:
    return grid(spark, side, -1.0, 1.0).withColumn("y", F.sin(F.lit(math.pi) * F.col("x")[0]) + F.lit(0.5) * F.cos(F.lit(math.pi) * F.col("x")[1]))
