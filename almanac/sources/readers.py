"""Readers and writers: tables, GeoJSON, CSV, JSON, HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape) of a Feature, a FeatureCollection or a bare geometry; polygons become shapes of one polygon."""
    return features(spark.read.text(path, wholetext=True))


def features(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., name, shape) of the GeoJSON texts in ``value``."""
    polygon = "struct<type: string, coordinates: array<array<array<double>>>>"
    multi = "struct<type: string, coordinates: array<array<array<array<double>>>>>"
    feature = "struct<properties: struct<name: string>, geometry: string>"
    parts = texts.select(*keys, F.from_json("value", f"type string, features array<{feature}>, geometry string, properties struct<name: string>").alias("j"), "value").select(
        *keys,
        F.explode(
            F.when(F.col("j.type") == "FeatureCollection", F.transform("j.features", lambda f: F.struct(f["properties"]["name"].alias("name"), f["geometry"].alias("geometry"))))
            .when(F.col("j.type") == "Feature", F.array(F.struct(F.col("j.properties.name").alias("name"), F.col("j.geometry").alias("geometry"))))
            .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("value").alias("geometry"))))
        ).alias("f")
    )
    geometry = F.col("f.geometry")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.when(F.get_json_object(geometry, "$.type") == "Polygon", F.array(F.from_json(geometry, polygon)["coordinates"])).otherwise(F.from_json(geometry, multi)["coordinates"])
    return parts.select(*keys, F.col("f.name").alias("name"), F.transform(rings, lambda q: F.transform(q, lambda r: F.transform(r, point))).alias("shape"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold commas, line ends and doubled quotes; missing cells are empty strings; blank rows are dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.dropna(how="all").fillna("")


def write_csv(df: DataFrame, path: str) -> None:
    """Line ends inside fields become spaces."""
    kinds = dict(df.dtypes)
    df.select(*[F.regexp_replace(c, r"\r?\n", " ").alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]).write.csv(path, header=True, quote='"', escape='"')


def csv_line(*cells) -> Column:
    """A line of CSV: line ends become spaces, and only cells with a comma or a quote are quoted; nulls are empty."""

    def cell(c: Column) -> Column:
        text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " ")
        return F.when(text.rlike('[",]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(cell, cells))


def html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line): the rows as lines of a Markdown table, in no order; ``markdown`` puts the head before them."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, path: str) -> None:
    """Writes a Markdown table in the order of ``df``, as text parts."""
    head = df.sparkSession.range(1).select(F.explode(F.array(F.lit("| " + " | ".join(df.columns) + " |"), F.lit("|" + "---|" * len(df.columns)))).alias("line"))
    head.coalesce(1).unionByName(markdown_rows(df)).write.text(path)
