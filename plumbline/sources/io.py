"""Readers and writers for paired tables, configuration maps, predictions and scores."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.spec import CATEGORICAL, NUMERIC, SchemaSpec
from plumbline.table import TRAIN, FeatureTable


def read_table(spark: SparkSession, path: str, spec: SchemaSpec | None = None) -> DataFrame:
    """Read CSV (header, ``NA`` is null), JSON or parquet; CSV types come from the spec."""
    if path.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("nullValue", "NA")
        if spec is None:
            return reader.option("inferSchema", True).csv(path)
        return _typed_csv(reader.csv(path), spec)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def _typed_csv(raw: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Columns of a CSV as the spec says: numbers and the target double, the id bigint."""
    kinds = {c: "double" for c, s in spec.columns.items() if s.type == NUMERIC}
    kinds |= {spec.target: "double", spec.id: "bigint"}
    return raw.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in raw.columns})


def load_pair(
    spark: SparkSession, train_path: str, test_path: str | None, spec: SchemaSpec
) -> FeatureTable:
    train = read_table(spark, train_path, spec)
    test = read_table(spark, test_path, spec) if test_path else None
    return FeatureTable.from_pair(train, test, spec)


def load_map(path: str) -> dict:
    """Read a rename map or a column -> value -> code map from JSON."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Read a column catalogue; short rows leave the trailing columns null."""
    schema = T.StructType(
        [
            T.StructField("ColName", T.StringType()),
            T.StructField("NumDistinctValues", T.IntegerType()),
            T.StructField("HasNA", T.BooleanType()),
            T.StructField("Type", T.StringType()),
            T.StructField("Comments", T.StringType()),
        ]
    )
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def save(table: FeatureTable, folder: str, scores: DataFrame | None = None, fmt: str = "parquet"):
    """Write ``train``, ``test`` and, if given, per-row scores, each with its ids, and the spec."""
    spec = table.spec
    df = table.df
    if scores is not None:
        df = df.join(scores.select(*spec.keys, "score"), spec.keys, "left")
    test_columns = [c for c in table.df.columns if c not in (spec.split, spec.target)]
    parts = {
        "train": df.where(F.col(spec.split) == TRAIN).drop(spec.split),
        "test": df.where(F.col(spec.split) != TRAIN).select(*test_columns),
    }
    for name, part in parts.items():
        path = os.path.join(folder, name)
        if fmt == "csv":
            write_csv(part, path)
        else:
            part.write.mode("overwrite").format(fmt).save(path)
    schema_path = os.path.join(folder, "schema")
    spark = df.sparkSession
    spark.createDataFrame([(spec.to_json(),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(schema_path, lineSep="\0")


def load_saved(spark: SparkSession, folder: str, fmt: str = "parquet") -> FeatureTable:
    text = spark.read.text(os.path.join(folder, "schema"), wholetext=True).first()[0]
    spec = SchemaSpec.from_json(text.rstrip("\0"))

    def load(name):
        path = os.path.join(folder, name)
        if fmt == "csv":
            raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
            return _typed_csv(raw, spec)
        return spark.read.format(fmt).load(path)

    return FeatureTable.from_pair(load("train"), load("test"), spec)


def submission(
    table: FeatureTable, prediction: Column, id_name: str = "Id", value_name: str = "SalePrice"
) -> DataFrame:
    """Ids of the test rows with the prediction in target units."""
    return table.test.select(
        F.col(table.spec.id).alias(id_name), table.untransform(prediction).alias(value_name)
    )


def write_scores(df: DataFrame, path: str, score: str = "score", key: str = "id") -> None:
    """Write scores from worst to best; the range sort keeps the files in global order."""
    write_csv(df.orderBy(F.desc(score), key), path)


def write_vector(df: DataFrame, column: str, path: str) -> None:
    df.select(F.format_string("%f", F.col(column))).write.mode("overwrite").text(path)


def column_types(table: FeatureTable) -> DataFrame:
    """(position, column, declared type) of the id, target and feature columns."""
    spec = table.spec
    rows = []
    for c in table.df.columns:
        if c == spec.split:
            continue
        declared = spec.columns.get(c)
        kind = declared.type if declared else (NUMERIC if c == spec.target else CATEGORICAL)
        rows.append((len(rows), c, kind))
    return table.df.sparkSession.createDataFrame(
        rows, "position int, attribute_name string, attribute_type string"
    )


def manifest(table: FeatureTable, catalogue: DataFrame) -> DataFrame:
    """Column manifest: position, name, catalogue type, and which column is the id and the target.

    ``catalogue`` has ``column`` and ``type``, as the profile operator computes it.
    """
    spec = table.spec
    names = column_types(table).select("position", "attribute_name")
    typed = names.join(
        F.broadcast(catalogue.select(F.col("column").alias("attribute_name"), "type")),
        "attribute_name",
        "left",
    )
    return typed.select(
        "position",
        "attribute_name",
        F.col("type").alias("attribute_type"),
        (F.col("attribute_name") == spec.id).cast("int").alias("is_row_id"),
        (F.col("attribute_name") == spec.target).cast("int").alias("is_target"),
    )


def recipe(
    columns: Mapping[str, str], id_name: str, target_name: str, bins: int = 50
) -> list[tuple[str, str]]:
    """Transform plan: numeric columns are quantile-binned, the others pass through."""
    return [
        (c, f"quantile_bin_{bins}" if kind == NUMERIC else "pass")
        for c, kind in columns.items()
        if c not in (id_name, target_name)
    ]
