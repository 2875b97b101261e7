"""Session settings the operators profit from; all may be changed on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # re-plan joins and partition counts from measured sizes, and split skewed partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wide projections become one method too long for the JVM's compiler; below this size Spark
    # splits them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
