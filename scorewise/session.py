"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark 4.1 can zip union inputs whose shuffles were coalesced to different partition counts, which fails at run
    # time ("Can't zip RDDs with unequal numbers of partitions"); a plain union has no such assumption
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; sizes and paths stay as the cluster set them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
