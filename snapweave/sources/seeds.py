"""Seed lists and the task collection used as crawl seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.processors import py_strip

PRODUCT_SEED_SCHEMA = "TYPE string, ID string, NAME string"
APP_SEED_SCHEMA = "Platform string, ID string"


def read_seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV seeds with a header (A3). Columns are matched by header name and
    read as text (no inference); a schema column missing from the file (e.g.
    NAME) is NULL. Values are stripped: the committed app seed file has
    trailing blanks after some ids."""
    raw = spark.read.option("header", True).csv(path)
    fields = [f.strip().split()[0] for f in schema.split(",")]
    return raw.select(*[(py_strip(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")).alias(c)
                        for c in fields])


def app_store_seeds(tasks: DataFrame, platform_col: str = "app_platform", id_col: str = "app_id") -> DataFrame:
    """Crawl seeds from the task collection (A4/D6): App store apps only,
    one row per distinct app id."""
    return (tasks.where(F.col(platform_col) == C.PLATFORM_APPLE)
            .select(F.col(id_col).alias("app_id")).where(F.col("app_id").isNotNull()).distinct())
