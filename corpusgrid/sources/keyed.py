"""A typed graph from tables that refer to each other by keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.sources.tables import table


def _node(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, title of regions, nations, customers and suppliers."""
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")]
    each = [table(spark, sf_dir, t).select(_node(t, k).alias("id"), F.lit(t).alias("type"), F.col(n).alias("title")) for t, k, n in parts]
    return reduce(DataFrame.unionByName, each)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are parents of nations, nations contain customers, suppliers depend on their nation."""
    def edges(name, start, end, kind, base):
        key = F.col(start[1] if name == "supplier" else end[1]).cast("long")
        return table(spark, sf_dir, name).select(
            _node(*start).alias("from"), _node(*end).alias("to"), F.lit(kind).alias("source"), F.lit(None).cast("string").alias("raw"), (key + base).alias("seq")
        )
    return reduce(DataFrame.unionByName, [
        edges("nation", ("region", "n_regionkey"), ("nation", "n_nationkey"), "parent_of", 0),
        edges("customer", ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains", 1 << 32),
        edges("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "depends_on", 1 << 33),
    ])
