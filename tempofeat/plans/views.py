"""The driver's tables as events and a population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofeat.config import Settings
from tempofeat.functions.statistics import Statistic, register

# Sums of doubles depend on their order in the last digit, which would move values
# across the edges of bins: a mean of nine decimals does not.
register("mean9", Statistic(lambda v, order: F.round(F.avg(v), 9)))

SETTINGS = Settings(
    T=720,
    dt=72,
    theta_1=0.001,
    theta_2=0.01,
    theta_freq=0.1,
    stats=("min", "max", "mean9"),
    value_types={"NATION": "Categorical", "REGION": "hierarchical"},
    hierarchical_levels=(0, 1),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; one in ten has events."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: series of each event type, LAST_TYPE and READING, STATUS of orders and
    OUTCOME, which says the same; time-invariant ACCTBAL, SEGMENT, NATION and REGION of customers."""

    def rows(df: DataFrame, ident: str, t, order: str, values: list) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(k).alias("var") if isinstance(k, str) else k.alias("var"), v.alias("val")) for k, v in values))
        out = df.select(F.col(ident).alias("ID"), t.alias("t"), F.explode(pairs).alias("p"), F.col(order).cast("long").alias("row_idx"))
        return out.select("ID", "t", "p.var", "p.val", "row_idx")

    seen = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts) / 3.6e9").cast("double")
    text = F.col("value").cast("string")
    series = rows(seen, "user_id", hours, "event_id", [(F.col("event_type"), text), ("LAST_TYPE", F.col("event_type")), ("READING", F.when(F.col("value") < 5, "<5").otherwise(text))])
    orders = table(spark, sf_dir, "orders")
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    status = rows(orders, "o_custkey", days, "o_orderkey", [("STATUS", F.col("o_orderstatus")), ("OUTCOME", F.lower("o_orderstatus"))])
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a row for each nation; Spark takes the product of its tables for its size, and would broadcast the customers
    people = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    path = F.concat_ws(":", "r_name", "n_name", "c_mktsegment")
    placed = F.when(F.col("n_nationkey").isNotNull(), "REGION")  # customers of no known nation lack this row alone
    values = [("ACCTBAL", F.col("c_acctbal").cast("string")), ("SEGMENT", F.col("c_mktsegment")), ("NATION", F.col("c_nationkey").cast("string")), (placed, path)]
    fixed = rows(people, "c_custkey", F.lit(None).cast("double"), "c_custkey", values).where("var is not null")
    return series.unionByName(status).unionByName(fixed)
