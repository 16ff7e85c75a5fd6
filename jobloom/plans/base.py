"""How the given tables stand for countries, companies, positions, categories and logs, in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.columns import slug
from jobloom.sources.tables import scan

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(t: Tables) under a name, with its SQL (BASE comes before it)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLE_SQL[name] = BASE + (",\n" + body[4:].strip() if body[:5].upper() == "WITH " else "\n" + body)
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str, *cols: str) -> DataFrame:
        return scan(self.spark, self.sf_dir, name, list(cols) or None)

    @cached_property
    def country(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), slug(F.col("n_name")).alias("slug"), F.col("n_nationkey").alias("sort_order"), F.col("n_regionkey").alias("region_id"))

    @cached_property
    def company(self) -> DataFrame:
        updated = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(c_custkey, 365) as int))")
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country_id"), F.col("c_mktsegment").alias("segment"), updated.alias("updated_at"))

    @cached_property
    def brand(self) -> DataFrame:
        """Companies whose names recur in many countries: one a segment and country."""
        return self.company.withColumn("name", F.col("segment"))

    @cached_property
    def category(self) -> DataFrame:
        c = self.raw("orders").select(F.col("o_orderpriority").alias("name")).distinct()
        return c.select(F.substring("name", 1, 1).cast("int").alias("id"), "name", slug(F.col("name")).alias("slug"))

    @cached_property
    def position(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("company_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("category_id"),
            (s != "O").alias("requires_native_language"),
            (s == "P").alias("local_language_advantage"),
            F.col("o_orderdate").alias("extracted_at"),
            F.col("o_totalprice").alias("score"),
        )

    @cached_property
    def change(self) -> DataFrame:
        n = F.col("event_id")
        return self.raw("events").select(
            n.alias("change_id"),
            F.col("event_type").alias("entity_type"),
            F.col("user_id").alias("entity_id"),
            F.when(n % 7 == 0, None).otherwise(F.col("value")).alias("before_state"),
            F.when(n % 5 == 0, None).otherwise(F.col("value") * 2).alias("after_state"),
            F.when(n % 3 == 0, "created").when(n % 3 == 1, "updated").otherwise("deleted").alias("action"),
            F.col("ts").alias("changed_at"),
        )


def sql_slug(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '-')"


def sql_share(part: str, total: str, digits: int = 0) -> str:
    """Half up in whole numbers, as share() rounds decimals half up."""
    k = 10**digits
    return f"CASE WHEN {total} > 0 THEN CAST((CAST({part} AS HUGEINT) * {200 * k} + {total}) // ({total} * 2) AS DOUBLE) / {k} ELSE 0.0 END"


BASE = f"""WITH country AS (
  SELECT n_nationkey AS id, n_name AS name, {sql_slug("n_name")} AS slug, n_nationkey AS sort_order, n_regionkey AS region_id FROM nation
), company AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS country_id, c_mktsegment AS segment,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS updated_at FROM customer
), brand AS (SELECT id, segment AS name, country_id, segment, updated_at FROM company
), category AS (
  SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS name, {sql_slug("o_orderpriority")} AS slug FROM orders
), position AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS category_id,
         o_orderstatus <> 'O' AS requires_native_language, o_orderstatus = 'P' AS local_language_advantage,
         o_orderdate AS extracted_at, o_totalprice AS score FROM orders
), change AS (
  SELECT event_id AS change_id, event_type AS entity_type, user_id AS entity_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS before_state,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS after_state,
         CASE event_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'deleted' END AS action, ts AS changed_at FROM events
)"""
