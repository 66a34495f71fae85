"""Event and relational tables seen as alarms on a topology.

``events`` become alarms on objects that ride one or two trails; foreign keys become a typed graph: nations lie in
regions, customers and suppliers are hosted in nations, orders are hosted by customers and end at suppliers.
Times are microseconds since 1970 without a zone, so that no session setting shifts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alarm_id, moid, alarm_type, severity, state, raised_us, source, vendor_raw, trail_ids."""
    events = table(spark, sf_dir, "events").where("event_id is not null and ts is not null and user_id is not null")
    severity = F.expr("case when value >= 75 then 'critical' when value >= 40 then 'major' when value >= 15 then 'minor' else 'warning' end")
    trails = F.expr("filter(array(concat('T', user_id % 8), if(user_id % 3 = 0, concat('T', 8 + user_id % 4), null)), x -> x is not null)")
    return events.select(
        F.concat(F.lit("ALM-"), "event_id").alias("alarm_id"),
        F.concat(F.lit("Node:u"), "user_id").alias("moid"),
        F.col("event_type").alias("alarm_type"),
        severity.alias("severity"),
        F.expr("case when event_type = 'view' then 'cleared' else 'raised' end").alias("state"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz))").alias("raised_us"),
        F.expr("concat('src', event_id % 3)").alias("source"),
        F.col("props").alias("vendor_raw"),
        trails.alias("trail_ids"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, object_type, area: the region of a customer; regions, nations, suppliers and orders have none."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", F.concat(F.lit("A"), "n_regionkey").alias("area"))
    none = F.lit(None).cast("string").alias("area")
    node = lambda kind, key: (F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("object_type"))
    return (
        t("region").select(*node("Region", "r_regionkey"), none)
        .unionByName(t("nation").select(*node("Nation", "n_nationkey"), none))
        .unionByName(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*node("Customer", "c_custkey"), "area"))
        .unionByName(t("supplier").select(*node("Supplier", "s_suppkey"), none))
        .unionByName(t("orders").select(*node("Order", "o_orderkey"), none))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda a, x, b, y, r: (F.concat(F.lit(f"{a}:"), x).alias("src"), F.concat(F.lit(f"{b}:"), y).alias("dst"), F.lit(r).alias("relation"))
    return (
        t("nation").select(*edge("Nation", "n_nationkey", "Region", "n_regionkey", "LOCATED_AT"))
        .unionByName(t("customer").select(*edge("Nation", "c_nationkey", "Customer", "c_custkey", "HOSTED_ON")))
        .unionByName(t("supplier").select(*edge("Nation", "s_nationkey", "Supplier", "s_suppkey", "HOSTED_ON")))
        .unionByName(t("orders").select(*edge("Customer", "o_custkey", "Order", "o_orderkey", "HOSTS")))
        .unionByName(t("lineitem").select("l_orderkey", "l_suppkey").distinct().select(*edge("Order", "l_orderkey", "Supplier", "l_suppkey", "TERMINATES")))
    )


#: The same views for DuckDB.
ALARMS_SQL = """alarms AS (
  SELECT concat('ALM-', event_id) AS alarm_id, concat('Node:u', user_id) AS moid, event_type AS alarm_type,
    CASE WHEN value >= 75 THEN 'critical' WHEN value >= 40 THEN 'major' WHEN value >= 15 THEN 'minor' ELSE 'warning' END AS severity,
    CASE WHEN event_type = 'view' THEN 'cleared' ELSE 'raised' END AS state, epoch_us(ts) AS raised_us,
    concat('src', event_id % 3) AS source, props AS vendor_raw,
    CASE WHEN user_id % 3 = 0 THEN [concat('T', user_id % 8), concat('T', 8 + user_id % 4)] ELSE [concat('T', user_id % 8)] END AS trail_ids
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
)"""
GRAPH_SQL = """vertices AS (
  SELECT concat('Region:', r_regionkey) AS id, 'Region' AS object_type, NULL::VARCHAR AS area FROM region
  UNION ALL SELECT concat('Nation:', n_nationkey), 'Nation', NULL FROM nation
  UNION ALL SELECT concat('Customer:', c_custkey), 'Customer', concat('A', n_regionkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('Supplier:', s_suppkey), 'Supplier', NULL FROM supplier
  UNION ALL SELECT concat('Order:', o_orderkey), 'Order', NULL FROM orders
), edges AS (
  SELECT concat('Nation:', n_nationkey) AS src, concat('Region:', n_regionkey) AS dst, 'LOCATED_AT' AS relation FROM nation
  UNION ALL SELECT concat('Nation:', c_nationkey), concat('Customer:', c_custkey), 'HOSTED_ON' FROM customer
  UNION ALL SELECT concat('Nation:', s_nationkey), concat('Supplier:', s_suppkey), 'HOSTED_ON' FROM supplier
  UNION ALL SELECT concat('Customer:', o_custkey), concat('Order:', o_orderkey), 'HOSTS' FROM orders
  UNION ALL SELECT DISTINCT concat('Order:', l_orderkey), concat('Supplier:', l_suppkey), 'TERMINATES' FROM lineitem
)"""
