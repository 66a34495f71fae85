"""Every operator as a query over the given tables, with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions import ids
from rootweave.operators import codebook, graph, rules, tables, trails, validate
from rootweave.plans import alarms as live
from rootweave.plans import cluster, correlate, enrich, govern, kpi, layers, mining
from rootweave.sources import wire
from rootweave.sources.adapters import ALARMS_SQL, GRAPH_SQL, SECOND, alarms, edges, table, vertices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
WINDOW_US, EPS_US, FEWEST = 6 * 3600 * SECOND, 1800 * SECOND, 3
HOUR = 3600 * SECOND


def query(sql: str | None = None, graph_views: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            views = GRAPH_SQL if graph_views else ALARMS_SQL
            head, rest = ("WITH RECURSIVE ", sql.strip()[len("RECURSIVE") :]) if sql.strip().startswith("RECURSIVE") else ("WITH ", sql.strip())
            ORACLE_SQL[f.__name__] = f"{head}{views}{rest if rest.startswith(',') else ' ' + rest}"
        return f

    return add


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.filter_noise(alarms(spark, d), WINDOW_US, EPS_US, FEWEST)


CLUSTERS = f""", fanned AS (
  SELECT * EXCLUDE (trail_ids), unnest(trail_ids) AS trail_id, raised_us - raised_us % {WINDOW_US} AS window_us FROM alarms
), dense AS (
  SELECT *, count(*) OVER (PARTITION BY trail_id, window_us ORDER BY raised_us RANGE BETWEEN {EPS_US} PRECEDING AND {EPS_US} FOLLOWING) >= {FEWEST} AS core FROM fanned
), places AS (
  SELECT DISTINCT trail_id, window_us, raised_us FROM dense WHERE core
), opened AS (
  SELECT *, CASE WHEN raised_us - lag(raised_us) OVER w <= {EPS_US} THEN 0 ELSE 1 END AS fresh FROM places WINDOW w AS (PARTITION BY trail_id, window_us ORDER BY raised_us)
), chained AS (
  SELECT trail_id, window_us, raised_us, sum(fresh) OVER (PARTITION BY trail_id, window_us ORDER BY raised_us) - 1 AS chain FROM opened
), clustered AS (
  SELECT d.*, CAST(min(c.chain) OVER (PARTITION BY d.trail_id, d.window_us ORDER BY d.raised_us RANGE BETWEEN {EPS_US} PRECEDING AND {EPS_US} FOLLOWING) AS INTEGER) AS cluster
  FROM dense d LEFT JOIN chained c ON c.trail_id = d.trail_id AND c.window_us = d.window_us AND c.raised_us = d.raised_us AND d.core
) """


@query(CLUSTERS + "SELECT trail_id, window_us, alarm_id, cluster FROM clustered")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).select("trail_id", "window_us", "alarm_id", F.col("cluster").cast("int").alias("cluster"))


@query(CLUSTERS + """SELECT trail_id, window_us, count(*) AS alarms_in, count(DISTINCT cluster) AS clusters, count(cluster) AS alarms_kept, count(*) - count(cluster) AS alarms_dropped,
  round((count(*) - count(cluster)) / count(*), 9) AS noise_ratio, CASE WHEN count(DISTINCT cluster) > 0 THEN round(count(*) / count(DISTINCT cluster), 9) END AS storm_reduction
  FROM clustered GROUP BY trail_id, window_us""")  # fmt: skip
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = cluster.run_stats(clusters(spark, d))
    return stats.withColumn("noise_ratio", F.round("noise_ratio", 9)).withColumn("storm_reduction", F.round("storm_reduction", 9))


@query(CLUSTERS + """SELECT trail_id, window_us, cluster, string_agg(alarm_id || '=' || alarm_type, ' ' ORDER BY raised_us, alarm_id) AS alarms,
  min(raised_us) AS start_us, max(raised_us) AS end_us, count(*) AS n_alarms FROM clustered WHERE cluster IS NOT NULL GROUP BY trail_id, window_us, cluster""")
def transactions(spark: SparkSession, d: str) -> DataFrame:
    rows = cluster.transactions(clusters(spark, d))
    text = F.array_join(F.transform("alarms", lambda a: F.concat_ws("=", a["alarm_id"], a["alarm_type"])), " ")
    return rows.select("trail_id", "window_us", F.col("cluster").cast("int").alias("cluster"), text.alias("alarms"), "start_us", "end_us", "n_alarms")


@query("""SELECT moid, alarm_type, trail_id, count(*) AS occurrences, min(raised_us) AS first_us, max(raised_us) AS last_us
  FROM (SELECT moid, alarm_type, raised_us, unnest(trail_ids) AS trail_id FROM alarms) GROUP BY ALL""")
def observed_chatter(spark: SparkSession, d: str) -> DataFrame:
    return cluster.chatter(alarms(spark, d))


def listed_chatter(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Node:u7", "error"), (None, "signup")], "moid string, alarm_type string")


CHATTER = ", listed(moid, alarm_type) AS (VALUES ('Node:u7', 'error'), (NULL, 'signup')) "


@query(CHATTER + """SELECT o.moid, o.alarm_type, o.n, CASE WHEN l.alarm_type IS NULL THEN 'observed' ELSE 'suppressed' END AS status
  FROM (SELECT moid, alarm_type, count(*) AS n FROM alarms GROUP BY ALL) o LEFT JOIN listed l ON l.moid IS NOT DISTINCT FROM o.moid AND l.alarm_type = o.alarm_type""")
def promoted_chatter(spark: SparkSession, d: str) -> DataFrame:
    return cluster.promoted(alarms(spark, d).groupBy("moid", "alarm_type").agg(F.count("*").alias("n")), listed_chatter(spark))


@query(CHATTER + "SELECT alarm_id FROM alarms a WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.alarm_type = a.alarm_type AND (l.moid IS NULL OR l.moid = a.moid))")
def without_chatter(spark: SparkSession, d: str) -> DataFrame:
    return enrich.without_chatter(alarms(spark, d), listed_chatter(spark)).select("alarm_id")


@query(""", rulesets(source, ruleset) AS (VALUES ('src0', 'vendor-a'), ('default', 'plain')), mapping(ruleset, raw, mapped) AS (VALUES ('vendor-a', 'warning', 'info'), ('plain', 'minor', 'low'))
  SELECT alarm_id, coalesce(r.ruleset, 'plain') AS ruleset, a.severity AS raw_severity, coalesce(m.mapped, a.severity) AS severity, 'enricher' AS source
  FROM alarms a LEFT JOIN rulesets r USING (source) LEFT JOIN mapping m ON m.ruleset = coalesce(r.ruleset, 'plain') AND m.raw = a.severity""")
def normalised_alarms(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.createDataFrame([("src0", "vendor-a"), ("default", "plain")], "source string, ruleset string")
    mapping = spark.createDataFrame([("vendor-a", "warning", "info"), ("plain", "minor", "low")], "ruleset string, raw string, severity string")
    return enrich.normalised(enrich.with_ruleset(alarms(spark, d), sets), mapping).select("alarm_id", "ruleset", "raw_severity", "severity", "source")


@query("SELECT alarm_id, raised_us FROM (SELECT *, row_number() OVER (PARTITION BY moid, alarm_type, severity ORDER BY raised_us, alarm_id) AS n FROM alarms) WHERE n = 1")
def deduped_alarms(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).withColumn("key", F.concat_ws("|", "moid", "alarm_type", "severity"))
    return rules.current(rows, ["key"], F.col("raised_us"), F.col("alarm_id")).select("alarm_id", "raised_us")


@query(f""", stepped AS (
    SELECT *, lead(state) OVER w AS n, lead(raised_us) OVER w AS t, lag(state) OVER w AS p, lag(raised_us) OVER w AS s
    FROM (SELECT * REPLACE (CASE WHEN alarm_type = 'error' THEN 'cleared' ELSE 'raised' END AS state, 'any' AS alarm_type) FROM alarms) WINDOW w AS (PARTITION BY moid, alarm_type ORDER BY raised_us, alarm_id))
  SELECT alarm_id, state FROM stepped WHERE NOT coalesce(state = 'raised' AND n = 'cleared' AND t - raised_us <= {4 * HOUR}, false)
    AND NOT coalesce(state = 'cleared' AND p = 'raised' AND raised_us - s <= {4 * HOUR}, false)""")
def without_self_clears(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).withColumn("state", F.when(F.col("alarm_type") == "error", "cleared").otherwise("raised")).withColumn("alarm_type", F.lit("any"))
    return enrich.without_self_clears(rows, 4 * HOUR).select("alarm_id", "state")


@query(f""", toggled AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY moid ORDER BY raised_us, alarm_id) <> state THEN 1 ELSE 0 END AS toggle FROM alarms)
  SELECT alarm_id FROM (SELECT alarm_id, sum(toggle) OVER (PARTITION BY moid ORDER BY raised_us RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW) AS toggles FROM toggled) WHERE toggles <= 1""")
def without_flapping(spark: SparkSession, d: str) -> DataFrame:
    return enrich.without_flapping(alarms(spark, d), 48 * HOUR, 1).select("alarm_id")


@query(""", members AS (SELECT DISTINCT moid, unnest(trail_ids) AS trail_id FROM alarms)
  SELECT a.alarm_id, coalesce(array_to_string(t.trails, ','), '') AS trails FROM alarms a LEFT JOIN (SELECT moid, list(trail_id ORDER BY trail_id) AS trails FROM members GROUP BY moid) t USING (moid)""")
def trail_tagging(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    members = rows.select("moid", F.explode("trail_ids").alias("trail_id")).distinct()
    return enrich.tagged(rows, members).select("alarm_id", F.array_join("trail_ids", ",").alias("trails"))


# sessions and patterns
FAST, SLOW = HOUR // 4, 2 * HOUR
SESSIONS = f""", fanned AS (SELECT *, unnest(trail_ids) AS trail_id FROM (SELECT alarm_id, alarm_type, raised_us, trail_ids FROM alarms)
), stepped AS (SELECT *, raised_us - lag(raised_us) OVER (PARTITION BY trail_id ORDER BY raised_us, alarm_id) AS gap FROM fanned
), gaps AS (SELECT trail_id, coalesce(greatest({FAST}, least({SLOW}, quantile_cont(gap, 0.9) * 0.5)), {5 * SECOND})::DOUBLE AS gap_us FROM stepped GROUP BY trail_id
), sessioned AS (SELECT s.*, CAST(sum(CASE WHEN gap > gap_us THEN 1 ELSE 0 END) OVER (PARTITION BY trail_id ORDER BY raised_us, alarm_id) AS BIGINT) AS session FROM stepped s JOIN gaps USING (trail_id)) """


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).select("alarm_id", "alarm_type", "raised_us", F.explode("trail_ids").alias("trail_id"))
    return mining.sessions(rows, mining.closing_gaps(rows, 0.5, 90, FAST, SLOW))


@query(SESSIONS + "SELECT trail_id, round(gap_us, 3) AS gap_us FROM gaps")
def closing_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).select("alarm_id", "raised_us", F.explode("trail_ids").alias("trail_id"))
    return mining.closing_gaps(rows, 0.5, 90, FAST, SLOW).select("trail_id", F.round("gap_us", 3).alias("gap_us"))


@query(SESSIONS + "SELECT trail_id, session, string_agg(alarm_type, ' ' ORDER BY raised_us, alarm_id) AS sequence, count(*) AS alarms FROM sessioned GROUP BY trail_id, session")
def session_sequences(spark: SparkSession, d: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("raised_us", "alarm_id", "alarm_type")))
    return sessions(spark, d).groupBy("trail_id", "session").agg(order.alias("s"), F.count("*").alias("alarms")).select("trail_id", "session", F.array_join(F.col("s.alarm_type"), " ").alias("sequence"), "alarms")


SUPPORT, LONGEST, MOST = 0.3, 10, 1000


def sequences_sql() -> str:
    """Frequent sequences level by level: a sequence grows by each token that stands after its earliest end in a session."""
    levels = [
        f""", tokens AS (SELECT trail_id, session, alarm_type AS t, row_number() OVER (PARTITION BY trail_id, session ORDER BY raised_us, alarm_id) AS p FROM sessioned
), totals AS (SELECT trail_id, count(DISTINCT session) AS n FROM tokens GROUP BY trail_id
), h1 AS (SELECT trail_id, session, '' AS prefix, t, t AS sequence, min(p) AS e FROM tokens GROUP BY ALL
), f1 AS (SELECT trail_id, prefix, t, sequence, count(*) AS f, n FROM h1 JOIN totals USING (trail_id) GROUP BY ALL HAVING count(*) >= {SUPPORT} * n)"""
    ]
    for k in range(2, LONGEST + 1):
        levels.append(
            f""", h{k} AS (SELECT h.trail_id, h.session, h.sequence AS prefix, x.t, h.sequence || ' ' || x.t AS sequence, min(x.p) AS e
  FROM h{k - 1} h SEMI JOIN f{k - 1} g ON g.trail_id = h.trail_id AND g.sequence = h.sequence JOIN tokens x ON x.trail_id = h.trail_id AND x.session = h.session AND x.p > h.e GROUP BY ALL
), f{k} AS (SELECT trail_id, prefix, t, sequence, count(*) AS f, n FROM h{k} JOIN totals USING (trail_id) GROUP BY ALL HAVING count(*) >= {SUPPORT} * n)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, LONGEST + 1))
    return "".join(levels) + f""", every AS ({every}), mined AS (
  SELECT e.trail_id, e.sequence, e.f AS freq, e.f / e.n AS support, e.f / coalesce(b.f, e.n) AS confidence,
    CASE WHEN e.prefix = '' THEN 1.0 ELSE e.f / b.f / (o.f / e.n) END AS lift
  FROM every e LEFT JOIN every b ON b.trail_id = e.trail_id AND b.sequence = e.prefix LEFT JOIN f1 o ON o.trail_id = e.trail_id AND o.sequence = e.t
  QUALIFY row_number() OVER (PARTITION BY e.trail_id ORDER BY e.f DESC, e.sequence) <= {MOST}
) """


MINED = SESSIONS + sequences_sql()


def mined_sequences(spark: SparkSession, d: str) -> DataFrame:
    return mining.frequent_sequences(sessions(spark, d), SUPPORT, LONGEST, MOST)


@query(MINED + "SELECT trail_id, sequence, freq, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM mined")
def frequent_sequences(spark: SparkSession, d: str) -> DataFrame:
    return mined_sequences(spark, d).select("trail_id", F.array_join("sequence", " ").alias("sequence"), "freq", *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")])


TIMING = SESSIONS + """, spaced AS (SELECT *, (raised_us - lag(raised_us) OVER (PARTITION BY trail_id, session ORDER BY raised_us, alarm_id)) / 1000 AS g FROM sessioned
), timing AS (SELECT trail_id, session, (max(raised_us) - min(raised_us)) / 1000 AS timeframe_ms, quantile_cont(g, 0.5) AS median_ms, max(g) AS max_gap_ms, stddev_pop(g) AS stddev_ms FROM spaced GROUP BY ALL) """


@query(TIMING + "SELECT trail_id, session, round(timeframe_ms, 3) AS timeframe_ms, round(median_ms, 6) AS median_ms, round(max_gap_ms, 3) AS max_gap_ms, round(stddev_ms, 4) AS stddev_ms FROM timing")
def session_timing(spark: SparkSession, d: str) -> DataFrame:
    t = mining.timing(sessions(spark, d), ["trail_id", "session"])
    return t.select("trail_id", "session", *[F.round(c, {"stddev_ms": 4, "median_ms": 6}.get(c, 3)).alias(c) for c in ("timeframe_ms", "median_ms", "max_gap_ms", "stddev_ms")])


@query(TIMING + """SELECT trail_id, session, CAST(greatest(5000, least(1800000, greatest(ceil(1.5 * coalesce(timeframe_ms, 0)), ceil(2 * coalesce(max_gap_ms, 0))))) AS BIGINT) AS window_ms,
  CASE WHEN median_ms <> 0 AND stddev_ms / median_ms < 0.5 THEN 'fixed' ELSE 'gap-based' END AS window_type FROM timing""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return govern.session_windows(mining.timing(sessions(spark, d), ["trail_id", "session"])).select("trail_id", "session", "window_ms", "window_type")


@query("""SELECT trail_id, alarm_id, n AS sample FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY raised_us, alarm_id) AS INTEGER) AS n
  FROM (SELECT alarm_id, raised_us, unnest(trail_ids) AS trail_id FROM alarms)) WHERE n <= 5""")
def sample_alarms(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).select("alarm_id", "raised_us", F.explode("trail_ids").alias("trail_id"))
    return mining.samples(rows, ["trail_id"], 5).select("trail_id", "alarm_id", "sample")


def patterns(spark: SparkSession) -> DataFrame:
    rows = [(f"P{k}-{t}", f"T{t}", seq, seq[-1], c, w * SECOND, g) for t in range(12) for k, (seq, c, w, g) in enumerate([(["click", "view", "error"], 0.87, 3600, True), (["purchase", "signup"], 0.8, 5400, False)])]
    return spark.createDataFrame(rows, "pattern_id string, trail_id string, sequence array<string>, root_type string, confidence double, window_us long, by_gap boolean")






SCENARIOS = ", scenarios AS (SELECT concat('S', k) AS scenario_id, concat('T', t) AS trail_id, unnest(CASE k WHEN 0 THEN ['click', 'view', 'error'] WHEN 1 THEN ['purchase', 'purchase'] ELSE ['signup'] END) AS token FROM range(12) r(t), range(3) q(k)) "


@query(SESSIONS + SCENARIOS + """, o AS (SELECT trail_id || '/' || session AS set_id, trail_id, alarm_type AS token, count(*) AS o FROM sessioned GROUP BY ALL
), s AS (SELECT scenario_id, trail_id, token, count(*) AS s FROM scenarios GROUP BY ALL
), common AS (SELECT set_id, trail_id, scenario_id, sum(least(o, s)) AS c FROM o JOIN s USING (trail_id, token) GROUP BY ALL
), scored AS (SELECT set_id, scenario_id, n_s, 1.0 * (n_s - c) + 2.0 * (n_o - c) AS distance, greatest(0, 1 - (1.0 * (n_s - c) + 2.0 * (n_o - c)) / (1.0 * n_s + 2.0 * n_o)) AS score FROM common
    JOIN (SELECT set_id, sum(o) AS n_o FROM o GROUP BY ALL) USING (set_id) JOIN (SELECT scenario_id, trail_id, sum(s) AS n_s FROM s GROUP BY ALL) USING (scenario_id, trail_id))
SELECT set_id, scenario_id, CAST(distance AS DOUBLE) AS distance, round(CAST(score AS DOUBLE), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, n_s DESC, scenario_id) AS n FROM scored WHERE score > 0.5) WHERE n = 1""")
def codebook_decoding(spark: SparkSession, d: str) -> DataFrame:
    observed = sessions(spark, d).select(F.concat_ws("/", "trail_id", "session").alias("set_id"), "trail_id", F.col("alarm_type").alias("token"))
    tokens = [(f"S{k}", f"T{t}", x) for t in range(12) for k, ts in enumerate((["click", "view", "error"], ["purchase", "purchase"], ["signup"])) for x in ts]
    known = spark.createDataFrame(tokens, "scenario_id string, trail_id string, token string")
    return correlate.decode(observed, known).withColumn("score", F.round("score", 9))


@query(""", a AS (SELECT moid, alarm_type AS token FROM alarms WHERE source = 'src0'), b AS (SELECT moid, alarm_type AS token FROM alarms WHERE source = 'src1'),
  x AS (SELECT moid, token, count(*) AS s FROM a GROUP BY ALL), y AS (SELECT moid, token, count(*) AS o FROM b GROUP BY ALL)
  SELECT moid, CAST(sum(greatest(coalesce(s, 0) - coalesce(o, 0), 0)) AS BIGINT) AS missing, CAST(sum(greatest(coalesce(o, 0) - coalesce(s, 0), 0)) AS BIGINT) AS spurious FROM x FULL JOIN y USING (moid, token) GROUP BY moid""")
def bag_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).select("moid", F.col("alarm_type").alias("token"), "source")
    return tables.bag_difference(rows.where("source = 'src0'"), rows.where("source = 'src1'"), ["moid"], "token")


# alarm state and figures
CHANGES = """, changes AS (SELECT concat('E', event_id) AS event_id, concat('ALM-', event_id - event_id % 3) AS alarm_id,
  CASE event_id % 3 WHEN 0 THEN 'in-progress' WHEN 1 THEN 'correlated' ELSE 'reverted-open' END AS new_status, epoch_us(ts) AS changed_us FROM events) """


def all_changes(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("alarm_id", 5, 20).cast("long")
    status = F.expr("case substr(alarm_id, 5) % 3 when 0 then 'in-progress' when 1 then 'correlated' else 'reverted-open' end")
    return alarms(spark, d).select(F.concat(F.lit("E"), number).alias("event_id"), F.concat(F.lit("ALM-"), number - number % 3).alias("alarm_id"), status.alias("new_status"), F.col("raised_us").alias("changed_us"))


@query(CHANGES + """, last AS (SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY changed_us DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY alarm_id) AS c FROM changes)
  SELECT a.alarm_id, CASE WHEN new_status = 'reverted-open' THEN 'open' ELSE coalesce(new_status, 'open') END AS status, coalesce(changed_us, raised_us) AS since_us, coalesce(c, 0) AS n_changes
  FROM alarms a LEFT JOIN last l ON l.alarm_id = a.alarm_id AND n = 1""")
def alarm_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return live.lifecycle(alarms(spark, d), all_changes(spark, d))


@query(CHANGES + "SELECT alarm_id, string_agg(new_status, ' ' ORDER BY changed_us, event_id) AS statuses FROM changes GROUP BY alarm_id")
def alarm_transitions(spark: SparkSession, d: str) -> DataFrame:
    return live.transitions(all_changes(spark, d)).withColumn("statuses", F.array_join("statuses", " "))




#: Baskets of one supplier's lines of an order as incidents: the largest line is the root.
BASKETS = """, incidents AS (SELECT concat('I', l_orderkey) AS incident_id, round(least(1.0, max(l_quantity) / 50), 9) AS confidence, CASE WHEN l_orderkey % 2 = 0 THEN 'P' END AS pattern_id FROM lineitem GROUP BY l_orderkey) """


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q")).select(F.concat(F.lit("I"), "l_orderkey").alias("incident_id"), F.round(F.least(F.lit(1.0), F.col("q").cast("double") / 50), 9).alias("confidence"), F.when(F.col("l_orderkey") % 2 == 0, "P").alias("pattern_id"))


@query(BASKETS + "SELECT CAST(b AS INTEGER) AS bucket, count(incident_id) AS incidents FROM range(5) r(b) LEFT JOIN incidents ON least(floor(confidence * 5), 4) = b GROUP BY b")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kpi.confidence_histogram(baskets(spark, d))



@query(CLUSTERS + """, kept AS (SELECT DISTINCT alarm_id FROM clustered WHERE cluster IS NOT NULL), truth AS (SELECT alarm_id, severity = 'warning' AS is_noise FROM alarms)
  SELECT round(count(*) FILTER (is_noise AND k.alarm_id IS NULL) / count(*) FILTER (is_noise), 9) AS removal, round(count(*) FILTER (NOT is_noise AND k.alarm_id IS NOT NULL) / count(*) FILTER (NOT is_noise), 9) AS retention
  FROM truth t LEFT JOIN kept k USING (alarm_id)""")
def noise_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    found = kpi.noise_metrics(rows, clusters(spark, d).where("cluster is not null"), rows.select("alarm_id", (F.col("severity") == "warning").alias("is_noise")))
    return found.select(F.round("removal", 9).alias("removal"), F.round("retention", 9).alias("retention"))


@query("""SELECT round(avg(CASE WHEN i.alarm_type IN (SELECT alarm_type FROM alarms WHERE severity = 'critical') THEN 1.0 ELSE 0 END), 9) AS by_type, round(avg(CASE WHEN i.severity = 'critical' THEN 1.0 ELSE 0 END), 9) AS by_incident FROM alarms i WHERE i.source = 'src1'""")
def root_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    found = rows.where("source = 'src1'").select(F.col("alarm_id").alias("incident_id"), F.col("alarm_id").alias("root_alarm_id"))
    truth = rows.where("severity = 'critical'").select(F.col("alarm_id").alias("root_alarm_id"), F.col("alarm_type").alias("root_alarm_type"))
    return kpi.root_accuracy(found, truth, rows).select(F.round("by_type", 9).alias("by_type"), F.round("by_incident", 9).alias("by_incident"))


@query("""SELECT moid, alarm_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY moid ORDER BY raised_us DESC, alarm_id) AS k FROM alarms) WHERE k <= 2""")
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    return rules.ranked(alarms(spark, d), ["moid"], F.desc("raised_us"), F.col("alarm_id")).where("rank <= 2").select("moid", "alarm_id", "rank")


VERSIONS = ", versions AS (SELECT source AS domain, alarm_type AS record_type, moid AS record_id, concat('v', row_number() OVER (PARTITION BY source, alarm_type, moid ORDER BY raised_us, alarm_id)) AS version FROM alarms) "


def versions(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source", "alarm_type", "moid").orderBy("raised_us", "alarm_id"))
    return alarms(spark, d).select(F.col("source").alias("domain"), F.col("alarm_type").alias("record_type"), F.col("moid").alias("record_id"), F.concat(F.lit("v"), n).alias("version"))


@query(VERSIONS + "SELECT domain, record_type, record_id, concat('v', coalesce(max(CAST(substr(version, 2) AS INTEGER)), 0) + 1) AS next_version FROM versions GROUP BY ALL")
def next_versions(spark: SparkSession, d: str) -> DataFrame:
    return rules.next_version(versions(spark, d))


@query(VERSIONS + "SELECT * FROM versions WHERE version = 'v2'")
def pinned_version(spark: SparkSession, d: str) -> DataFrame:
    return rules.pinned(versions(spark, d), "v2")


BUILT = ", built AS (SELECT source AS domain, alarm_type AS snapshot, alarm_id AS trail_id, raised_us AS built_at FROM alarms) "


def built(spark: SparkSession, d: str) -> DataFrame:
    return alarms(spark, d).select(F.col("source").alias("domain"), F.col("alarm_type").alias("snapshot"), F.col("alarm_id").alias("trail_id"), F.col("raised_us").alias("built_at"))


@query(BUILT + """SELECT domain, snapshot, built_at, CAST(k AS INTEGER) AS rank, CASE k WHEN 1 THEN 'current' WHEN 2 THEN 'previous' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY built_at DESC, snapshot DESC) AS k FROM (SELECT domain, snapshot, max(built_at) AS built_at FROM built GROUP BY ALL))""")
def snapshot_roles(spark: SparkSession, d: str) -> DataFrame:
    return rules.snapshots(built(spark, d)).select("domain", "snapshot", "built_at", "rank", "role")


@query(BUILT + """SELECT domain, snapshot, trail_id FROM built JOIN (SELECT domain, snapshot, row_number() OVER (PARTITION BY domain ORDER BY max(built_at) DESC, snapshot DESC) AS k FROM built GROUP BY domain, snapshot) USING (domain, snapshot) WHERE k <= 2""")
def retained_trails(spark: SparkSession, d: str) -> DataFrame:
    return rules.retained(built(spark, d), 2).select("domain", "snapshot", "trail_id")


@query("SELECT alarm_id, raised_us FROM alarms ORDER BY raised_us DESC, alarm_id LIMIT 50 OFFSET 100")
def alarm_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(alarms(spark, d).select("alarm_id", "raised_us"), F.desc("raised_us"), F.col("alarm_id"), offset=100)


@query(""", now AS (SELECT moid, max_by(alarm_type, struct_pack(a := raised_us, b := alarm_id)) AS v FROM alarms GROUP BY moid), before AS (SELECT moid, max_by(alarm_type, struct_pack(a := raised_us, b := alarm_id)) AS v FROM alarms WHERE source <> 'src2' AND moid > 'Node:u2' GROUP BY moid)
  SELECT n.moid, n.v AS alarm_type, CASE WHEN b.moid IS NULL THEN 'new' WHEN n.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change, CASE WHEN b.moid IS NOT NULL AND n.v IS NOT DISTINCT FROM b.v THEN NULL ELSE 11500 END AS shine_until FROM now n LEFT JOIN before b USING (moid)""")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    last = lambda rows: rows.groupBy("moid").agg(F.max_by("alarm_type", F.struct("raised_us", "alarm_id")).alias("alarm_type"))
    rows = alarms(spark, d)
    return tables.changes(last(rows), last(rows.where("source <> 'src2' and moid > 'Node:u2'")), "moid", "alarm_type", 10_000)


@query("SELECT alarm_type, severity, source, count(*) AS alarms, count(DISTINCT moid) AS objects FROM alarms GROUP BY ALL")
def alarm_counters(spark: SparkSession, d: str) -> DataFrame:
    return alarms(spark, d).groupBy("alarm_type", "severity", "source").agg(F.count("*").alias("alarms"), F.countDistinct("moid").alias("objects"))


# decoding and identifiers
@query("""SELECT CASE WHEN event_id % 7 = 0 THEN 'not a JSON object' WHEN event_id % 7 = 1 THEN 'missing field traceId' WHEN event_id % 7 = 2 THEN 'unsupported version' WHEN event_id % 7 = 3 THEN 'unknown type'
  WHEN event_id % 7 = 4 THEN 'payload lacks newStatus' END AS reject_reason, count(*) AS events FROM events GROUP BY ALL""")
def decoded_envelopes(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("alarm_id", 5, 20).cast("long")
    kind = F.when(number % 7 == 3, "Nothing").otherwise("AlarmStatusChange")
    payload = F.struct("alarm_id", F.when(number % 7 != 4, "open").alias("newStatus"), F.col("source"), F.lit("2024-01-01T00:00:00Z").alias("changedAt"))
    payload = F.struct(F.col("alarm_id").alias("alarmId"), payload["newStatus"].alias("newStatus"), F.col("source").alias("source"), payload["changedAt"].alias("changedAt"))
    version = F.when(number % 7 == 2, 2).otherwise(1)
    whole = F.to_json(F.struct(F.col("alarm_id").alias("eventId"), kind.alias("type"), version.alias("schemaVersion"), F.lit("2024-01-01T00:00:00Z").alias("occurredAt"), F.col("source").alias("source"), F.when(number % 7 != 1, "t").alias("traceId"), payload.alias("payload")))
    raw = alarms(spark, d).select(F.when(number % 7 == 0, "[1, ").otherwise(whole).alias("value"))
    return wire.decode(raw).groupBy("reject_reason").agg(F.count("*").alias("events"))


@query("""SELECT moid, split_part(moid, ':', 1) AS object_type, regexp_full_match(moid, '[A-Za-z][A-Za-z0-9]*:[^:]+') AS is_valid, sha256(concat_ws('|', moid, 'P', array_to_string(list(alarm_id ORDER BY alarm_id), '|'))) AS incident_id,
  'trail-' || sha256(concat_ws('|', 'core', 'SNAP', array_to_string(list(alarm_id ORDER BY alarm_id), '|')))[1:24] AS trail_id FROM alarms GROUP BY moid""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    members = alarms(spark, d).groupBy("moid").agg(F.collect_list("alarm_id").alias("a"))
    return members.select("moid", ids.object_type(F.col("moid")).alias("object_type"), ids.is_object_id(F.col("moid")).alias("is_valid"), ids.incident_id(F.col("moid"), F.lit("P"), F.col("a")).alias("incident_id"), ids.trail_id(F.lit("core"), F.lit("SNAP"), F.col("a")).alias("trail_id"))


# graph
@query(""", bad AS (SELECT src, dst, relation FROM edges UNION ALL SELECT 'Ghost:1', id, 'HOSTS' FROM vertices WHERE object_type = 'Nation' UNION ALL SELECT id, 'Ghost:2', 'HOSTS' FROM vertices WHERE object_type = 'Region')
  SELECT *, 'src' AS "end" FROM bad WHERE src NOT IN (SELECT id FROM vertices) UNION ALL SELECT *, 'dst' FROM bad WHERE dst NOT IN (SELECT id FROM vertices)""", True)
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    v, e = vertices(spark, d), edges(spark, d)
    ghosts = v.where("object_type = 'Nation'").select(F.lit("Ghost:1").alias("src"), F.col("id").alias("dst"), F.lit("HOSTS").alias("relation")).unionByName(v.where("object_type = 'Region'").select(F.col("id").alias("src"), F.lit("Ghost:2").alias("dst"), F.lit("HOSTS").alias("relation")))
    return validate.dangling(e.unionByName(ghosts), v)


@query("SELECT id AS key, 'type differs from id' AS violation FROM vertices WHERE object_type = 'Order'", True)
def prefix_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.prefix_violations(vertices(spark, d).withColumn("object_type", F.when(F.col("object_type") == "Order", "Ordre").otherwise(F.col("object_type"))))


@query("SELECT relation, count(*) AS edges FROM edges WHERE relation NOT IN ('HOSTS', 'LOCATED_AT') GROUP BY relation", True)
def outside_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("HOSTS",), ("LOCATED_AT",)], "relation string")
    return validate.outside_vocabulary(edges(spark, d), "relation", known).groupBy("relation").agg(F.count("*").alias("edges"))


@query("SELECT DISTINCT e.src AS start, v.id, v.object_type, e.relation FROM edges e JOIN vertices v ON v.id = e.dst WHERE e.src LIKE 'Customer:%'", True)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    return graph.neighbours(v, edges(spark, d), graph.nodes_of(v, "Customer").select("id"))


@query("""RECURSIVE, reach AS (SELECT id AS start, id, 0 AS hops FROM vertices WHERE object_type = 'Nation'
  UNION SELECT r.start, e.dst, r.hops + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE r.hops < 3 AND e.relation IN ('HOSTED_ON', 'HOSTS', 'TERMINATES'))
  SELECT start, id, CAST(min(hops) AS INTEGER) AS hops FROM reach WHERE hops > 0 GROUP BY start, id""", True)
def traversal(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    validate.check_traversal("Nation", ["HOSTED_ON"], 3)
    return graph.traverse(v, edges(spark, d), graph.nodes_of(v, "Nation").select("id"), ["HOSTED_ON", "HOSTS", "TERMINATES"], 3)


@query("SELECT DISTINCT e.dst AS site, v.id, v.object_type FROM edges e JOIN vertices v ON v.id = e.src WHERE relation = 'LOCATED_AT'", True)
def objects_at_site(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    return graph.at_site(v, edges(spark, d), graph.nodes_of(v, "Region").select("id"))


@query(""", members AS (SELECT id FROM vertices WHERE object_type IN ('Nation', 'Supplier'))
  SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM members) AND (dst IN (SELECT id FROM members) OR relation = 'LOCATED_AT')""", True)
def edges_among(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    return graph.edges_among(edges(spark, d), v.where("object_type in ('Nation', 'Supplier')").select("id"))


@query("SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY relation", True)
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchy_counts(edges(spark, d))


@query("SELECT DISTINCT area AS snapshot FROM vertices WHERE area NOT IN ('A0', 'A1')", True)
def orphan_snapshots(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("A0",), ("A1",)], "snapshot string")
    return graph.orphans(vertices(spark, d).where("area is not null").select(F.col("area").alias("snapshot")), known)


@query("SELECT split_part(src, ':', 1) AS kind, 'other' AS layer, count(*) AS edges FROM edges GROUP BY ALL", True)
def edge_layers(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy(ids.object_type(F.col("src")).alias("kind"), layers.edge_layer(F.col("src")).alias("layer")).agg(F.count("*").alias("edges"))


@query(""", free AS (SELECT id FROM vertices WHERE area IS NULL), ties AS (SELECT src AS a, dst AS b FROM edges WHERE relation = 'HOSTS' UNION SELECT dst, src FROM edges WHERE relation = 'HOSTS'
), direct AS (SELECT DISTINCT t.a AS id, v.area FROM ties t JOIN free f ON f.id = t.a JOIN vertices v ON v.id = t.b WHERE v.area IS NOT NULL)
  SELECT id, area FROM vertices WHERE area IS NOT NULL UNION SELECT id, area FROM direct UNION SELECT t.a, d.area FROM ties t JOIN free f ON f.id = t.a JOIN direct d ON d.id = t.b""", True)
def connector_areas(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    return trails.areas_of(v, trails.linked(v, edges(spark, d), ["HOSTS"]))


@query(""", hosted AS (SELECT c.id AS seed, c.area, list(e.dst) FILTER (e.dst IS NOT NULL) AS orders FROM vertices c LEFT JOIN edges e ON e.src = c.id AND e.relation = 'HOSTS' WHERE c.object_type = 'Customer' GROUP BY c.id, c.area
), sets AS (SELECT seed, area, list_sort(list_append(coalesce(orders, []), seed)) AS members FROM hosted
  UNION ALL SELECT id, NULL, [id] FROM vertices WHERE object_type NOT IN ('Customer', 'Order') UNION ALL SELECT id, NULL, [id] FROM vertices WHERE object_type = 'Order' AND id NOT IN (SELECT dst FROM edges WHERE relation = 'HOSTS'))
  SELECT 'trail-' || sha256('core|SNAP|' || array_to_string(members, '|'))[1:24] AS trail_id, area, seed, CAST(len(members) AS INTEGER) AS n_members FROM sets""", True)
def trail_closures(spark: SparkSession, d: str) -> DataFrame:
    found = trails.trails(vertices(spark, d), edges(spark, d), ["HOSTS"], "core", "SNAP")
    return found.select("trail_id", "area", "seed", F.size("members").alias("n_members"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [("HOSTED_ON", "Nation", "Down", "Customer", "Lost"), ("HOSTED_ON", "Nation", "Down", "Supplier", "Late"), ("HOSTS", "Customer", "Lost", "Order", "Stuck"), ("TERMINATES", "Order", "Stuck", "Supplier", "Late")]
    return spark.createDataFrame(rows, "relation string, trigger_type string, trigger_alarm string, effect_type string, effect_alarm string")


@query("""RECURSIVE, rules(relation, tt, ta, et, ea) AS (VALUES ('HOSTED_ON', 'Nation', 'Down', 'Customer', 'Lost'), ('HOSTED_ON', 'Nation', 'Down', 'Supplier', 'Late'), ('HOSTS', 'Customer', 'Lost', 'Order', 'Stuck'), ('TERMINATES', 'Order', 'Stuck', 'Supplier', 'Late')
), reach AS (SELECT 'sc-' || id AS scenario_id, 'Down' AS alarm_type, id AS moid FROM vertices WHERE object_type = 'Nation'
  UNION SELECT r.scenario_id, ea, e.dst FROM reach r JOIN edges e ON e.src = r.moid JOIN rules u ON u.relation = e.relation AND u.ta = r.alarm_type AND u.tt = split_part(e.src, ':', 1) AND u.et = split_part(e.dst, ':', 1))
  SELECT * FROM reach""", True)
def fault_signatures(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    origins = spark.createDataFrame([("Nation", "Down")], "object_type string, alarm_type string")
    return codebook.propagate(codebook.scenarios(v, origins), v, edges(spark, d), templates(spark)).select("scenario_id", "alarm_type", "moid")


# rules, structure and conflicts
@query("SELECT DISTINCT moid AS record_id, alarm_type AS term FROM alarms WHERE alarm_type NOT IN ('click', 'view', 'error')")
def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    records = alarms(spark, d).groupBy(F.col("moid").alias("record_id")).agg(F.collect_set("alarm_type").alias("terms"))
    return validate.unknown_references(records, F.col("terms"), spark.createDataFrame([("click",), ("view",), ("error",)], "term string"))


@query("SELECT json_extract_string(vendor_raw, '$.k') AS value, count(*) AS parameters FROM alarms WHERE CAST(json_extract_string(vendor_raw, '$.k') AS DOUBLE) NOT BETWEEN 10 AND 90 GROUP BY ALL")
def out_of_bounds(spark: SparkSession, d: str) -> DataFrame:
    given = alarms(spark, d).select(F.lit("k").alias("name"), F.get_json_object("vendor_raw", "$.k").alias("value"))
    return validate.out_of_bounds(given, spark.createDataFrame([("k", 10.0, 90.0)], "name string, low double, high double")).groupBy("value").agg(F.count("*").alias("parameters"))


AUDIT = ", audit AS (SELECT moid AS pattern_id, CASE source WHEN 'src0' THEN 'draft' WHEN 'src1' THEN 'approved' ELSE 'deprecated' END AS state, raised_us AS changed_us FROM alarms) "


@query(AUDIT + "SELECT pattern_id, max_by(state, struct_pack(a := changed_us, b := state)) AS state, count(*) AS changes FROM audit GROUP BY ALL")
def pattern_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    state = F.expr("case source when 'src0' then 'draft' when 'src1' then 'approved' else 'deprecated' end")
    return govern.lifecycle(alarms(spark, d).select(F.col("moid").alias("pattern_id"), state.alias("state"), F.col("raised_us").alias("changed_us")))


@query(SESSIONS + """, m AS (SELECT trail_id || '/' || session AS pattern_id, alarm_type, length(alarm_type) AS hops, raised_us FROM sessioned
), s AS (SELECT *, percent_rank() OVER (PARTITION BY pattern_id ORDER BY hops) + 0.5 * percent_rank() OVER (PARTITION BY pattern_id ORDER BY raised_us) AS score FROM m)
SELECT pattern_id, alarm_type AS root_alarm_type FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score, raised_us, alarm_type) AS n FROM s) WHERE n = 1""")
def root_causes(spark: SparkSession, d: str) -> DataFrame:
    members = sessions(spark, d).select(F.concat_ws("/", "trail_id", "session").alias("pattern_id"), "alarm_type", F.length("alarm_type").alias("hops"), "raised_us")
    return govern.root_causes(members)


@query("SELECT concat('P', c_custkey) AS pattern_id, concat('Nation:', (c_nationkey + 1) % 25) AS root, concat('Customer:', c_custkey) AS moid FROM customer WHERE c_custkey % 5 = 0", True)
def unconnected_members(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d)
    root = F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    members = table(spark, d, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("pattern_id"), F.concat(F.lit("Nation:"), root).alias("root"), F.concat(F.lit("Customer:"), "c_custkey").alias("moid"))
    reached = graph.traverse(v, edges(spark, d), graph.nodes_of(v, "Nation").select("id"), ["HOSTED_ON"], 2)
    return govern.unconnected(members, reached).select("pattern_id", "root", "moid")


@query(""", lines AS (SELECT concat('I', l_orderkey) AS incident_id, concat('S', l_suppkey) AS alarm_id, count(*) OVER (PARTITION BY l_orderkey) AS size, CAST(l_quantity AS DOUBLE) AS confidence FROM lineitem
), c AS (SELECT incident_id, alarm_id, size, max(confidence) AS confidence FROM lines GROUP BY ALL)
SELECT alarm_id, incident_id, size, confidence FROM (SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY size DESC, confidence DESC, incident_id) AS n FROM c) WHERE n = 1""")
def conflict_winners(spark: SparkSession, d: str) -> DataFrame:
    # dealt and sorted once, by numbers: an order's lines of one supplier stand together, the surest first
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("double").alias("confidence")).repartition("l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(F.desc("confidence")))
    lines = lines.withColumn("place", place).withColumn("size", F.count("*").over(Window.partitionBy("l_orderkey"))).where("place = 1")
    found = lines.select(F.concat(F.lit("I"), "l_orderkey").alias("incident_id"), F.concat(F.lit("S"), "l_suppkey").alias("alarm_id"), "size", "confidence")
    return correlate.winners(found).select("alarm_id", "incident_id", "size", "confidence")


@query("SELECT concat('Supplier:', s_suppkey) AS id, concat('n', s_suppkey) AS name, round(CAST(s_suppkey AS DOUBLE) / 8, 6) AS lat, NULL::DOUBLE AS lon FROM supplier", True)
def site_projection(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct(F.concat(F.lit("n"), "s_suppkey").alias("name"), (F.col("s_suppkey") / 8).alias("latitude"), F.lit("east").alias("longitude")))
    site = layers.site_of(text, F.lit(None).cast("string"))
    return table(spark, d, "supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id"), site["name"].alias("name"), F.round(site["lat"], 6).alias("lat"), site["lon"].alias("lon"))


@query("SELECT moid, alarm_type, severity FROM alarms WHERE source = 'src1' UNION SELECT moid, alarm_type, severity FROM alarms WHERE source = 'src2' EXCEPT SELECT moid, alarm_type, severity FROM alarms WHERE source = 'src0'")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    part = lambda s: alarms(spark, d).where(F.col("source") == s).select("moid", "alarm_type", "severity")
    return part("src1").union(part("src2")).distinct().subtract(part("src0"))


@query("SELECT a.moid AS moid, a.alarm_id AS alarm_id, b.alarm_id AS latest FROM alarms a JOIN (SELECT moid, max_by(alarm_id, struct_pack(x := raised_us, y := alarm_id)) AS alarm_id FROM alarms GROUP BY moid) b ON a.moid = b.moid WHERE a.state = 'cleared'")
def clears_with_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    latest = rows.groupBy("moid").agg(F.max_by("alarm_id", F.struct("raised_us", "alarm_id")).alias("latest"))
    return rows.where("state = 'cleared'").join(latest, "moid").select("moid", "alarm_id", "latest")


# further queries register themselves
from rootweave import live_queries, store_queries  # noqa: E402, F401
