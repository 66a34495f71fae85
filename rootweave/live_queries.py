"""Correlation, alarm state and figures as queries, with the SQL that each is compared with.

The SQL of correlation is a machine of its own: a recursive query that goes through the numbered alarms of every trail and
pattern, one a round, with the instance's state in its columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.operators import rules, tables
from rootweave.plans import alarms as live
from rootweave.plans import correlate, enrich, kpi, shapes
from rootweave.queries import AUDIT, CLUSTERS, HOUR, ORACLE_SQL, SCENARIOS, all_changes, clusters, patterns, query
from rootweave.session import shared_dir
from rootweave.sources import wire
from rootweave.sources.adapters import SECOND, alarms
from rootweave.streaming import live as live_streams
from rootweave.streaming import ordered, state

#: The patterns of ``patterns``: two for each of twelve trails.
PATTERNS = f""", patterns AS (
  SELECT concat('P0-', t) AS pattern_id, concat('T', t) AS trail_id, ['click', 'view', 'error'] AS seq, 'error' AS root_type,
    CAST(0.87 AS DOUBLE) AS confidence, {3600 * SECOND} AS window_us, true AS by_gap FROM range(12) r(t)
  UNION ALL
  SELECT concat('P1-', t), concat('T', t), ['purchase', 'signup'], 'signup', CAST(0.8 AS DOUBLE), {5400 * SECOND}, false FROM range(12) r(t)
)"""
#: Every row of ``run`` is an instance after its k-th alarm: m has the alarm at each place of the pattern (null: none yet),
#: a the alarms in the order of their admission; what the alarm brought about stands in the further columns.
MACHINE = (
    "RECURSIVE"
    + PATTERNS
    + """, relevant AS (
  SELECT p.*, f.alarm_id, f.alarm_type, f.raised_us, row_number() OVER (PARTITION BY p.pattern_id ORDER BY f.raised_us, f.alarm_id) AS k
  FROM (SELECT alarm_id, alarm_type, raised_us, unnest(trail_ids) AS trail_id FROM alarms) f
  JOIN patterns p ON p.trail_id = f.trail_id AND list_contains(p.seq, f.alarm_type)
), run AS (
  SELECT pattern_id, 0::BIGINT AS k, NULL::BIGINT AS opened, NULL::BIGINT AS last, list_transform(seq, lambda x: NULL::VARCHAR) AS m, []::VARCHAR[] AS a,
    NULL::BIGINT AS ended, []::VARCHAR[] AS ended_alarms, false AS admitted, false AS fired, NULL::VARCHAR AS alarm_id, NULL::BIGINT AS at_us,
    list_transform(seq, lambda x: NULL::VARCHAR) AS members FROM patterns
  UNION ALL
  SELECT pattern_id, k, CASE WHEN fires THEN NULL ELSE new_opened END, CASE WHEN fires THEN NULL ELSE new_last END,
    CASE WHEN fires THEN list_transform(seq, lambda x: NULL::VARCHAR) ELSE new_m END, CASE WHEN fires THEN []::VARCHAR[] ELSE new_a END,
    ended, ended_alarms, admits, fires, alarm_id, raised_us, new_m
  FROM (
    SELECT *, admits AND len(list_filter(new_m, lambda x: x IS NOT NULL)) >= greatest(1, len(seq) - 1) AS fires
    FROM (
      SELECT *, CASE WHEN admits THEN list_transform(m1, lambda x, i: CASE WHEN i = place THEN alarm_id ELSE x END) ELSE m1 END AS new_m,
        CASE WHEN admits THEN list_append(a1, alarm_id) ELSE a1 END AS new_a,
        CASE WHEN admits THEN coalesce(opened1, raised_us) ELSE opened1 END AS new_opened, CASE WHEN admits THEN raised_us ELSE last1 END AS new_last
      FROM (
        SELECT *, place IS NOT NULL AND (opened1 IS NOT NULL OR alarm_type = seq[1]) AS admits
        FROM (
          SELECT *, list_min(list_filter(range(1, len(seq) + 1), lambda i: seq[i] = alarm_type AND m1[i] IS NULL)) AS place
          FROM (
            SELECT r.*, CASE WHEN gone THEN NULL ELSE opened END AS opened1, CASE WHEN gone THEN NULL ELSE last END AS last1,
              CASE WHEN gone THEN list_transform(r.seq, lambda x: NULL::VARCHAR) ELSE m END AS m1, CASE WHEN gone THEN []::VARCHAR[] ELSE a END AS a1,
              CASE WHEN gone THEN deadline END AS ended, CASE WHEN gone THEN a ELSE []::VARCHAR[] END AS ended_alarms
            FROM (
              SELECT r.*, s.opened, s.last, s.m, s.a, CASE WHEN r.by_gap THEN s.last ELSE s.opened END + r.window_us AS deadline,
                coalesce(r.raised_us > CASE WHEN r.by_gap THEN s.last ELSE s.opened END + r.window_us, false) AS gone
              FROM run s JOIN relevant r ON r.pattern_id = s.pattern_id AND r.k = s.k + 1
            ) r
          )
        )
      )
    )
  )
), final AS (
  SELECT s.* FROM run s JOIN (SELECT pattern_id, max(k) AS k FROM run GROUP BY ALL) USING (pattern_id, k)
), fired AS (
  SELECT p.trail_id, s.pattern_id, s.at_us, list_filter(s.members, lambda x: x IS NOT NULL) AS ids,
    coalesce(s.members[list_min(list_filter(range(1, len(p.seq) + 1), lambda i: p.seq[i] = p.root_type AND s.members[i] IS NOT NULL))],
      list_filter(s.members, lambda x: x IS NOT NULL)[1]) AS root, p.confidence, len(p.seq) AS n
  FROM run s JOIN patterns p USING (pattern_id) WHERE s.fired
), happened AS (
  SELECT 'in-progress' AS kind, p.trail_id, s.pattern_id, s.at_us, NULL AS root_alarm_id, [s.alarm_id] AS alarm_ids, 0.0::DOUBLE AS confidence
    FROM run s JOIN patterns p USING (pattern_id) WHERE s.admitted AND NOT s.fired
  UNION ALL SELECT 'incident', trail_id, pattern_id, at_us, root, ids, least(1.0, confidence * len(ids) / n) FROM fired
  UNION ALL SELECT 'reverted', p.trail_id, s.pattern_id, s.ended, NULL, s.ended_alarms, NULL FROM run s JOIN patterns p USING (pattern_id) WHERE len(s.ended_alarms) > 0
  UNION ALL SELECT 'reverted', p.trail_id, s.pattern_id, CASE WHEN p.by_gap THEN s.last ELSE s.opened END + p.window_us, NULL, s.a, NULL
    FROM final s JOIN patterns p USING (pattern_id) WHERE len(s.a) > 0
), incidents AS (
  SELECT DISTINCT sha256(concat_ws('|', trail_id, pattern_id, array_to_string(list_sort(alarm_ids), '|'))) AS incident_id, trail_id, pattern_id,
    at_us AS created_us, root_alarm_id, list_filter(alarm_ids, lambda x: x <> root_alarm_id) AS child_alarm_ids, confidence
  FROM happened WHERE kind = 'incident'
), members AS (
  SELECT incident_id, created_us, confidence, len(child_alarm_ids) + 1 AS size, root_alarm_id AS alarm_id, 'root' AS role FROM incidents
  UNION ALL SELECT incident_id, created_us, confidence, len(child_alarm_ids) + 1, unnest(child_alarm_ids), 'child' FROM incidents
) """
)
ROLES = """SELECT alarm_id, incident_id, role FROM (
  SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY created_us DESC, incident_id DESC, role DESC) AS n FROM members) WHERE n = 1"""


def correlated(spark: SparkSession, d: str) -> DataFrame:
    return correlate.correlate(alarms(spark, d), patterns(spark))


def found_incidents(spark: SparkSession, d: str) -> DataFrame:
    return correlate.incidents(correlated(spark, d))


@query(
    MACHINE
    + """SELECT kind, trail_id, pattern_id, at_us, root_alarm_id, array_to_string(alarm_ids, ' ') AS alarm_ids, round(confidence, 9) AS confidence
  FROM happened"""
)
def correlation_events(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join("alarm_ids", " ").alias("alarm_ids")
    return correlated(spark, d).select("kind", "trail_id", "pattern_id", "at_us", "root_alarm_id", joined, F.round("confidence", 9).alias("confidence"))


@query(MACHINE + "SELECT * REPLACE (array_to_string(child_alarm_ids, ' ') AS child_alarm_ids, round(confidence, 9) AS confidence) FROM incidents")
def incidents(spark: SparkSession, d: str) -> DataFrame:
    rows = found_incidents(spark, d)
    return rows.withColumn("child_alarm_ids", F.array_join("child_alarm_ids", " ")).withColumn("confidence", F.round("confidence", 9))


@query(MACHINE + "SELECT alarm_id, alarm_type FROM alarms WHERE alarm_id NOT IN (SELECT alarm_id FROM members)")
def uncovered_alarms(spark: SparkSession, d: str) -> DataFrame:
    return correlate.uncovered(alarms(spark, d), found_incidents(spark, d)).select("alarm_id", "alarm_type")


@query(
    MACHINE
    + """, ranked AS (
  SELECT incident_id, row_number() OVER (PARTITION BY alarm_id ORDER BY size DESC, confidence DESC, incident_id) AS n FROM members
) SELECT incident_id FROM ranked GROUP BY incident_id HAVING max(n) = 1"""
)
def resolved_conflicts(spark: SparkSession, d: str) -> DataFrame:
    members = F.explode(F.array_union(F.array("root_alarm_id"), "child_alarm_ids")).alias("alarm_id")
    return correlate.resolved(found_incidents(spark, d).select("incident_id", members, (F.size("child_alarm_ids") + 1).alias("size"), "confidence"))


@query(
    MACHINE
    + """SELECT unnest(alarm_ids) AS alarm_id, CASE kind WHEN 'incident' THEN 'correlated' WHEN 'reverted' THEN 'reverted-open' ELSE kind END AS new_status,
  at_us AS changed_us FROM happened"""
)
def status_events(spark: SparkSession, d: str) -> DataFrame:
    return correlate.statuses(correlated(spark, d))


@query(MACHINE + "SELECT m.incident_id, m.role, m.alarm_id, a.moid, a.severity FROM members m JOIN alarms a USING (alarm_id) WHERE a.severity <> 'warning'")
def incident_members(spark: SparkSession, d: str) -> DataFrame:
    known = alarms(spark, d).where("severity <> 'warning'")  # members that aren't known drop out
    return correlate.members(found_incidents(spark, d), known).select("incident_id", "role", "alarm_id", "moid", "severity")


@query(MACHINE + "SELECT alarm_id, moid FROM alarms WHERE alarm_id IN (SELECT alarm_id FROM members WHERE role = 'child')")
def incident_children(spark: SparkSession, d: str) -> DataFrame:
    return correlate.children(found_incidents(spark, d), alarms(spark, d)).select("alarm_id", "moid")


TICK_US = 6 * HOUR
LEFTOVER = (
    MACHINE
    + SCENARIOS
    + f""", taken AS (
  SELECT DISTINCT trail_id, unnest(alarm_ids) AS alarm_id FROM happened WHERE kind <> 'reverted'
), sets AS (
  SELECT concat('tick/', f.trail_id, '/', f.raised_us // {TICK_US}) AS set_id, f.trail_id, f.alarm_type AS token
  FROM (SELECT alarm_id, alarm_type, raised_us, unnest(trail_ids) AS trail_id FROM alarms) f ANTI JOIN taken t ON t.trail_id = f.trail_id AND t.alarm_id = f.alarm_id
  UNION ALL
  SELECT e.set_id, e.trail_id, a.alarm_type FROM (
    SELECT concat('expired/', trail_id, '/', pattern_id, '/', at_us) AS set_id, trail_id, unnest(alarm_ids) AS alarm_id FROM happened WHERE kind = 'reverted'
  ) e JOIN alarms a USING (alarm_id)
), o AS (
  SELECT set_id, trail_id, token, count(*) AS o FROM sets GROUP BY ALL
), s AS (
  SELECT scenario_id, trail_id, token, count(*) AS s FROM scenarios GROUP BY ALL
), common AS (
  SELECT set_id, trail_id, scenario_id, sum(least(o, s)) AS c FROM o JOIN s USING (trail_id, token) GROUP BY ALL
), scored AS (
  SELECT set_id, scenario_id, n_s, 1.0 * (n_s - c) + 2.0 * (n_o - c) AS distance, greatest(0, 1 - (1.0 * (n_s - c) + 2.0 * (n_o - c)) / (1.0 * n_s + 2.0 * n_o)) AS score
  FROM common JOIN (SELECT set_id, sum(o) AS n_o FROM o GROUP BY ALL) USING (set_id)
  JOIN (SELECT scenario_id, trail_id, sum(s) AS n_s FROM s GROUP BY ALL) USING (scenario_id, trail_id)
)
"""
)


def known_scenarios(spark: SparkSession) -> DataFrame:
    """scenario_id, trail_id and token of three scenarios on each trail, as SCENARIOS has them."""
    tokens = [(f"S{k}", f"T{t}", x) for t in range(12) for k, ts in enumerate((["click", "view", "error"], ["purchase", "purchase"], ["signup"])) for x in ts]
    return spark.createDataFrame(tokens, "scenario_id string, trail_id string, token string")


@query(
    LEFTOVER
    + """SELECT set_id, scenario_id, CAST(distance AS DOUBLE) AS distance, round(CAST(score AS DOUBLE), 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, n_s DESC, scenario_id) AS n FROM scored WHERE score > 0.5) WHERE n = 1"""
)
def leftover_decoding(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    sets = correlate.leftover_sets(rows, patterns(spark), correlated(spark, d), TICK_US)
    return correlate.decode(sets, known_scenarios(spark)).withColumn("score", F.round("score", 9))


NEWEST = f""", due AS (
  SELECT DISTINCT set_id, trail_id, CASE WHEN set_id LIKE 'tick/%' THEN (CAST(regexp_extract(set_id, '([0-9]+)$', 1) AS BIGINT) + 1) * {TICK_US}
    ELSE CAST(regexp_extract(set_id, '([0-9]+)$', 1) AS BIGINT) END AS due_us FROM sets
), span AS (
  SELECT trail_id, min(raised_us) AS low, max(raised_us) AS high FROM (SELECT raised_us, unnest(trail_ids) AS trail_id FROM alarms) GROUP BY trail_id
), editions AS (
  SELECT trail_id, 'cb-1' AS codebook_id, low AS compiled_us FROM span UNION ALL SELECT trail_id, 'cb-2', (low + high) // 2 FROM span
), chosen AS (
  SELECT d.set_id, d.trail_id, max(struct_pack(a := compiled_us, b := codebook_id)).b AS codebook_id
  FROM due d JOIN editions e ON e.trail_id = d.trail_id AND e.compiled_us <= d.due_us GROUP BY d.set_id, d.trail_id
), contents AS (
  SELECT e.codebook_id, s.trail_id, s.scenario_id, s.token, count(*) AS s FROM scenarios s JOIN editions e USING (trail_id)
  WHERE e.codebook_id = 'cb-1' OR s.scenario_id <> 'S0' GROUP BY ALL
), shared AS (
  SELECT o.set_id, c.codebook_id, c.trail_id, c.scenario_id, sum(least(o.o, c.s)) AS c FROM o JOIN chosen h ON h.set_id = o.set_id
  JOIN contents c ON c.trail_id = o.trail_id AND c.codebook_id = h.codebook_id AND c.token = o.token GROUP BY ALL
), rated AS (
  SELECT set_id, codebook_id, scenario_id, n_s, 1.0 * (n_s - c) + 2.0 * (n_o - c) AS distance, greatest(0, 1 - (1.0 * (n_s - c) + 2.0 * (n_o - c)) / (1.0 * n_s + 2.0 * n_o)) AS score
  FROM shared JOIN (SELECT set_id, sum(o) AS n_o FROM o GROUP BY ALL) USING (set_id)
  JOIN (SELECT codebook_id, trail_id, scenario_id, sum(s) AS n_s FROM contents GROUP BY ALL) USING (codebook_id, trail_id, scenario_id)
)
"""


@query(
    LEFTOVER
    + NEWEST
    + """SELECT set_id, codebook_id, scenario_id, CAST(distance AS DOUBLE) AS distance, round(CAST(score AS DOUBLE), 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, n_s DESC, scenario_id) AS n FROM rated WHERE score > 0.5) WHERE n = 1"""
)
def newest_decoding(spark: SparkSession, d: str) -> DataFrame:
    """A trail's second codebook, compiled halfway, lacks a scenario of its first."""
    rows = alarms(spark, d)
    span = rows.select("raised_us", F.explode("trail_ids").alias("trail_id")).groupBy("trail_id").agg(F.min("raised_us").alias("low"), F.max("raised_us").alias("high"))
    first = span.select("trail_id", F.lit("cb-1").alias("codebook_id"), F.col("low").alias("compiled_us"))
    editions = first.unionByName(span.select("trail_id", F.lit("cb-2").alias("codebook_id"), F.expr("(low + high) div 2").alias("compiled_us")))
    contents = editions.join(known_scenarios(spark), "trail_id").where("codebook_id = 'cb-1' or scenario_id <> 'S0'")
    sets = correlate.leftover_sets(rows, patterns(spark), correlated(spark, d), TICK_US)
    return correlate.decode_newest(sets, contents).withColumn("score", F.round("score", 9))


BOOKS = """, books AS (
  SELECT source AS snapshot, trail_id, concat('cb-', severity) AS codebook_id, max(raised_us) OVER (PARTITION BY source, severity) AS compiled_us, alarm_id AS scenario_id
  FROM (SELECT alarm_id, severity, source, raised_us, unnest(trail_ids) AS trail_id FROM alarms)
) """


def books(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    built = rows.groupBy("source", "severity").agg(F.max("raised_us").alias("compiled_us"))
    fanned = rows.select("alarm_id", "severity", "source", F.explode("trail_ids").alias("trail_id")).join(built, ["source", "severity"])
    return fanned.select(F.col("source").alias("snapshot"), "trail_id", F.concat(F.lit("cb-"), "severity").alias("codebook_id"), "compiled_us", F.col("alarm_id").alias("scenario_id"))


@query(
    BOOKS
    + """SELECT snapshot, trail_id, codebook_id, scenario_id FROM (
  SELECT *, max(struct_pack(a := compiled_us, b := codebook_id)) OVER (PARTITION BY snapshot, trail_id) AS newest FROM books
) WHERE codebook_id = newest.b"""
)
def latest_codebooks(spark: SparkSession, d: str) -> DataFrame:
    return correlate.latest_codebook(books(spark, d)).select("snapshot", "trail_id", "codebook_id", "scenario_id")


@query(
    BOOKS
    + """SELECT snapshot, codebook_id, row_number() OVER (PARTITION BY snapshot ORDER BY compiled_us DESC, codebook_id DESC) = 1 AS active
  FROM (SELECT DISTINCT snapshot, codebook_id, compiled_us FROM books)"""
)
def active_codebooks(spark: SparkSession, d: str) -> DataFrame:
    every = books(spark, d).select("snapshot", "codebook_id", "compiled_us").distinct()
    return rules.with_active(every, ["snapshot"], "compiled_us", "codebook_id").select("snapshot", "codebook_id", "active")


# alarm state
@query(MACHINE + ROLES)
def alarm_roles(spark: SparkSession, d: str) -> DataFrame:
    return live.roles(found_incidents(spark, d))


CHANGES = """, changes AS (
  SELECT concat('E', event_id) AS event_id, concat('ALM-', event_id - event_id % 3) AS alarm_id,
    CASE event_id % 3 WHEN 0 THEN 'in-progress' WHEN 1 THEN 'correlated' ELSE 'reverted-open' END AS new_status, epoch_us(ts) AS changed_us
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
), latest AS (
  SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY changed_us DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY alarm_id) AS c FROM changes
), states AS (
  SELECT a.alarm_id, CASE WHEN new_status = 'reverted-open' THEN 'open' ELSE coalesce(new_status, 'open') END AS status, coalesce(changed_us, raised_us) AS since_us,
    coalesce(c, 0) AS n_changes FROM alarms a LEFT JOIN latest l ON l.alarm_id = a.alarm_id AND n = 1
) """


@query(MACHINE + CHANGES + f"SELECT alarm_id, status, since_us, n_changes, incident_id, role FROM states FULL JOIN ({ROLES}) USING (alarm_id)")
def alarm_states(spark: SparkSession, d: str) -> DataFrame:
    return live.state(live.lifecycle(alarms(spark, d), all_changes(spark, d)), alarm_roles(spark, d))


@query("SELECT alarm_id, raised_us, moid, alarm_type, 'open' AS status FROM alarms WHERE state = 'raised'")
def opened_alarms(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    return live.opened_once(rows.unionByName(rows))  # every event comes twice


@query(
    CHANGES
    + """, every AS (
  SELECT * FROM changes UNION ALL SELECT concat('clear/', alarm_id, '/', raised_us), alarm_id, 'cleared', raised_us FROM alarms WHERE state = 'cleared'
), newest AS (
  SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY changed_us DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY alarm_id) AS c FROM every
)
SELECT a.alarm_id, CASE WHEN new_status = 'reverted-open' THEN 'open' ELSE coalesce(new_status, 'open') END AS status, coalesce(changed_us, raised_us) AS since_us,
  coalesce(c, 0) AS n_changes FROM alarms a LEFT JOIN newest l ON l.alarm_id = a.alarm_id AND n = 1"""
)
def cleared_alarms(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    return live.lifecycle(rows, all_changes(spark, d).unionByName(live.clears(rows)))


@query(AUDIT + "SELECT concat(upper(pattern_id), '!') AS pattern_id, state, changed_us FROM audit WHERE state = 'approved' AND changed_us >= 1704153600000000")
def filtered_list(spark: SparkSession, d: str) -> DataFrame:
    state = F.expr("case source when 'src0' then 'draft' when 'src1' then 'approved' else 'deprecated' end")
    audit = alarms(spark, d).select(F.concat(F.upper("moid"), F.lit("!")).alias("pattern_id"), state.alias("state"), F.col("raised_us").alias("changed_us"))
    return tables.filtered(audit, since_us=1_704_153_600_000_000, at="changed_us", match="pattern", state="approved")


@query(
    MACHINE
    + """, chosen AS (SELECT incident_id, created_us FROM incidents WHERE trail_id = 'T3')
SELECT array_to_string(list(incident_id ORDER BY created_us DESC, incident_id), ' ') AS items, (SELECT count(*) FROM chosen) AS total, 20 AS limit, 10 AS offset
FROM (SELECT * FROM chosen ORDER BY created_us DESC, incident_id LIMIT 20 OFFSET 10)"""
)
def incident_list(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.filtered(found_incidents(spark, d), trail="T3", match="pattern").select("incident_id", "created_us")
    page = tables.listed(rows, F.desc("created_us"), F.col("incident_id"), offset=10, limit=20)
    return page.withColumn("items", F.array_join("items.incident_id", " "))


# figures
@query(
    MACHINE
    + """SELECT (SELECT count(*) FROM incidents) AS incidents, (SELECT count(*) FROM incidents) AS by_pattern, 0::BIGINT AS by_codebook, count(*) AS alarms,
  (SELECT count(DISTINCT alarm_id) FROM members) AS correlated, count(*) / (SELECT nullif(count(*), 0) FROM incidents) AS reduction,
  (SELECT count(DISTINCT alarm_id) FROM members) / count(*) AS share_correlated FROM alarms"""
)
def incident_stats(spark: SparkSession, d: str) -> DataFrame:
    return kpi.incident_stats(found_incidents(spark, d), alarms(spark, d))


#: Labels: the critical alarms of a source in one hour are a scenario, the first its root.
LABELS = f""", marked AS (
  SELECT alarm_id, alarm_type, concat(source, '/', raised_us // {HOUR}) AS scenario, source AS scenario_type,
    row_number() OVER (PARTITION BY source, raised_us // {HOUR} ORDER BY raised_us, alarm_id) AS n FROM alarms WHERE severity = 'critical'
) """


def labels(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.col("raised_us") / HOUR).cast("string")
    rows = alarms(spark, d).where("severity = 'critical'").select("alarm_id", "alarm_type", "raised_us", F.concat_ws("/", "source", hour).alias("scenario"), F.col("source").alias("scenario_type"))
    sorted_ = F.array_sort(F.collect_list(F.struct("raised_us", "alarm_id", "alarm_type")))
    each = rows.groupBy("scenario", "scenario_type").agg(sorted_.alias("a"))
    return each.select("scenario", "scenario_type", F.col("a")[0]["alarm_id"].alias("root_alarm_id"), F.col("a")[0]["alarm_type"].alias("root_alarm_type"), F.slice(F.col("a.alarm_id"), F.lit(2), F.size("a")).alias("children"))


@query(LABELS + "SELECT alarm_id, alarm_id NOT IN (SELECT alarm_id FROM marked) AS is_noise FROM alarms")
def noise_truth(spark: SparkSession, d: str) -> DataFrame:
    return kpi.noise_of(alarms(spark, d), labels(spark, d))


@query(
    MACHINE
    + LABELS
    + """SELECT m.scenario, count(i.incident_id) AS incidents, count(i.incident_id) > 0 AS hit
  FROM marked m LEFT JOIN incidents i ON i.root_alarm_id = m.alarm_id WHERE m.n = 1 GROUP BY m.scenario"""
)
def accuracy_by_scenario(spark: SparkSession, d: str) -> DataFrame:
    return kpi.accuracy_by_scenario(found_incidents(spark, d), labels(spark, d))


@query(
    MACHINE
    + LABELS
    + """, shares AS (
  SELECT count(*) FILTER (a.alarm_type IN (SELECT alarm_type FROM marked WHERE n = 1)) / nullif(count(*), 0) AS value FROM incidents i LEFT JOIN alarms a ON a.alarm_id = i.root_alarm_id
) SELECT round(value, 9) AS value, CASE WHEN value IS NULL THEN 'na' ELSE 'client-side-join' END AS source FROM shares
  UNION ALL SELECT 0.75, 'eval' UNION ALL SELECT NULL, 'na'"""
)
def accuracy_sources(spark: SparkSession, d: str) -> DataFrame:
    types = alarms(spark, d).select(F.col("alarm_id").alias("root_alarm_id"), F.col("alarm_type").alias("root_alarm_type"))
    found = found_incidents(spark, d).join(types, "root_alarm_id", "left")
    truth = labels(spark, d)
    every = kpi.accuracy(found, truth).unionByName(kpi.accuracy(found, truth, 0.75)).unionByName(kpi.accuracy(found, truth.limit(0)))
    return every.withColumn("value", F.round("value", 9))


@query(
    CLUSTERS
    + LABELS
    + """, kept AS (SELECT DISTINCT alarm_id FROM clustered WHERE cluster IS NOT NULL
), truth AS (SELECT alarm_id, alarm_id NOT IN (SELECT alarm_id FROM marked) AS is_noise FROM alarms
), shares AS (
  SELECT count(*) FILTER (NOT is_noise) / count(*) AS coverage, count(*) FILTER (is_noise AND alarm_id NOT IN (SELECT alarm_id FROM kept)) / count(*) AS removed FROM truth
) SELECT round(coverage, 9) AS coverage, round(removed, 9) AS removed, round(coverage + removed, 9) AS auto_handled FROM shares"""
)
def auto_handled(spark: SparkSession, d: str) -> DataFrame:
    found = kpi.handled(kpi.noise_of(alarms(spark, d), labels(spark, d)), clusters(spark, d).where("cluster is not null"))
    return found.select(*[F.round(c, 9).alias(c) for c in ("coverage", "removed", "auto_handled")])


@query(LABELS + "SELECT scenario_type, count(*) AS instances, (SELECT count(DISTINCT scenario_type) FROM marked) AS types FROM marked WHERE n = 1 GROUP BY scenario_type")
def scenario_counts(spark: SparkSession, d: str) -> DataFrame:
    return kpi.scenario_counts(labels(spark, d))


# enrichment
@query(
    """, mapping(ruleset, field, raw, value) AS (VALUES ('vendor-a', 'severity', 'warning', 'info'), ('vendor-a', 'alarm_type', 'click', 'Press'), ('plain', 'event_type', 'w', 'W'))
  SELECT alarm_id, coalesce(s.value, a.severity) AS severity, coalesce(e.value, a.event_type) AS event_type, coalesce(t.value, a.alarm_type) AS alarm_type, 'enricher' AS source,
    concat('{"perceivedSeverity":"', a.severity, '","eventType":"', a.event_type, '","alarmType":"', a.alarm_type, '"}') AS vendor_raw
  FROM (SELECT *, CASE WHEN source = 'src0' THEN 'vendor-a' ELSE 'plain' END AS ruleset, substr(severity, 1, 1) AS event_type FROM alarms) a
  LEFT JOIN mapping s ON s.ruleset = a.ruleset AND s.field = 'severity' AND s.raw = a.severity
  LEFT JOIN mapping e ON e.ruleset = a.ruleset AND e.field = 'event_type' AND e.raw = a.event_type
  LEFT JOIN mapping t ON t.ruleset = a.ruleset AND t.field = 'alarm_type' AND t.raw = a.alarm_type"""
)
def normalised_fields(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.createDataFrame([("src0", "vendor-a"), ("default", "plain")], "source string, ruleset string")
    rows = [("vendor-a", "severity", "warning", "info"), ("vendor-a", "alarm_type", "click", "Press"), ("plain", "event_type", "w", "W")]
    mapping = spark.createDataFrame(rows, "ruleset string, field string, raw string, value string")
    some = enrich.with_ruleset(alarms(spark, d), sets).withColumn("event_type", F.substring("severity", 1, 1))
    return enrich.normalised_fields(some, mapping).select("alarm_id", "severity", "event_type", "alarm_type", "source", "vendor_raw")


@query("SELECT * EXCLUDE (n) REPLACE (array_to_string(trail_ids, ' ') AS trail_ids) FROM (SELECT *, row_number() OVER (PARTITION BY alarm_id ORDER BY raised_us) AS n FROM alarms) WHERE n = 1")
def deduped_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d)
    late = rows.withColumn("raised_us", F.col("raised_us") + 1)  # every alarm is delivered again later
    return enrich.deduped(rows.unionByName(late)).withColumn("trail_ids", F.array_join("trail_ids", " "))


@query(
    """SELECT alarm_id, CASE WHEN source = 'src2' THEN 'trail lookup failed' END AS reject_reason,
  CASE WHEN source = 'src0' THEN '' WHEN source = 'src1' THEN array_to_string(list_sort(trail_ids), ' ') END AS trails FROM alarms"""
)
def lookup_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).withColumn("moid", F.concat_ws("/", "moid", "source"))
    none = F.array().cast("array<string>")
    answers = rows.select("moid", (F.col("source") != "src2").alias("ok"), F.when(F.col("source") == "src0", none).otherwise(F.col("trail_ids")).alias("trail_ids")).distinct()
    good, bad = enrich.split_lookups(rows, answers)
    reason = F.lit(None).cast("string")
    return good.select("alarm_id", reason.alias("reject_reason"), F.array_join("trail_ids", " ").alias("trails")).unionByName(bad.select("alarm_id", "reject_reason", reason.alias("trails")))


@query(
    """, listed(moid, alarm_type, note) AS (VALUES ('Node:u7', 'error', 'new'), ('Node:u8', 'view', 'new'))
  SELECT moid, alarm_type, coalesce(l.note, 'old') AS note FROM (SELECT DISTINCT moid, alarm_type FROM alarms) FULL JOIN listed l USING (moid, alarm_type)"""
)
def edited_chatter(spark: SparkSession, d: str) -> DataFrame:
    old = alarms(spark, d).select("moid", "alarm_type").distinct().withColumn("note", F.lit("old"))
    new = spark.createDataFrame([("Node:u7", "error", "new"), ("Node:u8", "view", "new")], "moid string, alarm_type string, note string")
    return rules.upsert(old, new, ["moid", "alarm_type"])


@query(
    """, shapes(alarm_type, event_type, probable_cause, perceived_severity) AS (VALUES ('LOS', 'communicationsAlarm', 'lossOfSignal', 'critical'),
    ('LineCardFault', 'equipmentAlarm', 'equipmentMalfunction', 'critical'), ('QueueDrop', 'qualityOfServiceAlarm', 'thresholdCrossed', 'minor'))
  SELECT t.token, s.event_type, s.probable_cause, s.perceived_severity, count(*) AS alarms
  FROM (SELECT CASE alarm_type WHEN 'error' THEN 'LOS' WHEN 'view' THEN 'LineCardFault' WHEN 'click' THEN 'QueueDrop' ELSE alarm_type END AS token FROM alarms) t
  LEFT JOIN shapes s ON s.alarm_type = t.token GROUP BY ALL"""
)
def shaped_alarms(spark: SparkSession, d: str) -> DataFrame:
    token = F.expr("case alarm_type when 'error' then 'LOS' when 'view' then 'LineCardFault' when 'click' then 'QueueDrop' else alarm_type end")
    rows = shapes.shaped(alarms(spark, d).withColumn("alarm_type", token))
    return rows.groupBy(F.col("alarm_type").alias("token"), "event_type", "probable_cause", "perceived_severity").agg(F.count("*").alias("alarms"))


SHARED_IDS = """, shared AS (SELECT * REPLACE (concat('ALM-', moid) AS alarm_id) FROM alarms
), opened AS (SELECT alarm_id, min(raised_us) AS raised_us FROM shared WHERE state = 'raised' GROUP BY alarm_id
), cleared AS (SELECT DISTINCT alarm_id, raised_us, concat('clear/', alarm_id, '/', raised_us) AS event_id FROM shared WHERE state = 'cleared'
), newest AS (SELECT alarm_id, count(*) AS c, max(raised_us) AS cleared_us FROM cleared GROUP BY alarm_id) """


@query(SHARED_IDS + """SELECT alarm_id, CASE WHEN c IS NULL THEN 'open' ELSE 'cleared' END AS status, coalesce(cleared_us, raised_us) AS since_us, coalesce(c, 0) AS n_changes, 1 AS published
  FROM opened LEFT JOIN newest USING (alarm_id)""")
def live_state(spark: SparkSession, d: str) -> DataFrame:
    """An object's alarms as one alarm: raises and clears of it, merged in three batches, the second of them twice."""
    rows = alarms(spark, d).withColumn("alarm_id", F.concat(F.lit("ALM-"), "moid"))
    none = spark.createDataFrame([], "event_id string, alarm_id string, new_status string, changed_us long")
    live_table = state.LiveTable(spark, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("raised_us"), F.lit(3))
    for number, k in enumerate((0, 1, 1, 2)):
        live_table.merge(state.changes_of(rows.where(part == k), none), number - (number > 1))
    published = live_table.published().groupBy("alarm_id").agg(F.count("*").alias("published"))
    return live_table.lifecycle().join(published, "alarm_id", "left")


#: Rows of a bucket and buckets of a state partition at which a stream of known size aims.
BUCKET_ROWS, PARTITION_BUCKETS = 16_384, 32


def streamed(spark: SparkSession, rows: DataFrame, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """rows as a stream of files in no order, through a step; what comes out, without the rows that end the stream.

    Buckets and state partitions come from the number of rows: each of them costs a call or a commit a batch, however few rows it has.
    """
    folder = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    last, n = rows.agg(F.max("raised_us"), F.count("*")).first()
    files = spark.sparkContext.defaultParallelism  # of a batch, so that all cores write and read it; three batches
    buckets = max(8 * files, n // BUCKET_ROWS)
    rows.repartition(3 * files, "alarm_id").write.parquet(f"{folder}/in")
    for k in (1, 2):  # long after all others: only then has the watermark passed them
        rows.limit(1).withColumn("moid", F.lit("end")).withColumn("raised_us", F.lit(last + k * 2 * 10**14)).write.mode("append").parquet(f"{folder}/in")
    live_streams.use_state_store(spark)
    stream = live_streams.timed(wire.replay(spark, f"{folder}/in", rows.schema, files), "2000 days")
    writer = step(stream, buckets).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # a started stream has its settings to itself
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), max(2 * files, buckets // PARTITION_BUCKETS))))
        sink = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    sink.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").where("moid <> 'end'")


@query()
def streamed_self_clears(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).withColumn("state", F.when(F.col("alarm_type") == "error", "cleared").otherwise("raised")).withColumn("alarm_type", F.lit("any"))
    return streamed(spark, rows, lambda s, buckets: ordered.without_self_clears(s, 4 * HOUR, buckets)).select("alarm_id", "state")


@query()
def streamed_flapping(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, alarms(spark, d), lambda s, buckets: ordered.without_flapping(s, 48 * HOUR, 1, buckets)).select("alarm_id")


# the streams give what the batch forms give
ORACLE_SQL |= {"streamed_self_clears": ORACLE_SQL["without_self_clears"], "streamed_flapping": ORACLE_SQL["without_flapping"]}

# the hash by which producers deal keys, four bytes at a time; moids are ASCII
WORD = "list_sum(list_transform(range(0, 4), lambda j: b[4 * i + j + 1] * (256 ** j)::BIGINT))::BIGINT"
TIMES = lambda x: f"(({x} * 1540483477::BIGINT) & 4294967295)"


@query(f""", keys AS (SELECT moid, list_transform(string_split(moid, ''), lambda c: ascii(c)::BIGINT) AS b, length(moid) AS n, count(*) AS events FROM alarms GROUP BY moid
), body AS (SELECT *, list_reduce(list_prepend(xor(2538058380::BIGINT, n::BIGINT), list_transform(range(0, n // 4), lambda i: {TIMES(WORD)})),
    lambda h, k: xor({TIMES("h")}, {TIMES("xor(k, k >> 24)")})) AS h, list_sum(list_transform(range(0, n % 4), lambda j: b[(n - n % 4) + j + 1] * (256 ** j)::BIGINT))::BIGINT AS tail FROM keys
), hashed AS (SELECT *, CASE WHEN n % 4 > 0 THEN {TIMES("xor(h, tail)")} ELSE h END AS g FROM body
), last AS (SELECT *, {TIMES("xor(g, g >> 13)")} AS f FROM hashed)
SELECT moid, CAST((xor(f, f >> 15) & 2147483647) % 3 AS INTEGER) AS partition, events FROM last""")
def key_partitions(spark: SparkSession, d: str) -> DataFrame:
    rows = wire.keyed(alarms(spark, d), F.lit("alarms.live"), F.col("moid"))
    return rows.groupBy("moid", "partition").agg(F.count("*").alias("events"))
