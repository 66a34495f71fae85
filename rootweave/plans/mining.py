"""Pattern mining: adaptive sessions for each trail, and frequent ordered sequences by pattern growth.

A pattern grows by one token where a session holds that token after the pattern's earliest end. Only patterns that are
among the most supported of their trail so far grow on; all trails grow at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.operators.ranks import exact_percentile
from rootweave.session import settle
from rootweave.sources.adapters import SECOND

BASE_US, FACTOR, PERCENT = 5 * SECOND, 3.0, 95
FAST_US, SLOW_US = SECOND // 2, 30 * SECOND
SUPPORT, LONGEST, MOST = 0.3, 10, 1000


#: A key's rows are put in order within stretches of time; what crosses their edges is one row for each stretch.
STRETCH_US = 24 * 3600 * SECOND


def with_previous(rows: DataFrame, keys: list[str], stretch_us: int = STRETCH_US) -> DataFrame:
    """rows with _stretch and _before, the time of the row before in the order of (raised_us, alarm_id) within the keys.

    No task sorts all rows of a key: the last time of a stretch is carried over to the next one that has rows.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col("raised_us") / stretch_us))
    ends = rows.groupBy(*keys, "_stretch").agg(F.max("raised_us").alias("_end"))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_stretch"))).drop("_end")
    order = Window.partitionBy(*keys, "_stretch").orderBy("raised_us", "alarm_id")
    return rows.join(carried, [*keys, "_stretch"]).withColumn("_before", F.coalesce(F.lag("raised_us").over(order), "_carried")).drop("_carried")


def running_total(rows: DataFrame, keys: list[str], flag: str, to: str) -> DataFrame:
    """rows (with _stretch) with the sum of ``flag`` up to each row, in the same order."""
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum(flag).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    order = Window.partitionBy(*keys, "_stretch").orderBy("raised_us", "alarm_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, [*keys, "_stretch"]).withColumn(to, F.col("_carried") + F.sum(flag).over(order)).drop("_carried")


def closing_gaps(rows: DataFrame, factor: float = FACTOR, percent: int = PERCENT, floor_us: int = FAST_US, ceiling_us: int = SLOW_US, base_us: int = BASE_US) -> DataFrame:
    """trail_id and gap_us: a percentile of the trail's gaps times a factor, between the fast and the slow profile.

    A trail with one alarm has the base gap.
    """
    gaps = with_previous(rows, ["trail_id"]).select("trail_id", (F.col("raised_us") - F.col("_before")).alias("gap"))
    gaps = exact_percentile(gaps, ["trail_id"], "gap", percent / 100, "p")
    limited = F.greatest(F.lit(float(floor_us)), F.least(F.lit(float(ceiling_us)), F.col("p") * factor))
    return gaps.select("trail_id", F.coalesce(limited, F.lit(float(base_us))).alias("gap_us"))


def sessions(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """rows with session (from 0 in each trail): a new one begins after a gap larger than the trail's."""
    joined = with_previous(rows, ["trail_id"]).join(gaps, "trail_id")
    begins = F.when(F.col("raised_us") - F.col("_before") > F.col("gap_us"), 1).otherwise(0)
    return running_total(joined.withColumn("_new", begins), ["trail_id"], "_new", "session").drop("_new", "gap_us", "_before", "_stretch")


def next_places(rows: DataFrame) -> DataFrame:
    """trail_id, session and places: for each token an array whose n-th entry is the first place of the token after place n.

    Places count from 1 in the order of (raised_us, alarm_id). A session is one row: an integer for each token and alarm.
    """
    order = Window.partitionBy("trail_id", "session").orderBy("raised_us", "alarm_id")
    placed = rows.select("trail_id", "session", F.row_number().over(order).alias("place"), F.col("alarm_type").alias("token"))
    before = F.lag("place", 1, 0).over(Window.partitionBy("trail_id", "session", "token").orderBy("place"))
    steps = placed.withColumn("step", F.struct("place", (F.col("place") - before).alias("width")))
    # up to a place, it is the next one: as often as places passed since the one before
    after = F.flatten(F.transform(F.array_sort(F.collect_list("step")), lambda s: F.array_repeat(s["place"], s["width"])))
    return steps.groupBy("trail_id", "session", "token").agg(after.alias("after")).groupBy("trail_id", "session").agg(F.map_from_entries(F.collect_list(F.struct("token", "after"))).alias("places"))


#: Trails whose prefixes (``most`` at most, of one row) may go to all tasks.
FEW_TRAILS = 500


def frequent_sequences(rows: DataFrame, support: float = SUPPORT, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """trail_id, sequence, freq, support, confidence and lift of the most supported sequences of each trail.

    rows: trail_id, session, raised_us, alarm_id, alarm_type. support is a share of the trail's sessions, confidence the
    share of those with the sequence but for its last token, lift confidence by that token's support; a single token has
    its support as confidence and lift 1. Of a trail's sequences with at least ``support``, the first ``most`` stay: by
    freq, falling, then by their tokens in order.

    What grows from a sequence has no more support, and is greater token by token, so that it always stands behind it. A
    sequence behind the first ``most`` of those found so far therefore never grows: a level has ``most`` prefixes a trail,
    however alike the sessions are.
    """
    start = F.array(F.lit(0)).alias("ends")  # the earliest end of each prefix of the level in this session, null if it has none
    held = settle(next_places(rows).select("trail_id", "session", "places", start), "held")
    totals = held.groupBy("trail_id").agg(F.count("*").alias("sessions"))
    found = single = None
    prefixes = totals.select("trail_id", F.lit(0).alias("at"), F.array().cast("array<string>").alias("prefix"))
    for length in range(1, longest + 1):
        reached = held.select("trail_id", "places", F.posexplode("ends").alias("at", "end")).where("end is not null")
        grown = reached.select("trail_id", "at", "end", F.explode("places").alias("token", "after")).where(F.get("after", F.col("end")).isNotNull())
        counts = grown.groupBy("trail_id", "at", "token").agg(F.count("*").alias("freq")).join(totals, "trail_id").where(F.col("freq") >= support * F.col("sessions"))
        level = counts.join(prefixes, ["trail_id", "at"]).select("trail_id", F.concat("prefix", F.array("token")).alias("sequence"), "prefix", "token", "freq", "sessions", F.lit(length).alias("length"))
        level = settle(level, "level")
        if level.isEmpty():
            break
        if single is None:
            single = level.select("trail_id", "token", F.col("freq").alias("alone"))
        rank = F.row_number().over(Window.partitionBy("trail_id").orderBy(F.desc("freq"), "sequence"))
        every = level if found is None else found.unionByName(level)
        found = settle(every.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank"), "found")
        if length == longest:
            break
        old = prefixes.select("trail_id", "prefix", F.col("at").alias("from"))
        fresh = found.where(F.col("length") == length).withColumn("at", F.row_number().over(Window.partitionBy("trail_id").orderBy("sequence")) - 1)
        fresh = settle(fresh.join(old, ["trail_id", "prefix"]).select("trail_id", "at", "from", "token", F.col("sequence").alias("prefix")), "prefixes")
        steps = fresh.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("at", "from", "token"))).alias("steps"))
        steps = settle(steps, "steps")
        if steps.isEmpty():
            break
        steps = F.broadcast(steps) if steps.count() <= FEW_TRAILS else steps
        ends = F.transform("steps", lambda s: F.get(F.element_at(F.col("places"), s["token"]), F.get(F.col("ends"), s["from"])))
        held = settle(held.join(steps, "trail_id").select("trail_id", "session", "places", ends.alias("ends")), "held")
        prefixes = fresh.select("trail_id", "at", "prefix")
    if found is None:
        return rows.sparkSession.createDataFrame([], "trail_id string, sequence array<string>, freq long, support double, confidence double, lift double")
    shorter = found.select("trail_id", F.col("sequence").alias("prefix"), F.col("freq").alias("before"))
    joined = found.join(shorter, ["trail_id", "prefix"], "left").join(single, ["trail_id", "token"])
    confidence = F.col("freq") / F.coalesce("before", "sessions")
    lift = F.when(F.col("length") == 1, 1.0).otherwise(confidence / (F.col("alone") / F.col("sessions")))
    return joined.select("trail_id", "sequence", "freq", (F.col("freq") / F.col("sessions")).alias("support"), confidence.alias("confidence"), lift.alias("lift"))


def timing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Span, and median, largest and standard deviation of gaps, in milliseconds, of the rows of each key."""
    order = Window.partitionBy(*keys).orderBy("raised_us", "alarm_id")
    gap = (F.col("raised_us") - F.lag("raised_us").over(order)) / 1000
    return rows.withColumn("gap", gap).groupBy(*keys).agg(((F.max("raised_us") - F.min("raised_us")) / 1000).alias("timeframe_ms"), F.percentile("gap", F.lit(0.5)).alias("median_ms"), F.max("gap").alias("max_gap_ms"), F.stddev_pop("gap").alias("stddev_ms"))


def gaps_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with gap_us, the time since the row before within the keys in the order of (raised_us, alarm_id); null at the first.

    Rows that lack a key drop out.
    """
    return with_previous(rows, keys).withColumn("gap_us", F.col("raised_us") - F.col("_before")).drop("_before", "_stretch")


def pattern_timing(found: DataFrame) -> DataFrame:
    """pattern_id, sessions, and median_ms, max_gap_ms and stddev_ms of the gaps within occurrences (pattern_id, session, at, raised_us).

    Medians are exact also where one pattern has a large part of all occurrences.
    """
    order = Window.partitionBy("pattern_id", "session").orderBy("at")
    gaps = found.withColumn("gap", F.col("raised_us") - F.lag("raised_us").over(order))
    sizes = gaps.groupBy("pattern_id").agg(F.countDistinct("session").alias("sessions"), (F.max("gap") / 1000).alias("max_gap_ms"), F.stddev_pop(F.col("gap") / 1000).alias("stddev_ms"))
    medians = exact_percentile(gaps, ["pattern_id"], "gap", 0.5, "median").select("pattern_id", (F.col("median") / 1000).alias("median_ms"))
    return sizes.join(medians, "pattern_id").select("pattern_id", "sessions", "median_ms", "max_gap_ms", "stddev_ms")


def samples(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    order = Window.partitionBy(*keys).orderBy("raised_us", "alarm_id")
    return rows.withColumn("sample", F.row_number().over(order)).where(F.col("sample") <= most)


def anchors(patterns: DataFrame, scenarios: DataFrame, least: float = 0.5) -> DataFrame:
    """pattern_id, scenario_id and overlap: the scenario of the domain with the most similar set of tokens, if similar enough.

    patterns: pattern_id, domain, sequence; scenarios: scenario_id, domain, symptoms. Candidates share a token.
    """
    a = patterns.select("pattern_id", "domain", F.explode(F.array_distinct("sequence")).alias("token"), F.size(F.array_distinct("sequence")).alias("m"))
    b = scenarios.select("scenario_id", "domain", F.explode(F.array_distinct("symptoms")).alias("token"), F.size(F.array_distinct("symptoms")).alias("n"))
    common = a.join(b, ["domain", "token"]).groupBy("pattern_id", "scenario_id", "m", "n").agg(F.count("*").alias("c"))
    scored = common.withColumn("overlap", F.col("c") / (F.col("m") + F.col("n") - F.col("c"))).where(F.col("overlap") >= least)
    best = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("overlap"), "scenario_id"))
    return scored.withColumn("_n", best).where("_n = 1").select("pattern_id", "scenario_id", "overlap")


def occurrences(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, trail_id, session and the alarms (raised_us, alarm_id, at: place in the pattern) of a pattern's leftmost
    occurrence in every session of its trail that holds it. rows: as for ``frequent_sequences``; patterns: pattern_id,
    trail_id and sequence."""
    place = Window.partitionBy("trail_id", "session").orderBy("raised_us", "alarm_id")
    tokens = settle(rows.select("trail_id", "session", "raised_us", "alarm_id", F.row_number().over(place).alias("place"), F.col("alarm_type").alias("token")), "tokens")
    longest = patterns.agg(F.max(F.size("sequence"))).first()[0] or 0
    held = patterns.join(tokens.select("trail_id", "session").distinct(), "trail_id").select("pattern_id", "trail_id", "session", "sequence", F.lit(0).alias("end"))
    found = None
    for at in range(longest):
        done = held.where(F.size("sequence") <= at)
        step = held.where(F.size("sequence") > at).withColumn("token", F.get("sequence", F.lit(at))).join(tokens, ["trail_id", "session", "token"]).where("place > end")
        first = step.groupBy("pattern_id", "trail_id", "session", "sequence").agg(F.min(F.struct("place", "raised_us", "alarm_id")).alias("f"))
        first = settle(first, "matched")
        new = first.select("pattern_id", "trail_id", "session", F.lit(at).alias("at"), "f.raised_us", "f.alarm_id")
        found = new if found is None else found.unionByName(new)
        held = settle(done.unionByName(first.select("pattern_id", "trail_id", "session", "sequence", F.col("f.place").alias("end"))), "held")
    whole = held.select("pattern_id", "session")
    return found.join(whole, ["pattern_id", "session"], "left_semi")
