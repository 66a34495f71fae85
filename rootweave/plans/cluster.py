"""Noise filter: alarms by trail and tumbling window, clustered by density; what belongs to no cluster is noise.

On one axis, time, density clusters need no pairs: differences of running counts are neighbours, core points chain while gaps stay
within eps, and a border point joins the earliest cluster with a core point within eps. With further features the same
definition holds between cells of equal features, each with the time that the difference of the features leaves.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.operators.components import components
from rootweave.session import settle
from rootweave.sources.adapters import SECOND

EPS_US, FEWEST, WINDOW_US = SECOND // 2, 3, 60 * SECOND


def windowed(alarms: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """One row for each alarm and trail, with the start of its tumbling window."""
    return alarms.withColumn("trail_id", F.explode("trail_ids")).drop("trail_ids").withColumn("window_us", F.col("raised_us") - F.pmod("raised_us", F.lit(window_us)))


def clustered(rows: DataFrame, eps_us: int = EPS_US, fewest: int = FEWEST, alike: tuple[str, ...] = ()) -> DataFrame:
    """Adds cluster (from 0 within trail and window; null for noise). A point counts itself.

    ``alike``: features in which neighbours must not differ. A differing feature adds 1 to a distance, so below an eps of 1
    (in units of the time scale) only points that are alike can be neighbours; clusters are then numbered by their first time.
    """
    group = ["trail_id", "window_us", *alike]
    # equal times are one place; sliding frames would read all rows near each row, running ones read each place once
    places = rows.groupBy(*group, "raised_us").agg(F.count("*").alias("_n"))
    mark = lambda shift, turn, n: places.select(*group, "raised_us", (F.col("raised_us") + shift).alias("_at"), F.lit(turn).alias("_turn"), n.alias("_n"))
    marks = mark(-eps_us, 0, F.lit(0)).unionByName(mark(0, 1, F.col("_n"))).unionByName(mark(eps_us, 2, F.lit(0)))
    so_far = F.sum("_n").over(Window.partitionBy(*group).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    sign = F.when(F.col("_turn") == 2, 1).when(F.col("_turn") == 0, -1).otherwise(0)
    near = marks.withColumn("_so_far", so_far).groupBy(*group, "raised_us").agg(F.sum(sign * F.col("_so_far")).alias("_near"))
    order = Window.partitionBy(*group).orderBy("raised_us")
    fresh = F.coalesce(F.col("raised_us") - F.lag("raised_us").over(order) > eps_us, F.lit(True))
    chain = F.sum(F.col("_fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    core = near.where(F.col("_near") >= fewest).withColumn("_fresh", fresh).withColumn("_chain", chain)
    # the earliest core point that is near: the first one from eps before on
    have = core.select(*group, F.lit(None).cast("long").alias("raised_us"), F.col("raised_us").alias("_at"), F.lit(0).alias("_turn"), F.struct(F.col("raised_us").alias("at"), "_chain").alias("_core"))
    ask = places.select(*group, "raised_us", (F.col("raised_us") - eps_us).alias("_at"), F.lit(1).alias("_turn"), F.lit(None).alias("_core"))
    onward = Window.partitionBy(*group).orderBy(F.desc("_at"), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    met = have.unionByName(ask).withColumn("_core", F.last("_core", ignorenulls=True).over(onward)).where("_turn = 1")
    met = met.where(F.col("_core.at") <= F.col("raised_us") + eps_us).select(*[F.col(c).alias(f"_{c}") for c in (*group, "raised_us")], F.col("_core._chain").alias("cluster"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, "raised_us")])
    found = rows.join(met, same, "left").select(*rows.columns, "cluster")
    if not alike:
        return found
    started = found.withColumn("_start", F.min("raised_us").over(Window.partitionBy(*group, "cluster")))
    number = F.dense_rank().over(Window.partitionBy("trail_id", "window_us").orderBy(F.col("cluster").isNull(), "_start", *alike, "cluster"))
    return started.withColumn("cluster", F.when(F.col("cluster").isNotNull(), number - 1)).drop("_start")


def clustered_by_features(rows: DataFrame, kinds: dict[str, float], eps: float, fewest: int, scale_us: int, numbers: dict[str, float] | None = None) -> DataFrame:
    """Adds cluster (from 0 within trail and window; null for noise): density clusters over time and further features.

    A distance is time apart / ``scale_us``, plus a weight for each of ``kinds`` (layer, event type, severity) that
    differs, plus weight * difference for each of ``numbers`` (hop distance). Points within ``eps`` are neighbours; a
    point with ``fewest``, itself included, is a core point. Clusters are numbered by their first core point in the order
    of (raised_us, alarm_id); a border point joins the first cluster that has a core point near it. Null is a kind, and
    differs from every number by more than any distance but from null by nothing.

    No pairs of points are made. Rows with equal features form a cell; two cells that are within eps leave some time in
    which their points are neighbours. A point that is core by the points of its own cell asks no other cell. For the rest,
    counts within that time are differences of running counts. Core points of one cell form chains; the nearest core points
    of other cells before and after a chain's start link it to theirs, and only chains that overlap in time and are not in
    one component by then are compared point by point. So work grows with the rows, and with the cells near those rows
    that have few of their own cell around them.
    """
    numbers = numbers or {}
    group, features = ["trail_id", "window_us"], [*kinds, *numbers]
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", F.struct(*features)), "rows")
    # cells have numbers, so that what is sorted and dealt is short; a row without trail or window has no neighbours
    cells = settle(rows.where("trail_id is not null and window_us is not null").select(*group, "_cell").distinct().withColumn("_id", F.monotonically_increasing_id()), "cells")
    other = cells.select(*group, F.col("_cell").alias("_other"), F.col("_id").alias("_near"))
    apart = F.lit(0.0)
    for f, weight in kinds.items():
        apart = apart + F.when(F.col(f"_cell.{f}").eqNullSafe(F.col(f"_other.{f}")), 0.0).otherwise(float(weight))
    for f, weight in numbers.items():
        x, y = F.col(f"_cell.{f}"), F.col(f"_other.{f}")
        apart = apart + F.when(x.isNull() & y.isNull(), 0.0).otherwise(F.coalesce(F.abs(x - y) * float(weight), F.lit(float("inf"))))
    # how far apart in time points of the two cells may be
    reach = cells.join(other, group).withColumn("_apart", apart).where(F.col("_apart") <= eps)
    reach = settle(reach.select("_id", "_near", F.floor((F.lit(float(eps)) - F.col("_apart")) * scale_us).cast("long").alias("_reach")), "reach")
    own = cells.join(reach.where("_id = _near").select("_id", F.col("_reach").alias("_own")), "_id", "left")
    points = rows.join(own, [*group, "_cell"]).select("_row", F.col("raised_us").alias("at"), "alarm_id", "_id", "_own")
    # core by its own cell: some so many before and the rest of the fewest after it are near enough; sufficient, and cheap
    line, before = Window.partitionBy("_id").orderBy("at"), max(fewest, 1) - 1
    fits = [(F.lead("at", before - k).over(line) - F.col("at") <= F.col("_own")) & (F.col("at") - F.lag("at", k).over(line) <= F.col("_own")) for k in {0, before // 2, before}]
    points = settle(points.withColumn("_sure", F.coalesce(reduce(or_, [F.coalesce(x, F.lit(False)) for x in fits]), F.lit(False))), "points")
    probes = settle(points.where("not _sure").join(reach, "_id").select("_row", "at", "_near", "_reach"), "probes")

    # neighbours: points up to the end of the reach, less points before its beginning
    place = Window.partitionBy("_near").orderBy("_at", "_turn")
    stand = points.select(F.lit(None).cast("long").alias("_row"), F.col("_id").alias("_near"), F.col("at").alias("_at"), F.lit(1).alias("_turn"))
    begin = probes.select("_row", "_near", (F.col("at") - F.col("_reach")).alias("_at"), F.lit(0).alias("_turn"))
    end = probes.select("_row", "_near", (F.col("at") + F.col("_reach")).alias("_at"), F.lit(2).alias("_turn"))
    so_far = F.count(F.when(F.col("_turn") == 1, 1)).over(place.rowsBetween(Window.unboundedPreceding, 0))
    counted = stand.unionByName(begin).unionByName(end).withColumn("_n", so_far).where("_row is not null")
    near = counted.groupBy("_row").agg(F.sum(F.when(F.col("_turn") == 2, F.col("_n")).otherwise(-F.col("_n"))).alias("_n"))
    core = points.where("_sure").unionByName(points.where("not _sure").join(near.where(F.col("_n") >= fewest).select("_row"), "_row"))

    # chains: core points of one cell with no gap beyond their reach; a chain is named by its first row
    line = Window.partitionBy("_id").orderBy("at", "_row")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(line) > F.col("_own"), F.lit(True))
    core = core.withColumn("_fresh", F.when(fresh, F.col("_row"))).withColumn("chain", F.last("_fresh", ignorenulls=True).over(line))
    core = settle(core.select("_row", "_id", "at", "alarm_id", "chain"), "core")
    chains = settle(core.groupBy("_id", "chain").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.min(F.struct("at", "alarm_id")).alias("first")), "chains")

    def nearest(asks: DataFrame) -> DataFrame:
        """asks (at, _near and more) with the nearest core points of the cell asked, before and after, and whether each is in reach."""
        more = [c for c in asks.columns if c not in ("at", "_near")]
        have = core.select("at", F.col("_id").alias("_near"), *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in more], "chain")
        both = have.unionByName(asks.withColumn("chain", F.lit(None).cast("long")))
        sides = []
        for direction in (F.asc, F.desc):
            seen = Window.partitionBy("_near").orderBy(direction("at"), F.col("chain").isNull()).rowsBetween(Window.unboundedPreceding, 0)
            found = F.last(F.when(F.col("chain").isNotNull(), F.struct("at", "chain")), ignorenulls=True).over(seen)
            met = both.withColumn("_core", found).where("chain is null and _core is not null")
            within = F.abs(F.col("_core.at") - F.col("at")) <= F.col("_reach")
            sides.append(met.select(*asks.columns, F.col("_core.chain").alias("chain"), within.alias("within"), F.lit(direction is F.asc).alias("before")))
        return sides[0].unionByName(sides[1])

    # what is not core asks all near cells; so does each chain, at its start
    loose = probes.join(core.select("_row"), "_row", "left_anti").withColumn("begun", F.lit(None).cast("long"))
    starts = chains.join(reach, "_id").where("_id <> _near").select(F.lit(None).cast("long").alias("_row"), F.col("start").alias("at"), "_near", "_reach", F.col("chain").alias("begun"))
    asked = settle(nearest(loose.unionByName(starts)).where("within or (before and begun is not null)"), "asked")
    links = asked.where("within and begun is not null").select(F.col("begun").alias("a"), F.col("chain").alias("b")).distinct()
    tops = rooted(chains, "chain", components(links))

    # of two chains in touch, the one that starts first still lasts at the other's start, or ends within reach before it
    top = tops.select("chain", "end", "root")
    pairs = asked.where("not within and begun is not null").join(top, "chain").where(F.col("end") > F.col("at")).drop("at")
    pairs = pairs.join(tops.select(F.col("chain").alias("begun"), F.col("root").alias("_root")), "begun").where("root <> _root")
    pairs = settle(pairs.select("begun", "_near", "_reach", (F.col("end") + F.col("_reach")).alias("_last")), "pairs")
    if not pairs.isEmpty():
        late = core.select("at", F.col("chain").alias("begun")).join(pairs, "begun").where(F.col("at") <= F.col("_last")).select("at", "_near", "_reach", "begun").distinct()
        met = nearest(late).where("within").select("begun", "chain").distinct()
        met = met.join(tops.select(F.col("chain").alias("begun"), F.col("root").alias("a")), "begun").join(tops.select("chain", F.col("root").alias("b")), "chain")
        tops = rooted(tops.withColumnRenamed("root", "_was"), "_was", components(met.where("a <> b").select("a", "b").distinct())).drop("_was")

    tops = tops.join(cells.select("_id", *group), "_id")
    first = tops.groupBy(*group, "root").agg(F.min("first").alias("first"))
    number = F.row_number().over(Window.partitionBy(*group).orderBy("first", "root")) - 1
    numbered = tops.select("chain", "root").join(first.select("root", number.alias("cluster")), "root").select("chain", "cluster")
    # a core point touches only its own cluster; others join the first one that they touch
    found = asked.where("within and begun is null").select("_row", "chain").unionByName(core.select("_row", "chain")).join(numbered, "chain").groupBy("_row").agg(F.min("cluster").alias("cluster"))
    return rows.join(found, "_row", "left").drop("_row", "_cell")


def rooted(chains: DataFrame, by: str, roots: DataFrame) -> DataFrame:
    """chains with root: that of ``by``, which is its own root where it has no links."""
    found = chains.join(roots.select(F.col("node").alias(by), "root"), by, "left")
    return settle(found.withColumn("root", F.coalesce("root", by)), "tops")


def run_stats(rows: DataFrame) -> DataFrame:
    """trail_id, window_us, alarms_in, clusters, alarms_kept, alarms_dropped, noise_ratio and storm_reduction (null without clusters)."""
    stats = rows.groupBy("trail_id", "window_us").agg(
        F.count("*").alias("alarms_in"), F.countDistinct("cluster").alias("clusters"), F.count("cluster").alias("alarms_kept"), F.count_if(F.col("cluster").isNull()).alias("alarms_dropped")
    )
    return stats.withColumn("noise_ratio", F.col("alarms_dropped") / F.col("alarms_in")).withColumn("storm_reduction", F.try_divide(F.col("alarms_in").cast("double"), F.col("clusters").cast("double")))


def transactions(rows: DataFrame) -> DataFrame:
    """One row for each cluster: trail_id, window_us, cluster, alarms in order, start and end."""
    alarm = F.struct("raised_us", "alarm_id", "alarm_type", "moid", "severity")
    return rows.where("cluster is not null").groupBy("trail_id", "window_us", "cluster").agg(F.array_sort(F.collect_list(alarm)).alias("alarms"), F.min("raised_us").alias("start_us"), F.max("raised_us").alias("end_us"), F.count("*").alias("n_alarms"))


def chatter(alarms: DataFrame) -> DataFrame:
    """Occurrences of each object, type and trail, with the first and the last."""
    return alarms.withColumn("trail_id", F.explode("trail_ids")).groupBy("moid", "alarm_type", "trail_id").agg(F.count("*").alias("occurrences"), F.min("raised_us").alias("first_us"), F.max("raised_us").alias("last_us"))


def promoted(observed: DataFrame, listed: DataFrame) -> DataFrame:
    """observed with status: 'suppressed' if listed (null-safe object and type), else 'observed'."""
    known = listed.select(F.col("moid").alias("_m"), F.col("alarm_type").alias("_t"), F.lit(True).alias("_known"))
    joined = observed.join(known, F.col("moid").eqNullSafe(F.col("_m")) & (F.col("alarm_type") == F.col("_t")), "left")
    return joined.withColumn("status", F.when(F.col("_known"), "suppressed").otherwise("observed")).drop("_m", "_t", "_known")


def filter_noise(alarms: DataFrame, window_us: int = WINDOW_US, eps_us: int = EPS_US, fewest: int = FEWEST) -> DataFrame:
    """Alarms to clustered rows: fan-out, windows, density."""
    return clustered(windowed(alarms, window_us), eps_us, fewest)


def with_snapshot(transactions: DataFrame, trails: DataFrame) -> DataFrame:
    """transactions with the snapshot that their trail (trail_id, snapshot) comes from; null where it isn't known."""
    return transactions.join(trails.select("trail_id", "snapshot"), "trail_id", "left")
