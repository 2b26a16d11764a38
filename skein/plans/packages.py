"""Work packages: counts, the pipeline, journeys."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, count_if, micros, ms_between, one_of
from ..operators.joins import latest_per_key
from ..operators.ranks import nearest_ranks
from ..sources.links import linked
from ..sources.payload import accumulate_costs, parsed, telemetry
from .constants import BATCH_STAGES, BATCH_STATUS, DETAILED_RANK, DETAILED_STAGES, DETAILED_STATUS, FAILURES_BATCH, ON_CHAIN, STAGE_RANK, STAGES, SUPERSEDED
from .registry import query

#: Microseconds that no two stages of a package lie apart.
CENTURY = 100 * 366 * 86_400_000_000

# fixed values
_PIVOT = {"submissions": 90, "being_shared": 91, "failed": 92, "duplicates": 93, "received": 94, "refined": 101, "work_reports_built": 102, "guarantees_built": 105}


@query(
    "q09_workpackage_stats",
    """SELECT count(*) FILTER (event_type = 90) AS submissions, count(*) FILTER (event_type = 91) AS being_shared, count(*) FILTER (event_type = 92) AS failed, count(*) FILTER (event_type = 93) AS duplicates,
  count(*) FILTER (event_type = 94) AS received, count(*) FILTER (event_type = 101) AS refined, count(*) FILTER (event_type = 102) AS work_reports_built, count(*) FILTER (event_type = 105) AS guarantees_built
FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY""",
)
def workpackage_stats(t, minutes: int = 7 * 1440):
    return t.last(minutes).where(one_of("event_type", _PIVOT.values())).agg(*(count_if(F.col("event_type") == i).alias(n) for n, i in _PIVOT.items()))


@query("q09_workpackages_by_core", "SELECT core, count(*) AS packages FROM ev, a WHERE event_type = 94 AND timestamp > t - INTERVAL 7 DAY GROUP BY core")
def workpackages_by_core(t, minutes: int = 7 * 1440):
    return t.last(minutes).where("event_type = 94").groupBy("core").agg(F.count(F.lit(1)).alias("packages"))


@query("q09_recent_workpackages", "SELECT timestamp, node_id, event_id, core, gas AS work_package_size FROM ev WHERE event_type = 94 ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def recent_workpackages(t, limit: int = 100):
    return t.events.where("event_type = 94").select("timestamp", "node_id", "event_id", "core", F.col("gas").alias("work_package_size")).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


#: the stages whose first time the pipeline tells, by event
_TIMED = {94: "received", 95: "authorized", 101: "refined", 102: "report_built", 105: "guarantee_built", 109: "distributed"}
#: From the least to the most telling one: of the stages that a package has reached, the last of these is its current one.
_LADDER = ("submitted", "received", "authorized", "refined", "report_built", "guarantee_built", "distributed", "failed", "guarantee_received", "discarded", "included", "available")


def pipeline(t) -> DataFrame:
    """One row a package: first time of each stage, chain and availability, current stage, elapsed time."""
    first = lambda *cond: F.min(F.when(cond[0], F.col("timestamp")))
    kind = lambda i: F.col("event_type") == i
    superseded = kind(92) & (F.col("reason") == SUPERSEDED)
    lines = t.packages.groupBy("package").agg(
        F.min("node_id").alias("node_id"),
        F.coalesce(F.max(F.when(kind(94), F.col("core"))), F.max("core")).alias("core"),
        F.coalesce(F.min("submitted"), F.min("timestamp")).alias("submitted_at"),
        *(first(kind(i)).alias(f"{name}_at") for i, name in _TIMED.items()),
        first(kind(92) & ~superseded).alias("failed_at"),
        count_if(superseded).alias("superseded_count"),
        F.max("timestamp").alias("last_event"),
    )
    chain = t.chain.groupBy("package").agg(
        first(kind(112)).alias("guarantee_received_at"),
        first(kind(113) & (F.col("reason") == ON_CHAIN)).alias("included_at"),
        first(kind(113) & (F.col("reason") != ON_CHAIN)).alias("discarded_at"),
    )
    available = t.shards.groupBy("package").agg(F.min("timestamp").alias("available_at"))
    joined = lines.join(chain, "package", "left").join(available, "package", "left")
    has = lambda c: F.col(f"{c}_at").isNotNull()
    holds = {"submitted": F.lit(True), "available": has("included") & has("available")}
    reached = F.array_compact(F.array(*(F.when(holds.get(name, has(name)), F.lit(name)) for name in _LADDER)))
    furthest = F.element_at(reached, -1)
    # another guarantor was quicker: told only of packages that got no further than their authorization here
    stage = F.when((F.col("superseded_count") > 0) & furthest.isin("submitted", "received", "authorized"), "superseded").otherwise(furthest)
    last = F.greatest("last_event", "guarantee_received_at", "included_at", "discarded_at", F.when(stage == "available", F.col("available_at")))
    return joined.withColumn("current_stage", stage).withColumn("elapsed_ms", ms_between(last, F.coalesce("submitted_at", "last_event")))


_PIPELINE = f""", pl0 AS (
  SELECT package, min(node_id) AS node_id, coalesce(max(core) FILTER (event_type = 94), max(core)) AS core, coalesce(min(submitted), min(timestamp)) AS submitted_at,
    min(timestamp) FILTER (event_type = 94) AS received_at, min(timestamp) FILTER (event_type = 95) AS authorized_at, min(timestamp) FILTER (event_type = 101) AS refined_at,
    min(timestamp) FILTER (event_type = 102) AS report_built_at, min(timestamp) FILTER (event_type = 105) AS guarantee_built_at, min(timestamp) FILTER (event_type = 109) AS distributed_at,
    min(timestamp) FILTER (event_type = 92 AND reason <> '{SUPERSEDED}') AS failed_at, count(*) FILTER (event_type = 92 AND reason = '{SUPERSEDED}') AS superseded_count, max(timestamp) AS last_event
  FROM pk GROUP BY package
), ch AS (
  SELECT package, min(timestamp) FILTER (event_type = 112) AS guarantee_received_at, min(timestamp) FILTER (event_type = 113 AND reason = '{ON_CHAIN}') AS included_at,
    min(timestamp) FILTER (event_type = 113 AND reason <> '{ON_CHAIN}') AS discarded_at FROM chain GROUP BY package
), av AS (
  SELECT package, min(timestamp) AS available_at FROM shards GROUP BY package
), pl1 AS (
  SELECT pl0.*, guarantee_received_at, included_at, discarded_at, available_at FROM pl0 LEFT JOIN ch USING (package) LEFT JOIN av USING (package)
), pl2 AS (
  SELECT *, CASE WHEN superseded_count > 0 AND step < 3 THEN 'superseded'
    ELSE (['submitted', 'received', 'authorized', 'refined', 'report_built', 'guarantee_built', 'distributed', 'failed', 'guarantee_received', 'discarded', 'included', 'available'])[step + 1] END AS current_stage
  FROM (SELECT *, greatest(0, if(received_at IS NULL, 0, 1), if(authorized_at IS NULL, 0, 2), if(refined_at IS NULL, 0, 3), if(report_built_at IS NULL, 0, 4), if(guarantee_built_at IS NULL, 0, 5),
    if(distributed_at IS NULL, 0, 6), if(failed_at IS NULL, 0, 7), if(guarantee_received_at IS NULL, 0, 8), if(discarded_at IS NULL, 0, 9), if(included_at IS NULL, 0, if(available_at IS NULL, 10, 11))) AS step FROM pl1)
), pl AS (
  SELECT *, (epoch_us(greatest(last_event, guarantee_received_at, included_at, discarded_at, CASE WHEN current_stage = 'available' THEN available_at END)) - epoch_us(coalesce(submitted_at, last_event))) / 1000.0 AS elapsed_ms FROM pl2
)"""


# the pipeline over a trailing window
_RECENT = """, wk AS (SELECT pk.* FROM pk, pa WHERE timestamp > t - INTERVAL 365 DAY AND timestamp <= t), wc AS (SELECT chain.* FROM chain, pa WHERE timestamp > t - INTERVAL 365 DAY), ws AS (SELECT shards.* FROM shards, pa WHERE timestamp > t - INTERVAL 365 DAY)
""" + _PIPELINE.replace("FROM pk ", "FROM wk ").replace("FROM chain ", "FROM wc ").replace("FROM shards ", "FROM ws ")


@query("q15_active_workpackages", _RECENT + " SELECT package, node_id, core, current_stage, submitted_at, last_event, elapsed_ms FROM pl ORDER BY submitted_at DESC, package DESC LIMIT 200")
def active_workpackages(t, minutes: int = 365 * 1440, limit: int = 200):
    """The newest packages of a trailing window; its bound is put to the events before they are grouped."""
    return pipeline(t.recent_packages(minutes)).select("package", "node_id", "core", "current_stage", "submitted_at", "last_event", "elapsed_ms").orderBy(F.desc("submitted_at"), F.desc("package")).limit(limit)


@query("q15_stage_summary", _PIPELINE + " SELECT current_stage, count(*) AS packages, min(elapsed_ms) AS least_ms, max(elapsed_ms) AS most_ms FROM pl GROUP BY 1")
def stage_summary(t):
    return pipeline(t).groupBy("current_stage").agg(F.count(F.lit(1)).alias("packages"), F.min("elapsed_ms").alias("least_ms"), F.max("elapsed_ms").alias("most_ms"))


_REACHED = ("received", "authorized", "refined", "report_built", "guarantee_built", "distributed", "guarantee_received", "included", "available", "failed")


@query("q15_stages_reached", _PIPELINE + " SELECT count(*) AS packages, " + ", ".join(f"count({s}_at) AS {s}" for s in _REACHED) + " FROM pl")
def stages_reached(t):
    return pipeline(t).agg(F.count(F.lit(1)).alias("packages"), *(F.count(f"{s}_at").alias(s) for s in _REACHED))


_STEPS = [("received", "authorized"), ("authorized", "refined"), ("refined", "report_built"), ("report_built", "guarantee_built"), ("guarantee_built", "distributed")]


@query(
    "q15_stage_durations",
    _PIPELINE
    + ", du AS ("
    + " UNION ALL ".join(f"SELECT '{a}_to_{b}' AS step, (epoch_us({b}_at) - epoch_us({a}_at)) / 1000.0 AS ms FROM pl WHERE {a}_at IS NOT NULL AND {b}_at IS NOT NULL" for a, b in _STEPS)
    + "), rk AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY step) AS n FROM du) "
    + "SELECT step, max(n) AS samples, max(ms) FILTER (i = CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)) AS p50_ms, max(ms) FILTER (i = CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT)) AS p95_ms FROM rk GROUP BY step",
)
def stage_durations(t):
    """Nearest-rank percentiles of the times between stages, which may be negative; rank selection, for up to a century."""
    steps = F.array(*(F.struct(F.lit(f"{a}_to_{b}").alias("step"), (micros(F.col(f"{b}_at")) - micros(F.col(f"{a}_at"))).alias("us")) for a, b in _STEPS))
    times = pipeline(t).select(F.explode(steps).alias("d")).select("d.step", "d.us")
    return nearest_ranks(times, "us", {"p50_ms": 0.5, "p95_ms": 0.95}, CENTURY, ["step"], scale=1000.0, low=-CENTURY)


@query("q15_failure_breakdown", "SELECT reason, count(*) AS failures, count(DISTINCT package) AS packages FROM pk WHERE event_type = 92 GROUP BY reason")
def failure_breakdown(t):
    return t.packages.where("event_type = 92").groupBy("reason").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("package").alias("packages"))


# what the bodies of received events tell: packages that were received somewhere, chain and shards of those with a built report
_LINKED_EVENTS = """, lk AS (
  SELECT printf('01%046x%016x', 0, package) AS package, node_id, event_type, timestamp, CASE WHEN event_type = 94 THEN core END AS core, CASE WHEN event_type = 94 THEN timestamp END AS submitted, reason FROM pk SEMI JOIN (SELECT package FROM pk WHERE event_type = 94) USING (package)
), rp AS (SELECT DISTINCT package FROM pk WHERE event_type = 102
), lc AS (SELECT printf('01%046x%016x', 0, package) AS package, event_type, reason, timestamp FROM chain SEMI JOIN rp USING (package)
), rq AS (SELECT DISTINCT package FROM shards SEMI JOIN rp USING (package) WHERE event_type = 124
)"""
_LINKED = _LINKED_EVENTS + """, ls AS (SELECT printf('01%046x%016x', 0, package) AS package, timestamp FROM (SELECT package, timestamp FROM shards SEMI JOIN rp USING (package) WHERE event_type <> 125
  UNION ALL SELECT package, timestamp FROM shards SEMI JOIN rq USING (package) WHERE event_type = 125)
)""" + _PIPELINE.replace("FROM pk ", "FROM lk ").replace("FROM chain ", "FROM lc ").replace("FROM shards ", "FROM ls ")


@query("q15_linked_workpackages", _LINKED + " SELECT package, node_id, core, current_stage, submitted_at, last_event, elapsed_ms, superseded_count FROM pl")
def linked_workpackages(t):
    """The pipeline of all packages of received events, from the bodies: by share id, report hash, erasure root and request."""
    return pipeline(telemetry(parsed(t.payloads), t)).select("package", "node_id", "core", "current_stage", "submitted_at", "last_event", "elapsed_ms", "superseded_count")


_HASHES = tuple(f"01{0:046x}{n:016x}" for n in (1, 3, 7, 32, 33, 34, 35))


@query(
    "q14_workpackages_by_hash",
    "SELECT timestamp, node_id, printf('01%046x%016x', 0, package) AS hash, gas AS work_package_size FROM pk WHERE event_type = 94 AND package IN (1, 3, 7, 32, 33, 34, 35)",
)
def workpackages_by_hash(t, hashes=_HASHES):
    """Received packages with one of the hashes, by the typed column of the bodies."""
    found = linked(t.payloads.where("event_type = 94"), "hash", "package_size").where(F.col("hash").isin(*hashes))
    return found.select("timestamp", "node_id", "hash", F.col("package_size").alias("work_package_size"))


@query(
    "q14_journeys_by_hash",
    _LINKED_EVENTS
    + """, w AS (SELECT printf('01%046x%016x', 0, package) AS package FROM pk WHERE event_type = 94 AND package IN (1, 3, 7, 32, 33, 34, 35)),
je AS (SELECT package, timestamp, event_type, node_id, core, reason FROM lk UNION ALL SELECT package, timestamp, event_type, NULL, NULL, reason FROM lc
  UNION ALL SELECT printf('01%046x%016x', 0, package), timestamp, event_type, node_id, NULL, NULL FROM shards SEMI JOIN rp USING (package) WHERE event_type <> 125
  UNION ALL SELECT printf('01%046x%016x', 0, package), timestamp, event_type, node_id, NULL, NULL FROM shards SEMI JOIN rq USING (package) WHERE event_type = 125)
SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY timestamp, event_type, coalesce(node_id, '')) AS INTEGER) AS step, timestamp, event_type, node_id FROM je SEMI JOIN w USING (package)""",
)
def journeys_by_hash(t, hashes=_HASHES):
    """From hashes to the steps of their packages, on chain and shard transfers included, in one plan: the share ids of the
    packages found are met with the events that carry ids, never the other way round."""
    stored = parsed(t.payloads)
    wanted = stored.where((F.col("event_type") == 94) & F.col("hash").isin(*hashes)).select(F.col("hash").alias("package")).distinct()
    events = package_events(telemetry(stored, t, hashes)).join(F.broadcast(wanted), "package", "left_semi")  # as many as were asked for
    order = Window.partitionBy("package").orderBy("timestamp", "event_type", F.coalesce("node_id", F.lit("")))
    return events.select("package", F.row_number().over(order).alias("step"), "timestamp", "event_type", "node_id")


def _named(column, names: dict, other: str | None = None):
    """The name of a value by a fixed table."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    found = F.create_map(*pairs)[column]
    return found if other is None else F.coalesce(found, F.lit(other))


def stage_name(event_type, reason, names: dict = STAGES):
    told = F.when((event_type == 92) & (reason == SUPERSEDED), "superseded").when((event_type == 113) & (reason == ON_CHAIN), "included")
    return told.otherwise(_named(event_type, names, "unknown"))


def stage_rank(stage, ranks: dict = STAGE_RANK):
    """How far a stage is; any that the table does not name is the least."""
    return F.coalesce(_named(stage, ranks), F.lit(-3))


def package_events(t) -> DataFrame:
    """All events of packages: the pipeline's own, those on chain and the transfers of shards."""
    none = lambda kind: F.lit(None).cast(kind)
    own = t.packages.select("package", "timestamp", "event_type", "node_id", "core", "reason", "part", "gas")
    chain = t.chain.select("package", "timestamp", "event_type", none("string").alias("node_id"), none("int").alias("core"), "reason", none("bigint").alias("part"), none("bigint").alias("gas"))
    moved = t.shards.select("package", "timestamp", "event_type", "node_id", none("int").alias("core"), none("string").alias("reason"), none("bigint").alias("part"), none("bigint").alias("gas"))
    return own.unionByName(chain).unionByName(moved)


def chosen(events: DataFrame, packages: DataFrame | list | None) -> DataFrame:
    """Events of the packages asked for: a table of them (semi-join), a list of ids, or all (None)."""
    if packages is None:
        return events
    if isinstance(packages, DataFrame):
        return events.join(packages.select("package").distinct(), "package", "left_semi")
    return events.where(F.col("package").isin(*packages))


def _in_order():
    return Window.partitionBy("package").orderBy("timestamp", "event_type", F.coalesce("node_id", F.lit("")), F.coalesce("part", F.lit(0)), F.coalesce("gas", F.lit(0)))


def journeys(t, packages: DataFrame | list | None = None) -> DataFrame:
    """The steps of packages in time order."""
    own = chosen(package_events(t), packages)
    return own.withColumns({"step": F.row_number().over(_in_order()), "stage": stage_name(F.col("event_type"), F.col("reason"))})


_STEPS_SQL = """, pe AS (SELECT package, timestamp, event_type, node_id, core, reason, part, gas FROM pk UNION ALL SELECT package, timestamp, event_type, NULL, NULL, reason, NULL, NULL FROM chain
  UNION ALL SELECT package, timestamp, event_type, node_id, NULL, NULL, NULL, NULL FROM shards),
j AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS step, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000.0 AS duration_ms
  FROM pe WINDOW w AS (PARTITION BY package ORDER BY timestamp, event_type, coalesce(node_id, ''), coalesce(part, 0), coalesce(gas, 0)))"""
_STAGE_SQL = """CASE WHEN event_type = 92 AND reason = 'work package was refined by another guarantor' THEN 'superseded' WHEN event_type = 113 AND reason = 'PackageReportedOnChain' THEN 'included'
  ELSE CASE event_type WHEN 92 THEN 'failed' WHEN 94 THEN 'received' WHEN 95 THEN 'authorized' WHEN 101 THEN 'refined' WHEN 102 THEN 'report_built' WHEN 105 THEN 'guarantee_built' WHEN 109 THEN 'guarantees_distributed'
    WHEN 112 THEN 'guarantee_received' WHEN 113 THEN 'discarded' WHEN 120 THEN 'shard_requested' WHEN 124 THEN 'shard_received' WHEN 125 THEN 'shards_transferred' END END"""


@query("q14_workpackage_journey", _STEPS_SQL + f" SELECT package, step, timestamp, node_id, event_type, {_STAGE_SQL} AS stage FROM j")
def workpackage_journey(t, packages: DataFrame | list | None = None):
    return journeys(t, packages).select("package", "step", "timestamp", "node_id", "event_type", "stage")


@query(
    "q14_journey_outcomes",
    _STEPS_SQL
    + f""", n AS (SELECT *, {_STAGE_SQL} AS stage FROM j), r AS (SELECT *, CASE stage WHEN 'received' THEN 2 WHEN 'authorized' THEN 4 WHEN 'refined' THEN 5 WHEN 'report_built' THEN 6 WHEN 'guarantee_built' THEN 7
  WHEN 'guarantees_distributed' THEN 8 WHEN 'guarantee_received' THEN 9 WHEN 'included' THEN 10 WHEN 'shard_requested' THEN 11 WHEN 'shard_received' THEN 11 WHEN 'shards_transferred' THEN 11 WHEN 'failed' THEN -1 WHEN 'superseded' THEN -2 ELSE -3 END AS rank FROM n),
o AS (SELECT package, max(step) AS steps, arg_max(stage, (rank, step)) AS current_stage, bool_or(stage IN ('failed', 'duplicate', 'discarded')) AS failed, bool_or(stage = 'superseded') AS s,
  bool_or(stage IN ('refined', 'report_built', 'guarantee_built', 'guarantees_distributed', 'guarantee_received', 'included', 'shard_received')) AS p,
  arg_min(reason, step) FILTER (stage = 'failed') AS failure_reason, arg_min(core, step) FILTER (stage = 'received') AS core FROM r GROUP BY package)
SELECT package, steps, current_stage, failed, s AND NOT p AND NOT failed AS superseded, failure_reason, core FROM o""",
)
def journey_outcomes(t, packages: DataFrame | list | None = None):
    """What became of each package: the furthest stage (not the latest), and whether it failed or was superseded without progress."""
    stage = F.col("stage")
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("step")))
    rows = journeys(t, packages).groupBy("package").agg(
        F.max("step").alias("steps"),
        F.max_by("stage", F.struct(stage_rank(stage), "step")).alias("current_stage"),
        F.bool_or(stage.isin("failed", "duplicate", "discarded")).alias("failed"),
        F.bool_or(stage == "superseded").alias("_superseded"),
        F.bool_or(stage.isin("refined", "report_built", "guarantee_built", "guarantees_distributed", "guarantee_received", "included", "shard_received")).alias("_progress"),
        first(F.col("reason"), stage == "failed").alias("failure_reason"),
        first(F.col("core"), stage == "received").alias("core"),
    )
    return rows.select("package", "steps", "current_stage", "failed", (F.col("_superseded") & ~F.col("_progress") & ~F.col("failed")).alias("superseded"), "failure_reason", "core")


# what follows on chain and in transfers; such steps have no duration
_LATER = (112, 113, 120, 124, 125)
_DETAILED_SQL = """CASE WHEN event_type = 92 AND reason = 'work package was refined by another guarantor' THEN 'superseded' WHEN event_type = 113 AND reason = 'PackageReportedOnChain' THEN 'included'
    ELSE CASE event_type WHEN 92 THEN 'failed' WHEN 94 THEN 'received' WHEN 95 THEN 'authorized' WHEN 101 THEN 'refined' WHEN 102 THEN 'report_built' WHEN 105 THEN 'guarantee_built' WHEN 109 THEN 'guaranteed'
      WHEN 112 THEN 'guarantee_received' WHEN 113 THEN 'discarded' WHEN 120 THEN 'shard_requested' WHEN 124 THEN 'shard_received' WHEN 125 THEN 'shards_transferred' END END"""
_TIMED_SQL = """, jt AS (SELECT * EXCLUDE (duration_ms), CASE WHEN event_type NOT IN (112, 113, 120, 124, 125) THEN (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000.0 END AS duration_ms
  FROM j WINDOW w AS (PARTITION BY package, event_type IN (112, 113, 120, 124, 125) ORDER BY step))"""


@query(
    "q27_workpackage_journey_enhanced",
    _STEPS_SQL
    + _TIMED_SQL
    + f""", nc AS (SELECT node_id, arg_max(core, (timestamp, package)) AS core FROM pk WHERE event_type = 94 GROUP BY 1),
c AS (SELECT package, arg_min(core, step) FILTER (event_type = 94) AS core, min(node_id) AS node FROM j GROUP BY package)
SELECT j.package, step, timestamp, j.node_id, event_type, {_DETAILED_SQL} AS stage,
  CASE WHEN event_type = 92 AND reason = 'work package was refined by another guarantor' THEN 'superseded' WHEN event_type = 92 OR event_type = 113 AND reason <> 'PackageReportedOnChain' THEN 'failed' ELSE 'completed' END AS status,
  coalesce(c.core, nc.core) AS core, CASE WHEN event_type IN (92, 99, 113) AND NOT (event_type = 113 AND reason = 'PackageReportedOnChain') THEN reason END AS error, duration_ms
FROM jt j JOIN c USING (package) LEFT JOIN nc ON nc.node_id = c.node""",
)
def workpackage_journey_enhanced(t, packages: DataFrame | list | None = None):
    """The detailed journey: status, error and time since the step before; a package without a core of its own has that which its first node last received for."""
    kind, reason = F.col("event_type"), F.col("reason")
    on_chain = (kind == 113) & (reason == ON_CHAIN)
    whole = Window.partitionBy("package")
    received = F.when(kind == 94, F.struct("step", "core"))
    steps = journeys(t, packages).withColumns({
        "duration_ms": F.when(~one_of("event_type", _LATER), ms_between(F.col("timestamp"), F.lag("timestamp").over(Window.partitionBy("package", one_of("event_type", _LATER)).orderBy("step")))),
        "_core": F.min(received).over(whole)["core"],
    })
    newest = latest_per_key(t.packages.where("event_type = 94"), ["node_id"], [F.col("timestamp"), F.col("package")], ["core"])
    # only packages without a core go to their node's, a row each; the steps stay where they are by package
    bare = chosen(package_events(t), packages).groupBy("package").agg(F.min("node_id").alias("node_id"), F.min(F.when(kind == 94, F.col("core").isNotNull())).alias("_has")).where("NOT coalesce(_has, false)")
    cores = bare.join(newest, "node_id").select("package", F.col("core").alias("_node_core"))
    joined = steps.join(cores, "package", "left")
    stage = stage_name(kind, reason, DETAILED_STAGES)
    status = F.when(stage == "superseded", "superseded").when(one_of("event_type", DETAILED_STATUS["failed"]) | (kind == 113) & ~on_chain, "failed").when(one_of("event_type", DETAILED_STATUS["in_progress"]), "in_progress")
    return joined.select(
        "package",
        "step",
        "timestamp",
        "node_id",
        "event_type",
        stage.alias("stage"),
        status.otherwise("completed").alias("status"),
        F.coalesce("_core", "_node_core").alias("core"),
        F.when(kind.isin(92, 99, 113) & ~on_chain, reason).alias("error"),
        "duration_ms",
    )


@query(
    "q27_journey_timing",
    _STEPS_SQL
    + _TIMED_SQL
    + f""", n AS (SELECT *, {_DETAILED_SQL} AS stage, event_type = 92 AND reason <> 'work package was refined by another guarantor' OR event_type = 113 AND reason <> 'PackageReportedOnChain' AS bad FROM jt),
g AS (SELECT *, CASE stage {" ".join(f"WHEN '{name}' THEN {rank}" for name, rank in DETAILED_RANK.items())} ELSE -3 END AS rank FROM n),
k AS (SELECT package, stage, arg_max(duration_ms, step) AS ms FROM n WHERE duration_ms IS NOT NULL GROUP BY 1, 2),
m AS (SELECT package, string_agg(stage || '=' || CAST(CAST(round(ms) AS BIGINT) AS VARCHAR), ',' ORDER BY stage) AS stage_durations FROM k GROUP BY 1),
o AS (SELECT package, max(step) AS steps, min(timestamp) AS started_at, max(timestamp) AS completed_at, arg_max(stage, (rank, step)) AS current_stage, sum(duration_ms) AS total_duration_ms,
  arg_min(stage, step) FILTER (bad) AS error_stage, arg_min(reason, step) FILTER (bad) AS failure_reason, count(*) FILTER (bad) AS errors, count(*) FILTER (event_type = 105) AS guarantors FROM g GROUP BY 1)
SELECT package, steps, started_at, completed_at, current_stage, CASE WHEN steps >= 2 THEN coalesce(total_duration_ms, 0) END AS total_duration_ms, coalesce(stage_durations, '') AS stage_durations, error_stage, failure_reason, errors, guarantors FROM o LEFT JOIN m USING (package)""",
)
def journey_timing(t, packages: DataFrame | list | None = None):
    """A row a package: when it began and ended, the time by stage (the last of a stage's name; none for what follows on chain
    and in transfers) and in all, the first error with the stage it struck, and the number of errors and guarantors."""
    steps = workpackage_journey_enhanced(t, packages)
    timed, bad = F.col("duration_ms"), F.col("status") == "failed"
    first = lambda name: F.min_by(F.when(bad, F.col(name)), F.when(bad, F.col("step")))
    by_stage = steps.where(timed.isNotNull()).groupBy("package", "stage").agg(F.max_by("duration_ms", "step").alias("ms"))
    pair = F.concat_ws("=", "stage", F.round("ms").cast("bigint").cast("string"))
    durations = by_stage.groupBy("package").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", pair.alias("p")))), lambda x: x["p"]), ",").alias("stage_durations"))  # as many as there are stages
    rows = steps.groupBy("package").agg(
        F.max("step").alias("steps"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("completed_at"),
        F.max_by("stage", F.struct(stage_rank(F.col("stage"), DETAILED_RANK), "step")).alias("current_stage"),
        F.coalesce(F.sum(timed), F.lit(0.0)).alias("_total"),
        first("stage").alias("error_stage"),
        first("error").alias("failure_reason"),
        F.count_if(bad).alias("errors"),
        F.count_if(F.col("event_type") == 105).alias("guarantors"),
    )
    joined = rows.join(durations, "package", "left")
    return joined.select("package", "steps", "started_at", "completed_at", "current_stage", F.when(F.col("steps") >= 2, F.col("_total")).alias("total_duration_ms"), F.coalesce("stage_durations", F.lit("")).alias("stage_durations"), "error_stage", "failure_reason", "errors", "guarantors")


@query(
    "q52_batch_journeys",
    _STEPS_SQL
    + """, b AS (SELECT *, CASE event_type WHEN 92 THEN 'failed' WHEN 94 THEN 'received' WHEN 95 THEN 'authorized' WHEN 101 THEN 'refined' WHEN 102 THEN 'report_built' WHEN 105 THEN 'guarantee_built' ELSE 'other' END AS stage,
  CASE WHEN event_type IN (92, 93, 99, 112, 113) THEN 'failed' ELSE 'completed' END AS status FROM j WHERE event_type BETWEEN 90 AND 113)
SELECT package, count(*) AS stage_count, string_agg(stage || ':' || status, '>' ORDER BY step) AS stages, bool_or(event_type IN (92, 93, 99, 112, 113)) AS has_errors, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(DISTINCT node_id) AS nodes_involved, arg_max(stage, step) AS current_stage FROM b GROUP BY package""",
)
def batch_journeys(t, packages: DataFrame | list | None = None):
    """The journeys of many packages at once, a row a package: stages with their status in order, errors, and the latest stage."""
    kind = F.col("event_type")

    def told(event_type):
        status = F.lit("completed")
        for name, ids in BATCH_STATUS.items():
            status = F.when(event_type.isin(*ids), name).otherwise(status)
        return F.concat_ws(":", _named(event_type, BATCH_STAGES, "other"), status)

    # the pipeline's events lie by package already; the others are few and join them as a row a package
    def by_package(events: DataFrame, name: str) -> DataFrame:
        own = chosen(events, packages).where(kind.between(90, 113)).groupBy("package")
        return own.agg(F.collect_list(F.struct("timestamp", "event_type")).alias(f"_{name}"), F.collect_set("node_id").alias(f"_{name}_nodes"))

    others = t.chain.select("package", "timestamp", "event_type", F.lit(None).cast("string").alias("node_id")).unionByName(t.shards.select("package", "timestamp", "event_type", "node_id"))
    rows = by_package(t.packages, "own").join(by_package(others, "other"), "package", "full")
    both = lambda kept, a, b: F.concat(F.coalesce(F.col(a), kept), F.coalesce(F.col(b), kept))
    # stage and status follow from the type, so the order among equal times and types does not matter
    steps = F.array_sort(both(F.array().cast("array<struct<timestamp:timestamp_ntz,event_type:int>>"), "_own", "_other"))
    rows = rows.select("package", steps.alias("_steps"), F.array_distinct(both(F.array().cast("array<string>"), "_own_nodes", "_other_nodes")).alias("_nodes"))
    last = F.element_at("_steps", -1)
    return rows.select(
        "package",
        F.size("_steps").cast("long").alias("stage_count"),
        F.array_join(F.transform("_steps", lambda s: told(s["event_type"])), ">").alias("stages"),
        F.exists("_steps", lambda s: s["event_type"].isin(*FAILURES_BATCH)).alias("has_errors"),
        F.array_min(F.transform("_steps", lambda s: s["timestamp"])).alias("first_seen"),
        F.array_max(F.transform("_steps", lambda s: s["timestamp"])).alias("last_seen"),
        F.size("_nodes").cast("long").alias("nodes_involved"),
        _named(last["event_type"], BATCH_STAGES, "other").alias("current_stage"),
    )


@query(
    "q46_audit_progress",
    """, n AS (SELECT package, count(*) AS events, count(*) FILTER (event_type = 105) AS guarantees_built, count(*) FILTER (event_type = 106) AS guarantees_signed, count(*) FILTER (event_type = 107) AS guarantees_shared,
  count(*) FILTER (event_type = 108) > 0 AS is_accumulated, count(*) FILTER (event_type IN (109, 110)) > 0 AS is_failed, count(DISTINCT node_id) FILTER (event_type = 106) AS auditors,
  coalesce(arg_min(tranche, (timestamp, node_id, event_type)) FILTER (tranche IS NOT NULL), 0) AS tranche FROM audits GROUP BY package)
SELECT package, tranche, guarantees_built, guarantees_signed, guarantees_shared, auditors, is_accumulated, is_failed, is_failed AND events > 5 AS panic_mode,
  CASE WHEN is_accumulated THEN 'completed' WHEN is_failed THEN 'failed' WHEN guarantees_shared > 0 THEN 'sharing' WHEN guarantees_signed > 0 THEN 'signing' WHEN guarantees_built > 0 THEN 'building' ELSE 'pending' END AS status FROM n""",
)
def audit_progress(t, packages: DataFrame | list | None = None):
    """How far the audit of each package is, from its events between the building and the discarding of guarantees."""
    many = lambda *ids: count_if(one_of("event_type", ids))
    told = F.col("tranche").isNotNull()
    rows = chosen(t.audits, packages).groupBy("package").agg(
        F.count(F.lit(1)).alias("events"),
        many(105).alias("guarantees_built"),
        many(106).alias("guarantees_signed"),
        many(107).alias("guarantees_shared"),
        (many(108) > 0).alias("is_accumulated"),
        (many(109, 110) > 0).alias("is_failed"),
        F.count_distinct(F.when(F.col("event_type") == 106, F.col("node_id"))).alias("auditors"),
        F.coalesce(F.min_by(F.when(told, F.col("tranche")), F.when(told, F.struct("timestamp", "node_id", "event_type"))), F.lit(0)).alias("tranche"),
    )
    status = F.when(F.col("is_accumulated"), "completed").when(F.col("is_failed"), "failed").when(F.col("guarantees_shared") > 0, "sharing").when(F.col("guarantees_signed") > 0, "signing").when(F.col("guarantees_built") > 0, "building")
    return rows.withColumn("status", status.otherwise("pending")).withColumn("panic_mode", F.col("is_failed") & (F.col("events") > 5)).drop("events")


_CORE_PACKAGES = """, rc AS (SELECT package, node_id, timestamp AS submitted_at FROM pk, pa WHERE event_type = 94 AND core = 3 AND timestamp > t - INTERVAL 720 DAY),
nx AS (SELECT package, timestamp, event_type, gas FROM pk, pa WHERE event_type IN (95, 101, 102, 105, 109, 92) AND timestamp > t - INTERVAL 720 DAY)"""


def _core_packages(t, core: int, minutes: int) -> DataFrame:
    """Packages received on a core in the window, each with its latest later stage, its last timely one and the gas of its refinement."""
    recent = t.last_packages(minutes)
    received = recent.where((F.col("event_type") == 94) & (F.col("core") == core)).select("package", "node_id", F.col("timestamp").alias("submitted_at"))
    stages = recent.where(one_of("event_type", (95, 101, 102, 105, 109, 92)))
    latest = stages.groupBy("package").agg(
        F.max(F.struct("timestamp", "event_type")).alias("_e"), F.max(F.when(F.col("event_type") != 92, F.col("timestamp"))).alias("end_time"), F.max(F.when(F.col("event_type") == 101, F.col("gas"))).alias("gas_used")
    )
    kind = F.coalesce(F.col("_e.event_type"), F.lit(94))
    return received.join(latest, "package", "left").withColumns({"event_type": kind, "last_update": F.coalesce("_e.timestamp", "submitted_at")}).drop("_e")


@query(
    "q29_core_work_packages",
    _CORE_PACKAGES
    + """ SELECT package, CASE event_type WHEN 94 THEN 'received' WHEN 95 THEN 'authorized' WHEN 101 THEN 'refined' WHEN 102 THEN 'report_built' WHEN 105 THEN 'guarantee_built' WHEN 109 THEN 'distributed' WHEN 92 THEN 'failed' END AS stage,
  event_type NOT IN (109, 92) AS is_active, last_update, submitted_at, node_id, gas_used, (epoch_us(last_update) - epoch_us(submitted_at)) / 1000.0 AS elapsed_ms
FROM (SELECT rc.*, coalesce(e.event_type, 94) AS event_type, coalesce(e.timestamp, submitted_at) AS last_update, (SELECT max(gas) FROM nx WHERE nx.package = rc.package AND event_type = 101) AS gas_used
  FROM rc LEFT JOIN LATERAL (SELECT event_type, timestamp FROM nx WHERE nx.package = rc.package ORDER BY timestamp DESC, event_type DESC LIMIT 1) e ON true) ORDER BY submitted_at DESC, package LIMIT 50""",
)
def core_work_packages(t, core: int = 3, minutes: int = 720 * 1440, limit: int = 50):
    kind, names = F.col("event_type"), {94: "received", 95: "authorized", 101: "refined", 102: "report_built", 105: "guarantee_built", 109: "distributed", 92: "failed"}
    rows = _core_packages(t, core, minutes).withColumn("elapsed_ms", ms_between(F.col("last_update"), F.col("submitted_at")))
    newest = rows.orderBy(F.desc("submitted_at"), "package").limit(limit)
    return newest.select("package", _named(kind, names, "processing").alias("stage"), (~kind.isin(109, 92)).alias("is_active"), "last_update", "submitted_at", "node_id", "gas_used", "elapsed_ms")


@query(
    "q29_core_processing",
    _CORE_PACKAGES
    + """, w AS (SELECT rc.package, submitted_at, max(timestamp) AS e FROM rc JOIN nx ON nx.package = rc.package AND event_type <> 92 GROUP BY 1, 2)
SELECT coalesce(round(avg((epoch_us(e) - epoch_us(submitted_at)) / 1000.0), 3), 0) AS avg_processing_ms, count(*) AS completed FROM w""",
)
def core_processing(t, core: int = 3, minutes: int = 720 * 1440):
    """Time from receipt to the last timely stage; a package that several nodes received at one moment counts once."""
    done = _core_packages(t, core, minutes).where("end_time IS NOT NULL").select("package", "submitted_at", "end_time").distinct()
    return done.agg(F.coalesce(F.round(F.avg(ms_between(F.col("end_time"), F.col("submitted_at"))), 3), F.lit(0.0)).alias("avg_processing_ms"), F.count(F.lit(1)).alias("completed"))


@query(
    "q18_accumulate_costs",
    """, x AS (SELECT gas, k, unnest(range(1, k % 3 + 2)) AS service FROM ev WHERE event_type = 47)
SELECT service, count(*) AS costs, CAST(sum(gas + service) AS BIGINT) AS total_gas, round(avg(gas + service), 4) AS avg_gas, round(avg(gas * service), 4) AS avg_time_ns FROM x GROUP BY service""",
)
def accumulation(t):
    """Gas and time by service of what executed blocks accumulated, from the pairs in their bodies."""
    rows = accumulate_costs(t.payloads)
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("costs"), F.sum("gas").alias("total_gas"), F.round(F.avg("gas"), 4).alias("avg_gas"), F.round(F.avg("elapsed_ns"), 4).alias("avg_time_ns"))


@query(
    "q18_execution_metrics",
    """SELECT event_type, count(*) AS costs, CAST(sum(gas) AS BIGINT) AS total_gas, round(avg(gas), 4) AS avg_gas, max(gas) AS max_gas FROM pk, pa
WHERE event_type IN (95, 101) AND timestamp > t - INTERVAL 720 DAY GROUP BY event_type""",
)
def execution_metrics(t, minutes: int = 720 * 1440):
    """Gas by kind; every cost item of a refinement is a row and counts."""
    own = t.last_packages(minutes).where(one_of("event_type", (95, 101)))
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("costs"), F.sum("gas").alias("total_gas"), F.round(F.avg("gas"), 4).alias("avg_gas"), F.max("gas").alias("max_gas"))


@query(
    "q18_recent_executions",
    """, x AS (SELECT timestamp, event_type, node_id, package, CASE event_type WHEN 95 THEN gas ELSE gas + 1 END AS gas_used, CASE event_type WHEN 95 THEN gas * 2 ELSE (gas + 1) * 2 END AS elapsed_ns FROM pk WHERE event_type IN (95, 101)
UNION ALL SELECT timestamp, event_type, node_id, NULL, NULL, NULL FROM ev WHERE event_type = 47)
SELECT timestamp, event_type, node_id, gas_used, elapsed_ns FROM x, pa WHERE timestamp > t - INTERVAL 720 DAY ORDER BY timestamp DESC, event_type, node_id, package LIMIT 100""",
)
def recent_executions(t, minutes: int = 720 * 1440, limit: int = 100):
    """The newest authorisations, refinements (their cost items summed) and executed blocks, with gas and time where the body tells them."""
    recent = F.col("timestamp") > at(t.packages_as_of - timedelta(minutes=minutes))
    own = linked(t.payloads.where(one_of("event_type", (95, 101, 47)) & recent), "gas", "elapsed_ns", "share")
    newest = own.orderBy(F.desc("timestamp"), "event_type", "node_id", F.col("share").cast("bigint")).limit(limit)
    cost = lambda name: F.when(F.col("event_type") != 47, F.col(name)).alias(name if name != "gas" else "gas_used")
    return newest.select("timestamp", "event_type", "node_id", cost("gas"), cost("elapsed_ns"))
