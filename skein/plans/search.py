"""Event search, slots, the enriched view and the live filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import checked
from ..functions.columns import at, one_of
from ..operators.joins import asof_forward
from ..operators.segments import numbered
from ..sources.adapter import event_types
from .constants import GROUPS, TIMELINE, TYPES
from .registry import query

_TYPE_ROWS = ", ".join(f"({i}, '{n}', '{next(g for g, (lo, hi) in GROUPS.items() if lo <= i <= hi)}')" for i, n in TYPES.items())


def category(event_type: Column) -> Column:
    """The timeline category of a type."""
    out = F.lit("other")
    for name, (low, high) in TIMELINE.items():
        out = F.when(event_type.between(low, high), name).otherwise(out)
    return out


@checked
def search(events: DataFrame, event_types: list[int] | None = None, node_id: str | None = None, core: int | None = None, start: datetime | None = None, end: datetime | None = None, limit: int = 100, offset: int = 0, after: tuple[datetime, int] | None = None) -> DataFrame:
    """Events by any of several criteria, newest first; a criterion that is None is not applied.

    ``after`` (timestamp, event_id) continues behind the last event of a page: its bound on the time is a filter of the
    scan, and what was told before is neither sorted again nor moved by events that arrive meanwhile.
    """
    if limit > 1000:
        raise ValueError("limit must be in 1..1000")
    found = events
    if event_types is not None:
        found = found.where(one_of("event_type", event_types))
    if node_id is not None:
        found = found.where(F.col("node_id") == node_id)
    if core is not None:
        found = found.where(F.col("core") == core)
    if start is not None:
        found = found.where(F.col("timestamp") >= at(start))
    if end is not None:
        found = found.where(F.col("timestamp") <= at(end))
    if after is not None:
        moment, number = at(after[0]), F.lit(after[1])
        found = found.where((F.col("timestamp") <= moment) & ((F.col("timestamp") < moment) | (F.col("event_id") < number)))
    newest = found.select("timestamp", "node_id", "event_id", "event_type", "core").orderBy(F.desc("timestamp"), F.desc("event_id"))
    return (newest.offset(offset) if offset else newest).limit(limit)


def pages(events: DataFrame, limit: int = 100, **criteria):
    """All pages of found events, each of at most ``limit`` rows, by continuation: the first begins at the newest event of its time."""
    after = None
    while True:
        rows = search(events, limit=limit, after=after, **criteria).collect()  # ``limit`` rows at most
        if rows:
            yield rows
        if len(rows) < limit:
            return
        after = rows[-1]["timestamp"], rows[-1]["event_id"]


def page(events: DataFrame, limit: int = 100, offset: int = 0, **criteria) -> tuple[list, bool]:
    """A page of found events and whether more may follow, which a full page says."""
    rows = search(events, limit=limit, offset=offset, **criteria).collect()  # ``limit`` rows at most
    return rows, len(rows) == limit


@query(
    "q49_search_events",
    """SELECT timestamp, node_id, event_id, event_type, core FROM ev WHERE event_type IN (94, 105, 42, 62, 11) AND core = 3
ORDER BY timestamp DESC, event_id DESC LIMIT 100 OFFSET 5""",
)
def search_events(t):
    return search(t.events, event_types=[94, 105, 42, 62, 11], core=3, limit=100, offset=5)


@query(
    "q49_next_page",
    """, c AS (SELECT timestamp, event_id FROM ev WHERE event_type IN (94, 105, 42, 62, 11) AND event_id <= (SELECT max(event_id) // 2 FROM ev) ORDER BY event_id DESC LIMIT 1)
SELECT ev.timestamp, node_id, ev.event_id, event_type, core FROM ev, c WHERE event_type IN (94, 105, 42, 62, 11) AND (ev.timestamp, ev.event_id) < (c.timestamp, c.event_id) ORDER BY ev.timestamp DESC, ev.event_id DESC LIMIT 20""",
)
def next_page(t):
    """The page behind an event in the middle of the table, by continuation."""
    middle = t.events.agg(F.expr("max(event_id) div 2")).first()[0]
    last = t.events.where(one_of("event_type", (94, 105, 42, 62, 11)) & (F.col("event_id") <= middle)).orderBy(F.desc("event_id")).select("timestamp", "event_id").first()
    return search(t.events, event_types=[94, 105, 42, 62, 11], limit=20, after=tuple(last))


_SLOT_TYPES = (11, 12, 40, 43, 62, 68)
_SLOTS = """, d AS (SELECT timestamp, created_at, node_id, event_id, event_type, slot FROM bd WHERE event_type IN (11, 12, 40, 43, 62, 68)),
o AS (SELECT timestamp, created_at, node_id, event_id, event_type FROM bd WHERE event_type IN (41, 42)),
l AS (SELECT o.*, d.slot FROM d ASOF JOIN o ON d.node_id = o.node_id AND d.created_at < o.created_at WHERE d.event_type = 40), s AS (SELECT * FROM d UNION ALL SELECT * FROM l)"""


def slotted(t, slots=None) -> DataFrame:
    """Events with the slot that they name, and for each authoring attempt (40) its outcome: the node's next authored or failed block."""
    columns = ["timestamp", "created_at", "node_id", "event_id", "event_type"]
    named = t.linked(_SLOT_TYPES, "slot").select(*columns, "slot").where(F.col("slot").isNotNull())
    if slots is not None:
        named = named.join(F.broadcast(slots), "slot", "left_semi")  # the slots asked for
    ends = t.bodies.where(one_of("event_type", (41, 42))).select("created_at", "node_id", "timestamp", "event_id", "event_type")
    ends = ends.withColumnsRenamed({"timestamp": "end_timestamp", "event_id": "end_id", "event_type": "end_type"}).withColumn("end_created", F.col("created_at"))
    taken = ["end_id", "end_timestamp", "end_type", "end_created"]
    outcomes = asof_forward(named.where("event_type = 40").select("node_id", "created_at", "slot"), ends, "node_id", "created_at", taken).where("end_id IS NOT NULL")
    linked = outcomes.select(F.col("end_timestamp").alias("timestamp"), F.col("end_created").alias("created_at"), "node_id", F.col("end_id").alias("event_id"), F.col("end_type").alias("event_type"), "slot")
    return named.unionByName(linked)


@query(
    "q50_slot_events",
    _SLOTS
    + """ SELECT slot, count(*) FILTER (event_type = 42) AS blocks_authored, count(*) FILTER (event_type = 62) AS blocks_announced, count(*) FILTER (event_type = 68) AS blocks_transferred, count(*) AS total_events,
  count(*) FILTER (event_type = 40) AS authoring_attempts, count(*) FILTER (event_type = 41) AS authoring_failures, count(DISTINCT node_id) AS nodes_involved, min(created_at) AS first_event, max(created_at) AS last_event FROM s GROUP BY slot""",
)
def slot_events(t):
    """A slot's events: those that name it, and the outcome of each attempt to author its block."""
    many = lambda i: F.count_if(F.col("event_type") == i)
    return slotted(t).groupBy("slot").agg(
        many(42).alias("blocks_authored"),
        many(62).alias("blocks_announced"),
        many(68).alias("blocks_transferred"),
        F.count(F.lit(1)).alias("total_events"),
        many(40).alias("authoring_attempts"),
        many(41).alias("authoring_failures"),
        F.count_distinct("node_id").alias("nodes_involved"),
        F.min("created_at").alias("first_event"),
        F.max("created_at").alias("last_event"),
    )


@query(
    "q50_slot_by_node",
    _SLOTS
    + """ SELECT node_id, count(*) AS events, string_agg(CAST(event_type AS VARCHAR), ',' ORDER BY timestamp, event_id) AS path FROM s
WHERE slot = (SELECT max(slot) FROM bd WHERE event_type = 40) GROUP BY node_id""",
)
def slot_by_node(t):
    """The events of the newest slot that a block was attempted for, as one ordered list a node."""
    newest = t.linked((40,), "slot").agg(F.max("slot").alias("slot"))  # one row
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "event_id", "event_type")))
    return slotted(t, newest).groupBy("node_id").agg(F.count(F.lit(1)).alias("events"), F.array_join(F.transform(ordered, lambda e: e["event_type"].cast("string")), ",").alias("path"))


@query("q55_events_view", f"SELECT timestamp, node_id, event_id, event_type, name, group_name FROM ev LEFT JOIN (VALUES {_TYPE_ROWS}) y(id, name, group_name) ON id = event_type")
def events_view(t):
    types = F.broadcast(event_types(t.events.sparkSession))  # the fixed table of types
    return t.events.select("timestamp", "node_id", "event_id", "event_type").join(types, F.col("event_type") == F.col("id"), "left").drop("id")


@checked
def live(events: DataFrame, node_id: str | None = None, types: tuple[int, int] | None = None, recent: int = 10_000, limit: int = 100) -> DataFrame:
    """Of the ``recent`` newest events by arrival, those of a node or of a range of types, the ``limit`` newest, in order of arrival."""
    window = events.select("event_id", "timestamp", "node_id", "event_type").orderBy(F.desc("event_id")).limit(recent)
    if node_id is not None:
        window = window.where(F.col("node_id") == node_id)
    if types is not None:
        window = window.where(F.col("event_type").between(*types))
    return window.orderBy(F.desc("event_id")).limit(limit).orderBy("event_id")


@query("q56_recent_broadcast", "SELECT event_id, timestamp, node_id, event_type FROM (SELECT * FROM ev ORDER BY event_id DESC LIMIT 10000) WHERE event_type BETWEEN 40 AND 68 ORDER BY event_id DESC LIMIT 100")
def recent_broadcast(t):
    return live(t.events, types=(40, 68))


@query("stm16_arrival_number", "SELECT event_id, node_id, row_number() OVER (PARTITION BY node_id ORDER BY timestamp, event_id) AS connection_event FROM ev")
def arrival_number(t):
    """The per-connection event counter; a connection's events are many tasks."""
    return numbered(t.events.select("event_id", "node_id", "timestamp"), "node_id", "timestamp", ["event_id"], "connection_event").drop("timestamp")
