"""The star-schema test tables as the telemetry model, for Spark and for the SQL that checks it.

Events keep their time, id and user (as node); their kind and the number in their JSON
properties choose the event type, so every group of types occurs.  Work packages
are orders: a line is an event of the package, its line number the stage and its
ship date the time.  ``PRELUDE`` says the same in DuckDB's SQL.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at, node_hex
from ..plans.constants import ON_CHAIN, SUPERSEDED, TYPES
from .footers import newest

CODES = {
    "view": (10, 11, 12, 13, 23, 26, 27, 20, 28),
    "click": (40, 41, 42, 43, 44, 46, 47, 62, 68, 63, 45),
    "signup": (90, 91, 92, 93, 94, 95, 97, 98, 99, 101, 102, 104, 96),
    "purchase": (105, 106, 107, 108, 109, 110, 111, 112, 113, 120, 121, 123, 124),
    "error": (0, 25, 80, 81, 82, 83, 84, 92, 122, 126, 127, 128, 190, 191, 192),
}
LINE_STAGES = (94, 95, 101, 102, 105, 109, 92)


class Telemetry:
    """The DataFrames that plans read, and the moments as of which they are asked.

    Tables by name: events, packages, chain, shards, audits, dims, services; ``payloads`` are events of packages with their
    body as JSON, ``typed_packages`` the same with typed columns, ``bodies`` those of nodes and blocks.  Each is a DataFrame or a function that makes it, which is called when
    a plan first asks for the table.
    """

    def __init__(self, newest: dict | None = None, **tables):
        self._tables, self._newest = tables, newest or {}
        #: the stored one-minute aggregate (``sinks.MinuteStats``) and node table (``sinks.NodeTable``), where they are kept
        self.minute_table = self.node_table = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        made = self._tables[name]
        self.__dict__[name] = made() if callable(made) else made
        return self.__dict__[name]

    def having(self, **tables) -> Telemetry:
        """The same with other tables, asked as of the same moments."""
        other = Telemetry({name: lambda name=name: getattr(self, name) for name in ("as_of", "packages_as_of")}, **(self._tables | tables))
        other.minute_table, other.node_table = self.minute_table, self.node_table
        return other

    @cached_property
    def as_of(self) -> datetime:
        """The newest event's time, unless one is set: assign the attribute to ask as of another moment."""
        return self._newest["as_of"]() if "as_of" in self._newest else self.events.agg(F.max("timestamp")).first()[0]

    @cached_property
    def packages_as_of(self) -> datetime:
        return self._newest["packages_as_of"]() if "packages_as_of" in self._newest else self.packages.agg(F.max("timestamp")).first()[0]

    def within(self, minutes: float, column: str = "timestamp") -> Column:
        """The trailing window: after as_of - minutes (exclusive), up to as_of."""
        return (F.col(column) > at(self.as_of - timedelta(minutes=minutes))) & (F.col(column) <= at(self.as_of))

    def last(self, minutes: float) -> DataFrame:
        return self.events.where(self.within(minutes))

    def last_packages(self, minutes: float) -> DataFrame:
        lower = at(self.packages_as_of - timedelta(minutes=minutes))
        return self.packages.where((F.col("timestamp") > lower) & (F.col("timestamp") <= at(self.packages_as_of)))

    def recent_packages(self, minutes: float) -> Telemetry:
        """The same with packages, chain and shards of the trailing window only; what is told of packages later belongs to them."""
        low, moment = at(self.packages_as_of - timedelta(minutes=minutes)), at(self.packages_as_of)
        after = lambda df: df.where(F.col("timestamp") > low)
        return self.having(packages=lambda: after(self.packages).where(F.col("timestamp") <= moment), chain=lambda: after(self.chain), shards=lambda: after(self.shards))

    def stats(self, minutes: float) -> DataFrame:
        """The one-minute aggregate of the trailing window.  The window's bounds, in whole minutes, are put to the
        events before they are grouped (or to a stored table, where there is one), so they reach the scan."""
        from ..plans.rollups import minute_after, stats_1m

        low, high = minute_after(self.as_of - timedelta(minutes=minutes)), minute_after(self.as_of)
        events = self.events.where(F.col("timestamp") < at(high))
        if self.minute_table is not None:
            return self.minute_table.read(events, low).where(F.col("bucket") < at(high))
        return stats_1m(events.where(F.col("timestamp") >= at(low)))

    @cached_property
    def stats_1m(self) -> DataFrame:
        from ..plans.rollups import stats_1m

        return stats_1m(self.events)

    @cached_property
    def nodes(self) -> DataFrame:
        """The node table: the stored one where it is kept, else a fold of all events."""
        from ..plans.nodes import fold_nodes, named_nodes

        if self.node_table is not None:
            return named_nodes(self.node_table.read(self.dims.sparkSession), self.dims)
        return fold_nodes(self.events, self.dims)

    def pipeline(self, *types: int) -> DataFrame:
        """Events of the pipeline with the typed columns of their bodies: share, core, gas, gas_limit."""
        return self.typed_packages.where(F.col("event_type").isin(*types))

    def linked(self, types: tuple[int, ...], *names: str) -> DataFrame:
        """Events of some types with the typed columns ``names`` of their bodies."""
        from .links import linked

        return linked(self.bodies.where(F.col("event_type").isin(*types)), *names, types=types)


def envelope(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    cases = " ".join(f"WHEN '{kind}' THEN array({', '.join(map(str, codes))})[k % {len(codes)}]" for kind, codes in CODES.items())
    code = F.expr(f"CASE event_type {cases} END")
    return (
        raw.withColumn("k", k)
        .withColumn("code", code)
        .select(
            F.col("ts").alias("timestamp"),
            F.col("ts").alias("created_at"),
            node_hex(F.col("user_id")).alias("node_id"),
            "event_id",
            F.col("code").alias("event_type"),
            "k",
            ((F.col("k") + F.col("event_id")) % 16).cast("int").alias("core"),
            F.expr("event_id div 8").alias("slot"),
            node_hex((F.col("user_id") * 7 + F.col("k")) % 97).alias("peer_id"),
            ((F.col("k") * 3 + F.col("event_id")) % 32).cast("int").alias("shard"),
            F.floor(F.col("value") * 100).cast("bigint").alias("gas"),
            "user_id",
        )
    )


def load(spark: SparkSession, sf_dir: str) -> Telemetry:
    """The model over a folder of tables; no file is opened but for the tables that a plan asks for."""
    read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    t = Telemetry(
        {"as_of": lambda: newest(read("events"), "ts"), "packages_as_of": lambda: newest(read("lineitem"), "l_shipdate")},
        raw=lambda: read("events"),
        events=lambda: envelope(read("events")),
        packages=lambda: _packages(read("lineitem"), read("orders")),
        chain=lambda: _chain(read("orders")),
        shards=lambda: _shards(read("lineitem")),
        audits=lambda: _audits(read("lineitem")),
        dims=lambda: _dims(read("nation"), read("region")),
        services=lambda: services_of(read("supplier"), read("lineitem")),
        payloads=lambda: payloads(t.events, t.packages, t.chain, t.shards),
        bodies=lambda: bodies(t.events),
        core_samples=lambda: core_samples(t.events),
        typed_packages=lambda: _typed_packages(read("lineitem")),
    )
    return t


def _stage() -> Column:
    return F.get(F.array(*map(F.lit, LINE_STAGES)), F.col("l_linenumber") - 1)


def _packages(lines: DataFrame, orders: DataFrame) -> DataFrame:
    stage = _stage()
    joined = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return joined.select(
        F.col("l_orderkey").alias("package"),
        node_hex(F.col("l_suppkey")).alias("node_id"),
        stage.alias("event_type"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_orderkey") % 16).cast("int").alias("core"),
        F.col("l_quantity").cast("bigint").alias("gas"),
        F.floor("l_extendedprice").cast("bigint").alias("gas_limit"),
        F.col("o_orderdate").alias("submitted"),
        F.when(stage == 92, F.when(F.col("l_partkey") % 3 == 0, SUPERSEDED).otherwise("refine failed")).alias("reason"),
        F.col("l_partkey").alias("part"),
    )


def _chain(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("package"),
        F.when(F.col("o_orderstatus") == "O", 112).otherwise(113).alias("event_type"),
        F.when(F.col("o_orderstatus") == "F", ON_CHAIN).when(F.col("o_orderstatus") == "P", "Expired").alias("reason"),
        (F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("timestamp"),
    )


def _shards(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("l_linestatus") == "F") & (F.col("l_linenumber") <= 2)).select(
        F.col("l_orderkey").alias("package"),
        node_hex(F.col("l_suppkey")).alias("node_id"),
        F.when(F.col("l_linenumber") == 1, 120).when(F.col("l_partkey") % 2 == 0, 124).otherwise(125).alias("event_type"),
        (F.col("l_shipdate") + F.expr("INTERVAL '1' DAY")).alias("timestamp"),
    )


def _audits(lines: DataFrame) -> DataFrame:
    return lines.where("l_linenumber <= 4").select(
        F.col("l_orderkey").alias("package"),
        node_hex(F.col("l_suppkey")).alias("node_id"),
        (105 + F.col("l_partkey") % 9).cast("int").alias("event_type"),
        (F.col("l_shipdate") + F.expr("INTERVAL '2' DAY")).alias("timestamp"),
        F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).alias("tranche"),
    )


def _dims(nation: DataFrame, region: DataFrame) -> DataFrame:
    nations = nation.join(F.broadcast(region.withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey")
    return nations.select(F.col("n_nationkey").cast("int").alias("dim"), F.col("n_name").alias("implementation"), F.col("r_name").alias("region"), _parameters(F.col("n_nationkey").cast("int")).alias("params"))


def core_samples(events: DataFrame) -> DataFrame:
    """Samples of all cores at each slot, as a node's snapshots tell them, from what happened on a core in the slot."""
    kind = F.col("event_type")
    total = lambda value, *types: F.coalesce(F.sum(F.when(kind.isin(*types), value)), F.lit(0)).cast("long")
    gas, one = F.col("gas"), F.lit(1)
    done = events.groupBy("slot", "core").agg(
        total(gas, 94, 105).alias("gas_used"), total(F.col("k"), 120, 121, 123, 124).alias("da_load"), total(F.col("k") % 5, 10, 11, 12, 13).alias("popularity"), total(one, 97).alias("imports"),
        total(one, 96).alias("extrinsic_count"), total(gas, 96).alias("extrinsic_size"),
    )
    grid = events.select("slot").distinct().select("slot", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("core"))
    rows = grid.join(done, ["slot", "core"], "left").na.fill(0)
    return rows.select(F.lit("node").alias("source"), F.col("slot").alias("arrival"), "slot", F.col("core").alias("core_index"), "gas_used", "da_load", "popularity", "imports", "extrinsic_count", "extrinsic_size")


def _typed_packages(lines: DataFrame) -> DataFrame:
    """The pipeline's events with the typed columns that the sink stores beside their bodies: what ``links.linked`` makes of ``payloads``."""
    rows = lines.select(
        F.col("l_shipdate").alias("timestamp"), node_hex(F.col("l_suppkey")).alias("node_id"), _stage().alias("event_type"), F.col("l_orderkey").cast("string").alias("share"),
        (F.col("l_orderkey") % 16).cast("int").alias("core"), F.col("l_quantity").cast("bigint").alias("gas"), F.floor("l_extendedprice").cast("bigint").alias("gas_limit"),
    )
    kind = F.col("event_type")
    gas = F.when(kind == 95, F.col("gas")).when(kind == 101, F.col("gas") + 1)
    received = lambda name: F.when(kind == 94, F.col(name)).alias(name)
    return rows.select("timestamp", "node_id", "event_type", "share", received("core"), gas.alias("gas"), received("gas_limit"))


def bodies(events: DataFrame) -> DataFrame:
    """The events of nodes, blocks, tickets and shards as they are received: an envelope and the body as JSON under its variant's name.

    A node's status tells the guarantees of some cores, ten at least; every seventh shard goes to no named peer.
    """
    kind, k, slot = F.col("event_type"), F.col("k"), F.col("slot")
    body = lambda name, *fields: F.to_json(F.struct(F.struct(*fields).alias(name)))
    at_slot = lambda name: body(name, slot.alias("slot"))
    shard, size = F.col("shard").alias("shard_index"), F.col("gas").alias("size")
    status = F.transform(F.sequence(F.lit(0), k % 10 + 9), lambda i: (i * 3 + k) % 7)
    data = (
        F.when(kind == 10, body("Status", k.alias("num_peers"), status.alias("num_guarantees")))
        .when(kind == 11, at_slot("BestBlockChanged"))
        .when(kind == 12, at_slot("FinalizedBlockChanged"))
        .when(kind == 40, at_slot("Authoring"))
        .when(kind == 41, body("AuthoringFailed", F.concat(F.lit("slot missed "), k.cast("string")).alias("reason")))
        .when(kind == 42, F.lit('{"Authored":{}}'))
        .when(kind == 43, at_slot("Importing"))
        .when(kind == 62, at_slot("BlockAnnounced"))
        .when(kind == 68, body("BlockTransferred", slot.alias("slot"), size))
        .when(kind == 80, body("GeneratingTickets", F.expr("slot div 25").alias("epoch")))
        .when(kind == 92, body("WorkPackageFailed", (slot % 40).alias("submission_or_share_id"), F.lit("refine failed").alias("reason")))
        .when(kind == 94, body("WorkPackageReceived", (slot % 40).alias("submission_or_share_id"), F.col("core").alias("core")))
        .when(kind == 105, body("GuaranteeBuilt", (slot % 40).alias("submission_id"), F.struct(F.col("core").alias("core"), _number_hash(slot, 2).alias("work_report_hash")).alias("outline")))
        .when(kind == 120, body("SendingShardRequest", F.col("shard").alias("shard")))
        .when(kind == 121, body("ShardRequested", shard, size))
        .when(kind == 123, body("ShardStored", shard, size))
        .when(kind == 124, body("ShardTransferred", shard, size, F.when(k % 7 > 0, F.col("peer_id")).alias("to_peer")))
        .otherwise(F.lit("{}"))
    )
    return events.select("timestamp", "created_at", "node_id", "event_id", "event_type", data.alias("data"))


def _parameters(dim: Column) -> Column:
    """What a node's handshake tells of the network."""
    return F.struct((dim + 16).alias("core_count"), (dim + 1000).alias("val_count"), F.lit(600).alias("epoch_period"), F.lit(6).alias("slot_period_sec"), F.lower(F.hex(dim)).alias("genesis"))


def services_of(suppliers: DataFrame, lines: DataFrame) -> DataFrame:
    """Suppliers as services: their balance, and their lines as what they refined and accumulated."""
    work = lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("refinement_count"), F.sum(F.col("l_quantity").cast("bigint")).alias("refinement_gas_used"), F.count_if(F.col("l_returnflag") == "R").alias("accumulate_count"))
    zero = [F.lit(0).cast("bigint").alias(n) for n in ("provided_count", "provided_size", "imports", "extrinsic_count", "extrinsic_size", "exports", "accumulate_gas_used")]
    joined = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("bigint").alias("balance")).join(work, "id", "left")
    return joined.select("id", "balance", F.struct("refinement_count", "refinement_gas_used", "accumulate_count", *zero).alias("activity"))


def _number_hash(number: Column, kind: int) -> Column:
    """A 32-byte hash as an array of numbers: the kind, zeros, and eight bytes of the number."""
    parts = [F.shiftright(number.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(7, -1, -1)]
    return F.array(F.lit(kind), *[F.lit(0)] * 23, *parts)


def payloads(events: DataFrame, packages: DataFrame, chain: DataFrame, shards: DataFrame) -> DataFrame:
    """The work-package and execution events as they are received: an envelope and the body as JSON under its variant's name.

    Packages are known by hash in the event that receives them, by share id in those of the pipeline, by their
    report's hash on chain, and by the erasure root, or the request for a shard, in transfers.
    """
    none, share, kind = F.lit(None).cast("string"), F.col("package"), F.col("event_type")
    cost = lambda gas: F.struct(F.struct(gas.alias("gas_used"), (gas * 2).alias("elapsed_ns")).alias("total"))
    body = lambda name, *fields: F.to_json(F.struct(F.struct(*fields).alias(name)))
    by_share = share.alias("submission_or_share_id")
    data = (
        F.when(kind == 94, body("WorkPackageReceived", by_share, F.col("core").alias("core"), F.struct(F.col("gas").alias("work_package_size"), _number_hash(share, 1).alias("work_package_hash"), F.array(F.struct(F.col("gas_limit").alias("refine_gas_limit"))).alias("work_items")).alias("outline")))
        .when(kind == 95, body("Authorized", by_share, cost(F.col("gas")).alias("cost")))
        .when(kind == 101, body("Refined", by_share, F.array(cost(F.col("gas")), cost(F.lit(1).cast("bigint"))).alias("costs")))
        .when(kind == 102, body("WorkReportBuilt", by_share, F.struct(_number_hash(share, 2).alias("work_report_hash"), _number_hash(share, 3).alias("erasure_root")).alias("outline")))
        .when(kind == 105, body("GuaranteeBuilt", share.alias("submission_id")))
        .when(kind == 109, body("GuaranteesDistributed", share.alias("submission_id")))
        .when(kind == 92, body("WorkPackageFailed", by_share, F.col("reason").alias("reason")))
    )
    own = packages.select("timestamp", "node_id", "event_type", data.alias("data"))
    report = F.struct(_number_hash(share, 2).alias("work_report_hash")).alias("outline")
    on_chain = chain.select("timestamp", none.alias("node_id"), "event_type", F.when(kind == 112, body("GuaranteeReceived", report)).otherwise(body("GuaranteeDiscarded", report, F.col("reason").alias("reason"))).alias("data"))
    root, request = _number_hash(share, 3).alias("erasure_root"), share.alias("request_id")
    moved = F.when(kind == 120, body("SendingShardRequest", root)).when(kind == 124, body("ShardRequestReceived", request, root)).otherwise(body("ShardsTransferred", request))
    transfers = shards.select("timestamp", "node_id", "event_type", moved.alias("data"))
    # pairs of a service and what it used, of which JSON makes arrays of unlike elements
    pair = lambda i: F.format_string('[%d,{"total":{"gas_used":%d,"elapsed_ns":%d}}]', i, F.col("gas") + i, F.col("gas") * i)
    pairs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k") % 3 + 1), pair), ",")
    executed = F.format_string('{"BlockExecuted":{"authoring_or_importing_id":%d,"accumulate_costs":[%s]}}', "event_id", pairs)
    blocks = events.where("event_type = 47").select("timestamp", "node_id", "event_type", executed.alias("data"))
    return own.unionByName(on_chain).unionByName(transfers).unionByName(blocks)


def event_types(spark: SparkSession) -> DataFrame:
    """id, name and group of every event type."""
    from ..plans.constants import GROUPS

    rows = [(i, name, next(g for g, (lo, hi) in GROUPS.items() if lo <= i <= hi)) for i, name in TYPES.items()]
    return spark.createDataFrame(rows, "id int, name string, group_name string")


def _code_sql() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{kind}' THEN ([{', '.join(map(str, codes))}])[k % {len(codes)} + 1]" for kind, codes in CODES.items()) + " END"


PRELUDE = f"""WITH ev0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), ev AS (
  SELECT ts AS timestamp, ts AS created_at, printf('%064x', user_id) AS node_id, event_id, {_code_sql()} AS event_type, k,
    CAST((k + event_id) % 16 AS INTEGER) AS core, event_id // 8 AS slot, printf('%064x', (user_id * 7 + k) % 97) AS peer_id, CAST((k * 3 + event_id) % 32 AS INTEGER) AS shard,
    CAST(floor(value * 100) AS BIGINT) AS gas, user_id
  FROM ev0
), a AS (SELECT max(ts) AS t FROM events
), pa AS (SELECT max(l_shipdate) AS t FROM lineitem
), pk AS (
  SELECT l_orderkey AS package, printf('%064x', l_suppkey) AS node_id, ([94, 95, 101, 102, 105, 109, 92])[l_linenumber] AS event_type,
    l_shipdate AS timestamp, CAST(l_orderkey % 16 AS INTEGER) AS core, CAST(trunc(l_quantity) AS BIGINT) AS gas,
    CAST(floor(l_extendedprice) AS BIGINT) AS gas_limit, o_orderdate AS submitted,
    CASE WHEN l_linenumber = 7 THEN CASE WHEN l_partkey % 3 = 0 THEN '{SUPERSEDED}' ELSE 'refine failed' END END AS reason, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), chain AS (
  SELECT o_orderkey AS package, CASE WHEN o_orderstatus = 'O' THEN 112 ELSE 113 END AS event_type,
    CASE o_orderstatus WHEN 'F' THEN '{ON_CHAIN}' WHEN 'P' THEN 'Expired' END AS reason, o_orderdate + INTERVAL 30 DAY AS timestamp
  FROM orders
), shards AS (
  SELECT l_orderkey AS package, printf('%064x', l_suppkey) AS node_id, CASE WHEN l_linenumber = 1 THEN 120 WHEN l_partkey % 2 = 0 THEN 124 ELSE 125 END AS event_type, l_shipdate + INTERVAL 1 DAY AS timestamp
  FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <= 2
), audits AS (
  SELECT l_orderkey AS package, printf('%064x', l_suppkey) AS node_id, CAST(105 + l_partkey % 9 AS INTEGER) AS event_type, l_shipdate + INTERVAL 2 DAY AS timestamp, CASE WHEN l_quantity > 25 THEN l_linenumber END AS tranche
  FROM lineitem WHERE l_linenumber <= 4
), st AS (
  SELECT date_trunc('minute', timestamp) AS bucket, node_id, event_type, count(*) AS event_count, min(timestamp) AS first_event, max(timestamp) AS last_event
  FROM ev GROUP BY 1, 2, 3
), bd AS (
  SELECT timestamp, created_at, node_id, event_id, event_type, CASE WHEN event_type IN (11, 12, 40, 43, 62, 68) THEN slot END AS slot, CASE WHEN event_type = 80 THEN slot // 25 END AS epoch,
    CASE WHEN event_type IN (94, 105) THEN core END AS core, CASE WHEN event_type IN (92, 94, 105) THEN slot % 40 END AS share, CASE WHEN event_type IN (120, 121, 123, 124) THEN shard END AS shard,
    CASE WHEN event_type IN (68, 121, 123, 124) THEN gas END AS bytes, CASE WHEN event_type = 124 AND k % 7 > 0 THEN peer_id END AS to_peer,
    CASE WHEN event_type = 10 THEN list_transform(range(k % 10 + 10), lambda i: (i * 3 + k) % 7) END AS num_guarantees,
    CASE event_type WHEN 41 THEN 'slot missed ' || k WHEN 92 THEN 'refine failed' END AS reason, CASE WHEN event_type = 105 THEN printf('02%046x%016x', 0, slot) END AS report
  FROM ev
), nd0 AS (
  SELECT node_id, any_value(user_id) AS user_id, max(timestamp) FILTER (event_type IN (23, 26)) AS connected_at, max(timestamp) FILTER (event_type = 27) AS disconnected_at,
    max(timestamp) AS last_seen, count(*) AS total_events FROM ev GROUP BY node_id
), nodes AS (
  SELECT node_id, n_name AS implementation, r_name AS region, connected_at, disconnected_at, last_seen, total_events,
    connected_at IS NOT NULL AND (disconnected_at IS NULL OR connected_at > disconnected_at) AS is_connected
  FROM nd0 LEFT JOIN nation ON n_nationkey = user_id % 25 LEFT JOIN region ON n_regionkey = r_regionkey
)"""
