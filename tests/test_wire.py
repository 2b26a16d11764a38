import random
from datetime import datetime

import pytest

from skein.sources import frames
from skein.sources import wire_format as wf

from . import loads


def value(kind, rng, cores):
    if kind in wf._INTS:
        return rng.choice([0, 1, 256 ** (int(kind[1:]) // 8) - 1])
    if kind in wf._LAYOUT:
        return {n: value(k, rng, cores) for n, k in wf._LAYOUT[kind]}
    if kind in wf.ENUMS:
        return rng.choice(wf.ENUMS[kind])
    if kind.startswith("vec."):
        return [value(kind[4:], rng, cores) for _ in range(rng.randrange(4))]
    if kind.startswith("opt."):
        return rng.choice([None, value(kind[4:], rng, cores)])
    return {
        "hash": lambda: [rng.randrange(256) for _ in range(32)], "bytes16": lambda: list(range(16)), "bool": lambda: rng.random() < 0.5, "cores": lambda: [1] * cores,
        "pair": lambda: [1, 65535], "service_cost": lambda: [7, value("AccumulateCost", rng, cores)],
        "import": lambda: {"root_identifier": {rng.choice(["WorkPackageHash", "SegmentsRoot"]): [3] * 32}, "export_index": rng.randrange(1 << 15)},
    }.get(kind, lambda: "né" * 3)()


@pytest.mark.parametrize("number", sorted(wf.BODIES))
def test_round_trip_of_every_event(number):
    name, layout = wf.BODIES[number]
    for seed in range(5):
        rng = random.Random(seed)
        fields = {n: value(k, rng, 5) for n, k in layout}
        assert wf.decode_event(wf.encode_event(12, name, fields), 5) == (12, number, {name: {"timestamp": 12} | fields})


def test_there_are_115_events():
    assert len(wf.BODIES) == 115


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 1_000_000])
def test_counts(n):
    assert wf._Reader(wf._count_bytes(n)).count() == n


def test_malformed():
    for data in (b"", b"\x01" * 5, bytes(8) + b"\x05", bytes(8) + b"\x0d\x02", bytes(8) + bytes([22]) + bytes(8) + wf._count_bytes(1000) + bytes(1000)):
        with pytest.raises(wf.WireError):
            wf.decode_event(data, 1)
    with pytest.raises(wf.WireError):
        wf._Reader(wf._count_bytes(1_000_001)).count()


def test_strings_are_truncated_and_repaired():
    body = wf.encode_event(0, "PeerMisbehaved", {"peer": [0] * 32, "reason": "x" * 400})
    assert wf.decode_event(body, 1)[2]["PeerMisbehaved"]["reason"] == "x" * 128
    head = bytes(8) + bytes([28]) + bytes(32)
    assert wf.decode_event(head + b"\x02\xff\xfe", 1)[2]["PeerMisbehaved"]["reason"] == "��"


def test_files_to_events(spark, tmp_path):
    for node in (1, 2):
        data = loads.generated_connection(node, 40, cores=16)
        (tmp_path / f"{node}.bin").write_bytes(data + wf.frame(b"junk") + wf.frame(wf.encode_event(5_000_000, "SyncStatusChanged", {"synced": True})) + b"\xff\xff\xff\xff")
    (tmp_path / "empty.bin").write_bytes(b"")
    events = frames.with_payload(frames.read_connections(spark, str(tmp_path)))
    assert events.groupBy("node_id").count().toPandas()["count"].tolist() == [41, 41]
    last = events.where("event_id = 41").selectExpr("timestamp", "variant_get(payload, '$.SyncStatusChanged.synced', 'boolean') AS synced").first()
    assert last["synced"] is True and last["timestamp"] == datetime(2025, 1, 1, 12, 0, 5)


def test_handshakes_become_nodes(spark, tmp_path):
    import json

    from skein.sources import sinks

    for node in (1, 2):
        (tmp_path / f"{node}.bin").write_bytes(loads.generated_connection(node, 3, cores=16))
    (tmp_path / "none.bin").write_bytes(b"\x01\x00\x00\x00x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    told = frames.decode_handshakes(files)
    rows = {r["node_id"]: r for r in told.collect()}
    assert set(rows) == {f"{n:064x}" for n in (1, 2)}
    one = rows[f"{1:064x}"]
    assert json.loads(one["params"])["core_count"] == 16 and one["genesis"] == "00" * 32 and one["flags"] == 1 and one["peer_address"].endswith(":0001]:30001") and one["implementation_name"] == "test-node"
    schema = "node_id string, peer_id string, connected_at timestamp, disconnected_at timestamp, last_seen_at timestamp, is_connected boolean, event_count long"
    nodes = sinks.upsert_nodes(spark.createDataFrame([], schema), frames.node_changes(told, files)).collect()
    assert {r["node_id"] for r in nodes} == set(rows) and all(r["is_connected"] for r in nodes)


def cost(gas, ns):
    return {"gas_used": gas, "elapsed_ns": ns}


def received_events(node, share, start, kinds, report=None):
    """Frames of a package's events, one second apart."""
    rng = random.Random(1)
    out = [wf.frame(loads.handshake(node))]
    for i, name in enumerate(kinds):
        body = {n: value(k, rng, 16) for n, k in wf.BODIES[wf.IDS[name]][1]}
        body |= {n: share for n in ("submission_or_share_id", "submission_id") if n in body}
        if name == "WorkPackageReceived":
            body |= {"core": 3, "outline": body["outline"] | {"work_package_hash": [0xCC] * 32}}
        if name == "WorkReportBuilt":
            body["outline"] = body["outline"] | {"work_report_hash": [0xBB] * 32, "erasure_root": [0xEE] * 32}
        if name == "GuaranteeDiscarded":
            body = {"outline": body["outline"] | {"work_report_hash": [0xBB] * 32}, "reason": "PackageReportedOnChain"}
        if name == "ShardRequestReceived":
            body |= {"request_id": 77, "erasure_root": [0xEE] * 32}
        if name == "ShardsTransferred":
            body["request_id"] = 77
        out.append(wf.frame(wf.encode_event(start + i * 1_000_000, name, body)))
    return b"".join(out)


def test_received_frames_reach_the_plans(spark, tmp_path):
    from skein.plans import packages
    from skein.sources import payload

    (tmp_path / "a.bin").write_bytes(received_events(1, 8001, 0, ["WorkPackageReceived", "Authorized", "Refined", "GuaranteeBuilt"]))
    events = frames.read_connections(spark, str(tmp_path))
    t = payload.telemetry(events)
    row = packages.pipeline(t).first()
    assert (row["package"], row["core"], row["current_stage"], row["elapsed_ms"]) == ("cc" * 32, 3, "guarantee_built", 3000.0)
    assert packages.stage_durations(t).where("step = 'refined_to_report_built'").count() == 0

    (tmp_path / "b.bin").write_bytes(received_events(2, 8001, 4_000_000, ["WorkReportBuilt", "GuaranteesDistributed"]))
    (tmp_path / "c.bin").write_bytes(received_events(3, 1, 6_000_000, ["GuaranteeDiscarded", "ShardRequestReceived", "ShardsTransferred"]))
    t = payload.telemetry(frames.read_connections(spark, str(tmp_path)))
    row = packages.pipeline(t).first()
    assert (row["package"], row["current_stage"], row["elapsed_ms"]) == ("cc" * 32, "available", 7000.0)
    steps = [r["stage"] for r in packages.workpackage_journey(t).orderBy("step").collect()]
    assert steps == ["received", "authorized", "refined", "guarantee_built", "report_built", "guarantees_distributed", "included", "shard_received", "shards_transferred"]
    out = packages.journey_outcomes(t, [("cc" * 32)]).first()
    assert (out["current_stage"], out["failed"], out["superseded"], out["core"]) == ("shards_transferred", False, False, 3)
    assert packages.workpackage_journey(t, spark.createDataFrame([("dd" * 32,)], "package string")).count() == 0
    assert payload.with_hash(events, ["cc" * 32, "00" * 32]).count() == 1
    assert packages.batch_journeys(t).first()["nodes_involved"] == 2
    assert packages.audit_progress(t).first()["guarantees_built"] == 1


def test_accumulate_costs_of_received_blocks(spark, tmp_path):
    from skein.sources import payload

    one = {n: value(k, random.Random(2), 16) for n, k in wf._LAYOUT["AccumulateCost"]}
    body = {"authoring_or_importing_id": 5, "accumulate_costs": [[7, one | {"total": cost(500, 1000)}], [9, one | {"total": cost(1, 2)}]]}
    (tmp_path / "a.bin").write_bytes(wf.frame(loads.handshake(1)) + wf.frame(wf.encode_event(0, "BlockExecuted", body)))
    got = payload.accumulate_costs(frames.read_connections(spark, str(tmp_path))).collect()
    assert sorted((r["service"], r["gas"], r["elapsed_ns"]) for r in got) == [(7, 500, 1000), (9, 1, 2)]


def test_snapshots(spark, tmp_path):
    import json

    from skein.sources import snapshots

    core = {"gas_used": 5, "da_load": 1, "popularity": 2, "imports": 0, "extrinsic_count": 0, "extrinsic_size": 0}
    service = lambda i, balance, n: {"id": i, "balance": balance, "activity": {"refinement_count": n, "refinement_gas_used": 10 * n}}
    documents = [{"source": "n", "arrival": i, "slot": slot, "cores": [core, core | {"gas_used": slot}], "services": [service(1, 100 + i, i), service(2, 7, 0)]} for i, slot in enumerate([5, 5, 6])]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, documents)) + "\nno document\n")
    read = snapshots.read_snapshots(spark, str(tmp_path))
    assert snapshots.core_samples(read).where("core_index = 1").selectExpr("sum(gas_used)").first()[0] == 16
    bad = snapshots.malformed(spark, str(tmp_path)).collect()
    assert [(r["file"].endswith("x.json"), r["lines"]) for r in bad] == [(True, 1)]
    totals = snapshots.services_totals(snapshots.services(read)).first()
    assert (totals["services"], totals["active_services"], totals["total_balance"], totals["total_refinement_gas_used"]) == (2, 1, 109, 20)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for node in (1, 2, 3):
        (tmp_path / "in" / f"node-{node}").write_bytes(loads.generated_connection(node, 20))
    q = frames.stream_connections(spark, str(tmp_path / "in"), 1).writeStream.format("memory").queryName("frames_in").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("frames_in").count() == 60


def test_frames_as_a_data_source(spark, tmp_path):
    from skein.sources import datasource

    datasource.register(spark)
    (tmp_path / "in").mkdir()
    for node in (1, 2, 3):
        (tmp_path / "in" / f"{node}.bin").write_bytes(loads.generated_connection(node, 30, cores=16))
    path = str(tmp_path / "in")
    whole = frames.timed(spark.read.format("skein_frames").option("path", path).load())
    plain = frames.read_connections(spark, path)
    assert whole.schema == plain.schema and sorted(map(tuple, whole.collect())) == sorted(map(tuple, plain.collect()))
    stream = spark.readStream.format("skein_frames").option("path", path).option("files", 1).load()

    def take(count):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(str(tmp_path / "out")).count() == count

    take(90)
    (tmp_path / "in" / "4.bin").write_bytes(loads.generated_connection(4, 30, cores=16))
    take(120)  # after a restart, the new file only


@pytest.mark.parametrize("range_bytes", [400, 5000, 1 << 24])
def test_connections_split_over_tasks(spark, tmp_path, range_bytes):
    """One file of a busy node is many partitions; numbers are those of a whole read, frames that do not decode included."""
    junk = wf.frame(b"junk")
    busy = loads.generated_connection(1, 80, cores=16)
    more = b"".join(wf.frame(wf.encode_event(i, "SyncStatusChanged", {"synced": True})) + junk * (i % 3) for i in range(200))
    (tmp_path / "a.bin").write_bytes(busy + junk + more + b"\x40\x00\x00\x00cut")
    (tmp_path / "b.bin").write_bytes(loads.generated_connection(2, 3, cores=16) + b"\xff\xff\xff\xff" + more)
    (tmp_path / "c.bin").write_bytes(loads.generated_connection(3, 0))
    (tmp_path / "d.bin").write_bytes(b"")
    (tmp_path / "e.bin").write_bytes(junk)
    whole, split = frames.read_connections(spark, str(tmp_path)), frames.read_split(spark, str(tmp_path), range_bytes)
    assert whole.schema == split.schema
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    ranges = frames.frame_index(spark.read.format("binaryFile").load(str(tmp_path)), range_bytes)
    assert ranges.where("path LIKE '%a.bin'").count() > 2 or range_bytes > 400


def test_a_file_that_comes_late_is_an_error(tmp_path):
    from skein.sources.datasource import FrameStreamReader

    reader = FrameStreamReader({"path": str(tmp_path)})
    (tmp_path / "b").write_bytes(b"")
    assert reader.latestOffset() == reader.latestOffset() == {"file": "b"}
    (tmp_path / "c").write_bytes(b"")
    assert reader.latestOffset() == {"file": "c"}
    (tmp_path / "a").write_bytes(b"")
    with pytest.raises(ValueError, match="came after it"):
        reader.latestOffset()


def test_frames_of_a_file_are_those_of_its_bytes(tmp_path):
    rng = random.Random(8)
    data = b"".join(wf.frame(rng.randbytes(rng.choice([0, 1, 5, 3000]))) for _ in range(60)) + rng.choice([b"", b"\x09", b"\x09\x00\x00\x00abc"])
    (tmp_path / "f").write_bytes(data)
    for step in (1, 7, 1000, 1 << 20):
        with open(tmp_path / "f", "rb") as file:
            found = list(frames.frames_in(file, step=step))
            assert [body for _, body in found] == list(wf.split_frames(data))
            middle = found[30][0]
            assert list(frames.frames_in(file, middle, found[40][0], step)) == found[30:40]
