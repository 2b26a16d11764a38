"""Mappings that the queries share.  Ids, names and groups of events are fixed values of the wire format."""

from __future__ import annotations

from ..sources.wire_format import BODIES

# fixed values: event groups by id range
GROUPS = {
    "core": (0, 0),
    "status": (10, 13),
    "networking": (20, 28),
    "blocks": (40, 68),
    "tickets": (80, 84),
    "work_package": (90, 104),
    "guaranteeing": (105, 113),
    "availability": (120, 131),
    "auditing": (140, 153),
    "segments": (160, 178),
    "preimages": (190, 199),
}
TYPES = {i: name for i, (name, _) in BODIES.items()}

# fixed values: sets of event ids that queries treat alike; several notions of failure exist side by side
FAILURES_ANALYTICS = (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127)
#: the names that reports of failures give them, which are not all those of the wire format
FAILURE_NAMES = {
    41: "BlockAuthoringFailed", 44: "BlockSealingFailed", 46: "BlockAuthoringTimedOut", 81: "TicketGenerationFailed", 83: "TicketTransferFailed", 92: "WorkPackageFailed", 99: "WorkPackageSharingFailed",
    107: "GuaranteeSendFailed", 111: "GuaranteeReceiveFailed", 113: "GuaranteeDiscarded", 122: "ShardRequestFailed", 127: "AssuranceSendFailed",
}
FAILURES_ANOMALY = (41, 44, 46, 81, 94, 97, 99, 102, 109, 110, 112, 113)
FAILURES_BATCH = (92, 93, 99, 112, 113)
#: attempts and failures of each category
CATEGORIES = {
    "block_authoring": ((40, 41, 42, 44, 46), (41, 44, 46)),
    "work_package": ((94, 95, 101, 102, 92, 99), (92, 99)),
    "ticket_generation": ((80, 81, 82, 83, 84), (81, 83)),
    "guarantee": ((105, 106, 107, 108, 109), (107,)),
}
#: categories of the grouped series of failures; what is in none is "other"
SERIES_CATEGORIES = {"block_authoring": (41, 44, 46), "work_package": (94, 97, 99, 102, 109, 110, 112, 113), "ticket_generation": (81,)}
#: categories of a node's timeline by id range; what is in none is "other"
TIMELINE = {
    "status": (10, 13),
    "connection": (20, 28),
    "blockAuthoring": (40, 47),
    "blockAnnouncement": (60, 68),
    "tickets": (80, 84),
    "workPackage": (90, 101),
    "guarantee": (102, 113),
    "shard": (120, 125),
    "assurance": (126, 131),
    "bundleShard": (140, 153),
    "segment": (160, 178),
    "preimage": (190, 199),
}
#: stages of a work package's journey by event; a failure for the reason SUPERSEDED is "superseded",
#: a discarded guarantee for the reason ON_CHAIN is "included"
STAGES = {
    90: "submitted", 91: "being_shared", 92: "failed", 93: "duplicate", 94: "received", 95: "authorized", 96: "extrinsic_received", 97: "imports_received", 101: "refined", 102: "report_built",
    105: "guarantee_built", 106: "guarantee_sending", 108: "guarantee_sent", 109: "guarantees_distributed", 112: "guarantee_received", 113: "discarded", 120: "shard_requested", 124: "shard_received", 125: "shards_transferred",
}
#: how far a stage is; stages that are not progress are under 0, so progress wins
STAGE_RANK = {
    "submitted": 0, "being_shared": 1, "received": 2, "extrinsic_received": 3, "imports_received": 3, "authorized": 4, "refined": 5, "report_built": 6, "guarantee_built": 7, "guarantee_sending": 7, "guarantee_sent": 7,
    "guarantees_distributed": 8, "guarantee_received": 9, "included": 10, "shard_requested": 11, "shard_received": 11, "shards_transferred": 11, "failed": -1, "guarantee_discarded": -1, "superseded": -2, "duplicate": -2,
}
#: the same of the detailed journey, with the status of each event; any other status is "completed"
DETAILED_STAGES = {
    90: "submitted", 91: "being_shared", 92: "failed", 93: "duplicate", 94: "received", 95: "authorized", 96: "extrinsic_data_received", 97: "imports_received", 98: "sharing", 99: "sharing_failed", 100: "bundle_sent",
    101: "refined", 102: "report_built", 105: "guarantee_built", 109: "guaranteed", 112: "guarantee_received", 113: "discarded", 120: "shard_requested", 124: "shard_received", 125: "shards_transferred",
}
DETAILED_STATUS = {"failed": (92, 99), "in_progress": (91, 96, 97, 98, 100)}
DETAILED_RANK = {
    "submitted": 0, "being_shared": 1, "received": 2, "extrinsic_data_received": 3, "imports_received": 3, "authorized": 4, "refined": 5, "report_built": 6, "guarantee_built": 7, "sharing": 7, "bundle_sent": 7,
    "guaranteed": 8, "distributed": 8, "guarantee_received": 9, "included": 10, "shard_requested": 11, "shard_received": 11, "shards_transferred": 11, "failed": -1, "sharing_failed": -1, "discarded": -1, "superseded": -2, "duplicate": -2,
}
#: stages and statuses of journeys asked for in batches; any other stage is "other", any other status "completed"
BATCH_STAGES = {90: "submitted", 91: "being_shared", 92: "failed", 94: "received", 95: "authorized", 101: "refined", 102: "report_built", 105: "guarantee_built", 107: "guarantee_sent", 108: "accumulated"}
BATCH_STATUS = {"failed": FAILURES_BATCH, "in_progress": (91, 98, 100, 103, 106)}
SUPERSEDED = "work package was refined by another guarantor"
ON_CHAIN = "PackageReportedOnChain"
#: minutes of the primary and the secondary window of each preset
PRESETS = {"5m": (5, 60), "15m": (15, 180), "1h": (60, 1440), "6h": (360, 1440), "24h": (1440, 1440)}
