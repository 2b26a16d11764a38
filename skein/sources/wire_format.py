"""The wire format of handshakes and events, as tables, and one reader and writer that follow them.

Integers are little-endian; counts before arrays and strings are LEB128, at most
1,000,000.  A decoded value is plain Python: ints, bools, strings, lists and dicts.
Fixed byte arrays are lists of ints, as queries on JSON payloads expect them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

# fixed values: structures, field by field
STRUCTS = """
Address ipv6:bytes16 port:u16
Peer peer_id:hash peer_address:Address
Block size_bytes:u32 hash:hash num_tickets:u32 num_preimages:u32 total_preimages_size:u32 num_guarantees:u32 num_assurances:u32 num_dispute_verdicts:u32
Exec gas_used:u64 elapsed_ns:u64
AuthorizedCost total:Exec load_ns:u64 host_call:Exec
RefineCalls lookup:Exec vm:Exec mem:Exec invoke:Exec other:Exec
RefineCost total:Exec load_ns:u64 host_call:RefineCalls
AccumulateCalls state:Exec lookup:Exec preimage:Exec service:Exec transfer:Exec transfer_dest_gas:u64 other:Exec
AccumulateCost num_calls:u32 num_transfers:u32 num_items:u32 total:Exec load_ns:u64 host_call:AccumulateCalls
Item service_id:u32 payload_size:u32 refine_gas_limit:u64 accumulate_gas_limit:u64 sum_of_extrinsic_lengths:u32 imports:vec.import num_exported_segments:u16
Package work_package_size:u32 work_package_hash:hash anchor:hash lookup_anchor_slot:u32 prerequisites:vec.hash work_items:vec.Item
Report work_report_hash:hash bundle_size:u32 erasure_root:hash segments_root:hash
Guarantee work_report_hash:hash slot:u32 guarantors:vec.u16
Statement anchor:hash bitfield:vec.u8
Parameters deposit_per_item:u64 deposit_per_byte:u64 deposit_per_account:u64 core_count:u16 min_turnaround_period:u32 epoch_period:u32 max_accumulate_gas:u64 max_is_authorized_gas:u64 max_refine_gas:u64 block_gas_limit:u64 recent_block_count:u16 max_work_items:u16 max_dependencies:u16 max_tickets_per_block:u16 max_lookup_anchor_age:u32 tickets_attempts_number:u16 auth_window:u16 slot_period_sec:u16 auth_queue_len:u16 rotation_period:u16 max_extrinsics:u16 availability_timeout:u16 val_count:u16 max_authorizer_code_size:u32 max_input:u32 max_service_code_size:u32 basic_piece_len:u32 max_imports:u32 segment_piece_count:u32 max_report_elective_data:u32 transfer_memo_size:u32 max_exports:u32 epoch_tail_start:u32
Handshake version:version params:Parameters genesis:hash details:Peer flags:u32 implementation_name:str32 implementation_version:str32 gp_version:str16 additional_info:str512
"""

# fixed values: enumerations, by number from 0
ENUMS = {
    "side": ("Local", "Remote"),
    "direction": ("Ascending", "Descending"),
    "reconstruction": ("NonTrivial", "Trivial"),
    "discard": ("PackageReportedOnChain", "ReplacedByBetter", "CannotReportOnChain", "TooManyGuarantees", "Other"),
    "forget": ("ProvidedOnChain", "NotRequestedOnChain", "FailedToAcquire", "TooManyAnnounced", "BadLength", "Other"),
    "preimage_discard": ("ProvidedOnChain", "NotRequestedOnChain", "TooManyPreimages", "Other"),
}

# fixed values: events by id; the timestamp, microseconds since the private epoch, comes before each body
EVENTS = """
0 Dropped last_timestamp:u64 num:u64
10 Status num_peers:u32 num_val_peers:u32 num_sync_peers:u32 num_guarantees:cores num_shards:u32 shards_size:u64 num_preimages:u32 preimages_size:u32
11 BestBlockChanged slot:u32 hash:hash
12 FinalizedBlockChanged slot:u32 hash:hash
13 SyncStatusChanged synced:bool
20 ConnectionRefused from:Address
21 ConnectingIn from:Address
22 ConnectInFailed connecting_id:u64 reason:str128
23 ConnectedIn connecting_id:u64 peer_id:hash
24 ConnectingOut to:Peer
25 ConnectOutFailed connecting_id:u64 reason:str128
26 ConnectedOut connecting_id:u64
27 Disconnected peer:hash terminator:opt.side reason:str128
28 PeerMisbehaved peer:hash reason:str128
40 Authoring slot:u32 parent:hash
41 AuthoringFailed authoring_id:u64 reason:str128
42 Authored authoring_id:u64 outline:Block
43 Importing slot:u32 outline:Block
44 BlockVerificationFailed importing_id:u64 reason:str128
45 BlockVerified importing_id:u64
46 BlockExecutionFailed authoring_or_importing_id:u64 reason:str128
47 BlockExecuted authoring_or_importing_id:u64 accumulate_costs:vec.service_cost
60 BlockAnnouncementStreamOpened peer:hash opener:side
61 BlockAnnouncementStreamClosed peer:hash closer:side reason:str128
62 BlockAnnounced peer:hash announcer:side slot:u32 hash:hash
63 SendingBlockRequest recipient:hash hash:hash direction:direction max_blocks:u32
64 ReceivingBlockRequest sender:hash
65 BlockRequestFailed request_id:u64 reason:str128
66 BlockRequestSent request_id:u64
67 BlockRequestReceived request_id:u64 hash:hash direction:direction max_blocks:u32
68 BlockTransferred request_id:u64 slot:u32 outline:Block last:bool
80 GeneratingTickets epoch:u32
81 TicketGenerationFailed generating_id:u64 reason:str128
82 TicketsGenerated generating_id:u64 ids:vec.hash
83 TicketTransferFailed peer:hash sender:side from_proxy:bool reason:str128
84 TicketTransferred peer:hash sender:side from_proxy:bool epoch:u32 attempt:u8 id:hash
90 WorkPackageSubmission builder:hash bundle:bool
91 WorkPackageBeingShared primary:hash
92 WorkPackageFailed submission_or_share_id:u64 reason:str128
93 DuplicateWorkPackage submission_or_share_id:u64 core:u16 hash:hash
94 WorkPackageReceived submission_or_share_id:u64 core:u16 outline:Package
95 Authorized submission_or_share_id:u64 cost:AuthorizedCost
96 ExtrinsicDataReceived submission_or_share_id:u64
97 ImportsReceived submission_or_share_id:u64
98 SharingWorkPackage submission_id:u64 secondary:hash
99 WorkPackageSharingFailed submission_id:u64 secondary:hash reason:str128
100 BundleSent submission_id:u64 secondary:hash
101 Refined submission_or_share_id:u64 costs:vec.RefineCost
102 WorkReportBuilt submission_or_share_id:u64 outline:Report
103 WorkReportSignatureSent share_id:u64
104 WorkReportSignatureReceived submission_id:u64 secondary:hash
105 GuaranteeBuilt submission_id:u64 outline:Guarantee
106 SendingGuarantee built_id:u64 recipient:hash
107 GuaranteeSendFailed sending_id:u64 reason:str128
108 GuaranteeSent sending_id:u64
109 GuaranteesDistributed submission_id:u64
110 ReceivingGuarantee sender:hash
111 GuaranteeReceiveFailed receiving_id:u64 reason:str128
112 GuaranteeReceived receiving_id:u64 outline:Guarantee
113 GuaranteeDiscarded outline:Guarantee reason:discard
120 SendingShardRequest guarantor:hash erasure_root:hash shard:u16
121 ReceivingShardRequest assurer:hash
122 ShardRequestFailed request_id:u64 reason:str128
123 ShardRequestSent request_id:u64
124 ShardRequestReceived request_id:u64 erasure_root:hash shard:u16
125 ShardsTransferred request_id:u64
126 DistributingAssurance statement:Statement
127 AssuranceSendFailed distributing_id:u64 recipient:hash reason:str128
128 AssuranceSent distributing_id:u64 recipient:hash
129 AssuranceDistributed distributing_id:u64
130 AssuranceReceiveFailed sender:hash reason:str128
131 AssuranceReceived sender:hash anchor:hash
140 SendingBundleShardRequest audit_id:u64 assurer:hash shard:u16
141 ReceivingBundleShardRequest auditor:hash
142 BundleShardRequestFailed request_id:u64 reason:str128
143 BundleShardRequestSent request_id:u64
144 BundleShardRequestReceived request_id:u64 erasure_root:hash shard:u16
145 BundleShardTransferred request_id:u64
146 ReconstructingBundle audit_id:u64 kind:reconstruction
147 BundleReconstructed audit_id:u64
148 SendingBundleRequest audit_id:u64 guarantor:hash
149 ReceivingBundleRequest auditor:hash
150 BundleRequestFailed request_id:u64 reason:str128
151 BundleRequestSent request_id:u64
152 BundleRequestReceived request_id:u64 erasure_root:hash
153 BundleTransferred request_id:u64
160 WorkPackageHashMapped submission_id:u64 work_package_hash:hash segments_root:hash
161 SegmentsRootMapped submission_id:u64 segments_root:hash erasure_root:hash
162 SendingSegmentShardRequest submission_id:u64 assurer:hash proofs:bool shards:vec.pair
163 ReceivingSegmentShardRequest sender:hash proofs:bool
164 SegmentShardRequestFailed request_id:u64 reason:str128
165 SegmentShardRequestSent request_id:u64
166 SegmentShardRequestReceived request_id:u64 num:u16
167 SegmentShardsTransferred request_id:u64
168 ReconstructingSegments submission_id:u64 segments:vec.u16 kind:reconstruction
169 SegmentReconstructionFailed reconstructing_id:u64 reason:str128
170 SegmentsReconstructed reconstructing_id:u64
171 SegmentVerificationFailed submission_id:u64 segments:vec.u16 reason:str128
172 SegmentsVerified submission_id:u64 segments:vec.u16
173 SendingSegmentRequest submission_id:u64 prev_guarantor:hash segments:vec.u16
174 ReceivingSegmentRequest guarantor:hash
175 SegmentRequestFailed request_id:u64 reason:str128
176 SegmentRequestSent request_id:u64
177 SegmentRequestReceived request_id:u64 num:u16
178 SegmentsTransferred request_id:u64
190 PreimageAnnouncementFailed peer:hash announcer:side reason:str128
191 PreimageAnnounced peer:hash announcer:side service:u32 hash:hash length:u32
192 AnnouncedPreimageForgotten service:u32 hash:hash length:u32 reason:forget
193 SendingPreimageRequest recipient:hash hash:hash
194 ReceivingPreimageRequest sender:hash
195 PreimageRequestFailed request_id:u64 reason:str128
196 PreimageRequestSent request_id:u64
197 PreimageRequestReceived request_id:u64 hash:hash
198 PreimageTransferred request_id:u64 length:u32
199 PreimageDiscarded hash:hash length:u32 reason:preimage_discard
"""

# fixed values: limits of the format
VERSION, LONGEST_COUNT, LONGEST_STRING, TRUNCATED_BELOW, LONGEST_FRAME = 0, 1_000_000, 100_000, 1000, 100 * 1024
_INTS = {"u8": struct.Struct("<B"), "u16": struct.Struct("<H"), "u32": struct.Struct("<I"), "u64": struct.Struct("<Q")}
_BY_HASH = 0x8000


class WireError(ValueError):
    """Bytes that are not of the format."""


def _fields(text: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in text.split()]


_LAYOUT = {name: _fields(rest) for name, _, rest in (line.partition(" ") for line in STRUCTS.split("\n") if line)}
BODIES = {int(i): (name, _fields(rest)) for i, name, rest in ((line + "  ").split(" ", 2) for line in EVENTS.split("\n") if line)}
IDS = {name: i for i, (name, _) in BODIES.items()}


class _Reader:
    def __init__(self, data: bytes, core_count: int = 0):
        self.data, self.at, self.core_count = data, 0, core_count

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise WireError(f"{n} bytes are needed, {len(self.data) - self.at} are left")
        self.at += n
        return self.data[self.at - n : self.at]

    def integer(self, kind: str) -> int:
        return _INTS[kind].unpack(self.take(_INTS[kind].size))[0]

    def count(self) -> int:
        value = 0
        for shift in range(0, 63, 7):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value > LONGEST_COUNT:
                    raise WireError(f"a count of {value}")
                return value
        raise WireError("a count without end")

    def string(self, most: int) -> str:
        n = self.count()
        if n > LONGEST_STRING or n > most and n >= TRUNCATED_BELOW:
            raise WireError(f"a string of {n} bytes; {most} are allowed")
        return self.take(n)[:most].decode("utf-8", "replace")

    def read(self, kind: str):
        if kind in _INTS:
            return self.integer(kind)
        if kind in _LAYOUT:
            return {name: self.read(k) for name, k in _LAYOUT[kind]}
        if kind == "hash":
            return list(self.take(32))
        if kind.startswith("str"):
            return self.string(int(kind[3:]))
        if kind.startswith("vec."):
            return [self.read(kind[4:]) for _ in range(self.count())]
        if kind in ("bool", "version") or kind.startswith("opt.") or kind in ENUMS:
            byte = self.take(1)[0]
            if byte >= {"version": VERSION + 1}.get(kind, len(ENUMS.get(kind, "01"))):
                raise WireError(f"{byte} is no {kind}")
            if kind.startswith("opt."):
                return self.read(kind[4:]) if byte else None
            return ENUMS[kind][byte] if kind in ENUMS else byte if kind == "version" else byte == 1
        if kind == "bytes16":
            return list(self.take(16))
        if kind == "cores":
            return list(self.take(self.core_count))
        if kind == "pair":
            return [self.integer("u16"), self.integer("u16")]
        if kind == "service_cost":
            return [self.integer("u32"), self.read("AccumulateCost")]
        if kind == "import":
            root, index = list(self.take(32)), self.integer("u16")
            return {"root_identifier": {"WorkPackageHash" if index & _BY_HASH else "SegmentsRoot": root}, "export_index": index & ~_BY_HASH}
        raise KeyError(kind)


def _count_bytes(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _write(kind: str, value) -> bytes:
    if kind in _INTS:
        return _INTS[kind].pack(value)
    if kind in _LAYOUT:
        return b"".join(_write(k, value[name]) for name, k in _LAYOUT[kind])
    if kind in ("hash", "bytes16", "cores"):
        return bytes(value)
    if kind.startswith("str"):
        data = value.encode()
        return _count_bytes(len(data)) + data
    if kind.startswith("vec."):
        return _count_bytes(len(value)) + b"".join(_write(kind[4:], v) for v in value)
    if kind in ENUMS:
        return bytes([ENUMS[kind].index(value)])
    if kind in ("bool", "version"):
        return bytes([value])
    if kind.startswith("opt."):
        return b"\0" if value is None else b"\1" + _write(kind[4:], value)
    if kind == "pair":
        return _write("u16", value[0]) + _write("u16", value[1])
    if kind == "service_cost":
        return _write("u32", value[0]) + _write("AccumulateCost", value[1])
    if kind == "import":
        ((form, root),) = value["root_identifier"].items()
        return bytes(root) + _write("u16", value["export_index"] | (_BY_HASH if form == "WorkPackageHash" else 0))
    raise KeyError(kind)


def decode_event(frame: bytes, core_count: int) -> tuple[int, int, dict]:
    """(timestamp, event id, {variant: fields}) of an event frame's body."""
    reader = _Reader(frame, core_count)
    timestamp, number = reader.integer("u64"), reader.integer("u8")
    if number not in BODIES:
        raise WireError(f"{number} is no event")
    name, fields = BODIES[number]
    return timestamp, number, {name: {"timestamp": timestamp} | {n: reader.read(k) for n, k in fields}}


def encode_event(timestamp: int, name: str, fields: dict) -> bytes:
    number = IDS[name]
    return _write("u64", timestamp) + bytes([number]) + b"".join(_write(k, fields[n]) for n, k in BODIES[number][1])


def decode_handshake(frame: bytes) -> dict:
    return _Reader(frame).read("Handshake")


def encode_handshake(fields: dict) -> bytes:
    return _write("Handshake", {"version": VERSION} | fields)


def frame(body: bytes) -> bytes:
    return _INTS["u32"].pack(len(body)) + body


def split_frames(stream: bytes) -> Iterator[bytes]:
    """The whole frames of a connection's bytes; a length over the limit ends the connection, a cut-off frame is left out."""
    at = 0
    while at + 4 <= len(stream):
        (n,) = _INTS["u32"].unpack_from(stream, at)
        if n > LONGEST_FRAME or at + 4 + n > len(stream):
            return
        yield stream[at + 4 : at + 4 + n]
        at += 4 + n


@lru_cache(maxsize=1)
def default_parameters() -> dict:
    """Parameters of a small test network: all zero but for its sizes."""
    return {name: 0 for name, _ in _LAYOUT["Parameters"]} | {"core_count": 16, "val_count": 1023, "epoch_period": 600, "slot_period_sec": 6}


def event_json(event: dict) -> str:
    return json.dumps(event, separators=(",", ":"), ensure_ascii=False)
