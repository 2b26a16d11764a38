"""Connections' bytes for tests: a handshake and frames as a node under load would send them."""

import random

from skein.sources import wire_format as wf


def handshake(node: int, cores: int = 16) -> bytes:
    details = {"peer_id": list(node.to_bytes(32, "big")), "peer_address": {"ipv6": [0] * 15 + [1], "port": 30000 + node % 1000}}
    return wf.encode_handshake(
        {"params": wf.default_parameters() | {"core_count": cores}, "genesis": [0] * 32, "details": details, "flags": 1, "implementation_name": "test-node", "implementation_version": "1.0.0", "gp_version": "0.7.0", "additional_info": "Test node"}
    )


def generated_connection(node: int, events: int, cores: int = 341, seed: int = 0) -> bytes:
    """A connection's bytes under load: half status reports, a quarter best blocks, 15 % finalised blocks, the rest sync changes."""
    rng, out, slot = random.Random(seed * 1_000_003 + node), [wf.frame(handshake(node, cores))], 1000
    for i in range(events):
        t, kind = i * 100_000, rng.random()
        slot = 1000 + i // 60
        block = {"slot": slot, "hash": [slot % 256] * 32}
        if kind < 0.5:
            n = rng.randrange(50)
            body = wf.encode_event(t, "Status", {"num_peers": n, "num_val_peers": n // 2, "num_sync_peers": n // 3, "num_guarantees": [rng.randrange(3) for _ in range(cores)], "num_shards": n, "shards_size": n * 1024, "num_preimages": 0, "preimages_size": 0})
        elif kind < 0.75:
            body = wf.encode_event(t, "BestBlockChanged", block)
        elif kind < 0.9:
            body = wf.encode_event(t, "FinalizedBlockChanged", block | {"slot": slot - 2})
        else:
            body = wf.encode_event(t, "SyncStatusChanged", {"synced": bool(i % 2)})
        out.append(wf.frame(body))
    return b"".join(out)
