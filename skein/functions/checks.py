"""What the arguments of queries must be; any other raises ValueError before a plan is made."""

from __future__ import annotations

import functools
import inspect
import re

#: Hashes that one call may name in a list; a table of them has no such bound.
MOST_HASHES = 50
_HEX_64 = re.compile(r"[0-9a-f]{64}")


def hex_64(name: str, value) -> None:
    if not isinstance(value, str) or not _HEX_64.fullmatch(value):
        raise ValueError(f"{name} must be 64 lower-case hex digits")


def _whole(name: str, value, low: int, high: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or high is not None and value > high:
        raise ValueError(f"{name} must be a whole number from {low}" + (f" to {high}" if high is not None else " on"))


def _hashes(name: str, values) -> None:
    if len(values) > MOST_HASHES:
        raise ValueError(f"at most {MOST_HASHES} {name} at a time; pass a table for more")
    for value in values:
        hex_64(name, value)


#: Checks by the name of the argument; None means that a criterion is not applied.
CHECKS = {
    "node_id": hex_64,
    "core": lambda n, v: _whole(n, v, 0),
    "limit": lambda n, v: _whole(n, v, 1, 5000),
    "offset": lambda n, v: _whole(n, v, 0),
    "hashes": _hashes,
}


def checked(plan):
    """``plan`` with its arguments checked by their names."""
    signature = inspect.signature(plan)
    names = [n for n in signature.parameters if n in CHECKS]
    if not names:
        return plan

    @functools.wraps(plan)
    def run(*args, **kwargs):
        given = signature.bind(*args, **kwargs).arguments
        for name in names:
            if given.get(name) is not None:
                CHECKS[name](name, given[name])
        return plan(*args, **kwargs)

    return run
