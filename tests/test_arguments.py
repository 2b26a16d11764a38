from datetime import datetime

import pytest

from skein.plans import cores, nodes, packages, search
from skein.sources.adapter import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return load(spark, SF)


@pytest.mark.parametrize("node_id", ["", "7", "G" * 64, "A" * 64, "0" * 65, 7])
def test_node_ids(t, node_id):
    for plan in (nodes.node_by_id, nodes.node_status, nodes.node_peers, nodes.node_timeline):
        with pytest.raises(ValueError):
            plan(t, node_id=node_id)
    with pytest.raises(ValueError):
        search.search(t.events, node_id=node_id)


@pytest.mark.parametrize("core", [-1, 1.5, True, "3"])
def test_cores(t, core):
    for plan in (cores.core_validators, cores.core_metrics, packages.core_work_packages):
        with pytest.raises(ValueError):
            plan(t, core=core)


@pytest.mark.parametrize("limit, offset", [(0, 0), (1001, 0), (10, -1), (True, 0)])
def test_limits(t, limit, offset):
    with pytest.raises(ValueError):
        search.search(t.events, limit=limit, offset=offset)


def test_hashes(t):
    for hashes in (["cc"], ["0" * 64] * 51):
        with pytest.raises(ValueError):
            packages.workpackages_by_hash(t, hashes)
    assert packages.workpackages_by_hash(t, ["0" * 64]).count() == 0


def test_pages(t):
    start = datetime(2000, 1, 1)
    whole = search.search(t.events, event_types=[11], start=start, limit=1000).collect()
    n = len(whole)
    size = (n + 1) // 2
    first, more = search.page(t.events, size, 0, event_types=[11], start=start)
    second, last = search.page(t.events, size, size, event_types=[11], start=start)
    assert first + second == whole and more and last == (n == 2 * size)
    assert search.page(t.events, size, n, event_types=[11], start=start) == ([], False)
