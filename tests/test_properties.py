"""Closed forms against plain loops on random inputs."""

import math
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scimap.operators import agreement as ag
from scimap.operators import laws
from scimap.operators import ranks

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=2, max_size=25)
counts = st.lists(st.integers(1, 30), min_size=1, max_size=20)


@FEW
@given(pairs)
def test_kendall(spark, xy):
    n0 = len(xy) * (len(xy) - 1) / 2
    sign = lambda v: (v > 0) - (v < 0)
    diff = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in combinations(xy, 2))
    tx, ty = (sum(a[k] == b[k] for a, b in combinations(xy, 2)) for k in (0, 1))
    root = math.sqrt((n0 - tx) * (n0 - ty))
    got = ag.kendall(spark.createDataFrame(xy, "x int, y int")).first().tau
    assert got == pytest.approx(diff / root if root else 0)


@FEW
@given(pairs)
def test_krippendorff(spark, rows):
    got = ag.krippendorff(spark.createDataFrame(rows, "item int, rating int")).first().alpha
    inside = [(a[1] - b[1]) ** 2 for a, b in combinations(rows, 2) if a[0] == b[0]]
    every = [(a[1] - b[1]) ** 2 for a, b in combinations(rows, 2)]
    de = sum(every) / len(every)
    assert got == pytest.approx(1 - (sum(inside) / max(len(inside), 1)) / de if de else 1)


@FEW
@given(counts, st.integers(2, 5))
def test_bradford_zones(spark, ns, zones):
    order = sorted(((n, f"s{i:02}") for i, n in enumerate(ns)), key=lambda x: (-x[0], x[1]))
    want, running, zone, target = {}, 0, 1, sum(ns) / zones
    for n, name in order:
        want[name] = zone
        running += n
        if running >= target * zone and zone < zones:
            zone += 1
    rows = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(ns)], "item string, n int")
    assert {r["item"]: r.zone for r in laws.bradford_zones(rows, zones).collect()} == want


@FEW
@given(counts)
def test_gini_and_running_sums(spark, ns):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(ns)], "item string, n int")
    x = sorted(ns)
    total = [sum(x[: i + 1]) for i in range(len(x))]
    assert laws.gini(rows).first().gini == pytest.approx((len(x) + 1 - 2 * sum(total) / total[-1]) / len(x))
    got = sorted((r.i, r.running, r.total) for r in ranks.running(rows, [rows["n"], rows["item"]], "n").collect())
    assert got == [(i + 1, t, total[-1]) for i, t in enumerate(total)]
