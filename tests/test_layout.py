"""The spring layout against plain loops, its determinism, and labels."""

import math
import random

import pytest

from scimap.operators import graphs, layout

CELL = layout.CELL


def plain_round(places, edges, far, crowd):
    cell = lambda p: (math.floor(p[0] / CELL), math.floor(p[1] / CELL))
    cells = {}
    for n, p in places.items():
        cells.setdefault(cell(p), []).append(n)
    out = {}
    top = max((w for *_, w in edges), default=1)
    for n, (x, y) in places.items():
        fx = fy = 0.0
        cx, cy = cell((x, y))
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                own = cells.get((cx + i, cy + j), [])
                if len(own) > crowd:
                    pushers = [(None, len(own), sum(places[m][0] for m in own) / len(own), sum(places[m][1] for m in own) / len(own))]
                else:
                    pushers = [(m, 1, *places[m]) for m in own if m != n]
                for m, mass, bx, by in pushers:
                    dx, dy = x - bx, y - by
                    if dx == dy == 0:
                        dx = 0.0 if m is None else -1e-3 if n < m else 1e-3
                    square = max(1e-6, dx * dx + dy * dy)
                    if square < CELL * CELL:
                        fx, fy = fx + mass / square * dx, fy + mass / square * dy
        for a, b, w in edges:
            if n in (a, b) and a != b:
                bx, by = places[b if a == n else a]
                pull = (1 + w / top) / 2 * math.hypot(bx - x, by - y)
                fx, fy = fx + pull * (bx - x), fy + pull * (by - y)
        f = math.hypot(fx, fy)
        step = min(f, far) / f if f > 0 else 0.0
        out[n] = (round(x + fx * step, 9), round(y + fy * step, 9))
    return out


@pytest.mark.parametrize("crowd", [32, 2])
def test_rounds_equal_plain_loops(spark, crowd):
    r = random.Random(1)
    edges = [(a, b, r.randint(1, 9)) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.1]
    df, nodes = spark.createDataFrame(edges, "src int, dst int, weight int"), spark.range(30).selectExpr("CAST(id AS INT) AS node")
    start = {p.node: (p.x, p.y) for p in layout.spring(nodes, df, rounds=0, crowd=crowd).collect()}
    want = start
    for i in range(3):
        want = plain_round(want, edges, math.sqrt(30) / 10 * (1 - i / 3), crowd)
    got = {p.node: (p.x, p.y) for p in layout.spring(nodes, df, rounds=3, crowd=crowd).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-5) for n in want)
    again = {p.node: (p.x, p.y) for p in layout.spring(nodes.repartition(7), df.repartition(5), rounds=3, crowd=crowd).collect()}
    assert again == got


def test_neighbours_are_nearer(spark):
    edges = spark.createDataFrame([(a + c, b + c, 1) for c in (0, 10) for a in range(6) for b in range(a + 1, 6)] + [(0, 10, 1)], "src int, dst int, weight int")
    places = {p.node: (p.x, p.y) for p in layout.spring(graphs.endpoints(edges), edges, rounds=12).collect()}
    assert all(math.isfinite(v) for p in places.values() for v in p) and len(set(places.values())) == 12
    mean = lambda pairs: sum(math.dist(places[a], places[b]) for a, b in pairs) / len(pairs)
    inside = [(a + c, b + c) for c in (0, 10) for a in range(6) for b in range(a)]
    assert mean(inside) < 0.6 * mean([(a, b + 10) for a in range(6) for b in range(6)])
    empty = edges.where("false")
    assert layout.spring(graphs.endpoints(empty), empty).count() == 0


def test_shown_labels_cover_none(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(-5, 5), r.uniform(-2, 2), r.randint(1, 4)) for i in range(150)]
    got = layout.shown_labels(spark.createDataFrame(rows, "node int, x double, y double, n int")).collect()
    shown = [p for p in got if p.shown]
    assert len(got) == 150 and 10 < len(shown) < 150
    assert not [1 for a in shown for b in shown if a.node < b.node and abs(a.x - b.x) < 1.5 and abs(a.y - b.y) < 0.3]
    best = min(got, key=lambda p: (-p.n, p.node))
    assert best.shown
