"""Ordered scans evaluate their input once: scans of each source in the plans that ran, and results on skewed tracks."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from concourse.operators import linear as ln
from concourse.operators import ordered as od
from concourse.plans import load_all

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def scans_that_ran(df) -> dict[str, int]:
    """Scans of each parquet table, those behind a reused exchange counted once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    found: dict[str, int] = {}
    for name in re.findall(r"FileScan parquet .*?([a-z]+)\.parquet", plan):
        found[name] = found.get(name, 0) + 1
    return found


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize(
    "key, most",
    [
        ("win_turn_angle", 1), ("win_ring_close_dedupe", 1), ("win_merge_continue", 1), ("win_label_triplet", 1), ("win_cumulative_arc", 1),
        ("win_ring_segments", 1), ("win_cut_intervals", 1), ("agg_polyline_length", 1), ("agg_polygon_area", 1), ("lrs_duration", 1),
        ("lrs_point_at", 2), ("lrs_clip_prefix", 2),  # tracks, and the requests from the same table
    ],
)
def test_each_source_is_read_once(spark, key, most):
    found = scans_that_ran(load_all()[key].build(spark, FOLDER))
    assert found and max(found.values()) <= most


def test_islands_and_neighbours_two_back(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 5 else f"k{i % 3}", i, rng.choice("aab")) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, ord long, v string")
    chunk = od.ordinal_chunk("ord", 7)
    got = od.islands(df, ["key"], ["ord"], chunk, lambda row, before: row["v"] != before["v"], "island")
    got = od.neighbours(got, ["key"], ["ord"], chunk, prev2={"two": "v"}, first={"start": "ord"})
    seen = {(r["key"], r["ord"]): (r["island"], r["two"], r["start"]) for r in got.collect()}
    for key in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == key]
        island = 0
        for n, (_, o, v) in enumerate(of):
            island += n == 0 or of[n - 1][2] != v
            assert seen[key, o] == (island, of[n - 2][2] if n > 1 else None, of[0][1])


def walked(points, t):
    """Point at a fraction and the clipped prefix, segment by segment."""
    seg = [math.dist(a, b) if all(map(math.isfinite, (*a, *b))) else 0.0 for a, b in zip(points, points[1:])]
    total = sum(seg)
    target, done, shown = total * t, 0.0, [points[0]]
    point = None
    for a, b, s in zip(points, points[1:], seg):
        if s > 0 and point is None and (target <= done + s):
            r = (target - done) / s
            point = (a[0] + (b[0] - a[0]) * r, a[1] + (b[1] - a[1]) * r)
        if s > 0 and target >= done + s:
            shown.append(b)
        elif s > 0 and target > done:
            shown.append(point)
        done += s
    if total == 0:
        point, shown = points[0], [points[0]]
    return point, points if t >= 1 else shown


@pytest.mark.parametrize("stretch", [2, 4096])
def test_many_requests_on_skewed_tracks(spark, monkeypatch, stretch):
    monkeypatch.setattr(ln, "STRETCH_ROWS", stretch)
    rng = random.Random(stretch)
    tracks = {"hot": [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(400)], "flat": [(3.0, 4.0)] * 5, "one": [(1.0, 2.0)]}
    tracks |= {f"k{i}": [(float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(rng.randint(2, 9))] for i in range(20)}
    vertices = [(k, i, x, y) for k, of in tracks.items() for i, (x, y) in enumerate(of)]
    asked = [(k, f"{k}-{n}", rng.choice([0.0, 1.0, -1.0, 2.0, None, rng.random(), rng.random()])) for k in tracks for n in range(30 if k == "hot" else 4)]
    v = spark.createDataFrame(vertices, "track string, ord long, x double, y double")
    p = spark.createDataFrame(asked, "track string, request_id string, t double")
    chunk = od.ordinal_chunk("ord", 16)
    points = {r["request_id"]: (r["x"], r["y"]) for r in ln.point_at(v, p, "track", chunk=chunk).collect()}
    clips: dict = {}
    for r in ln.clip_track(v, p, "track", chunk=chunk).orderBy("request_id", "ord", "part").collect():
        clips.setdefault(r["request_id"], []).append((r["x"], r["y"]))
    assert set(points) == set(clips) == {r for _, r, _ in asked}
    for k, r, t in asked:
        t = min(1.0, max(0.0, t or 0.0))
        point, shown = walked(tracks[k], t)
        assert points[r] == pytest.approx(point, abs=1e-6)
        assert len(clips[r]) == len(shown)
        assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip(clips[r], shown))
