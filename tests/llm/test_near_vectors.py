import math

import numpy as np
import pytest

from concourse.llm import near_vectors
from tests.llm import brute

COLUMNS = "vec_id long, embedding array<double>, label string, weight string, first long"


def rows_of(seed=2, dims=24):
    r = np.random.default_rng(seed)
    out, at = [], 0
    for label in ("a", "b", None, "hot"):
        for _ in range(40 if label != "hot" else 150):
            base = r.normal(size=dims)
            for _ in range(int(r.integers(1, 4))):
                out.append((at, (base * r.uniform(0.5, 3) + r.normal(size=dims) * r.choice([0.02, 0.2, 0.3, 0.4])).tolist(), label))
                at += 1
    base = r.normal(size=dims)
    out += [(at + i, (base + r.normal(size=dims) * 0.15).tolist(), "hot") for i in range(120)]  # one large group of near copies
    out += [(2000 + i, out[3][1], out[3][2]) for i in range(5)] + [(3000 + i, out[3][1], "b") for i in range(2)]  # exact copies, also in another label
    bad = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    out += [(4000 + i, e, "a") for i, e in enumerate(bad + bad)]
    out += [(5000, [1e300, 1e300], "a"), (5001, [2e-300, 2e-300], "a"), (5002, [1.0, -1.0], "a"), (5003, [3.0], "a"), (5004, [0.5], "a"), (5005, [-0.0, 1.0], "a"), (5006, [0.0, 1.0], "a")]
    return [(i, e, label, "w", 1) for i, e, label in out]


def expected(rows, threshold=0.93):
    def usable(e):
        return e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    def unit(e):
        e = [x / max(map(abs, e)) for x in e]
        return np.array(e) / math.sqrt(sum(x * x for x in e))

    ok = [(k, unit(r[1]), r[2]) for k, r in enumerate(rows) if r[2] is not None and usable(r[1])]
    links = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[n + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = brute.components(list(range(len(rows))), links)
    least: dict = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[label[k]] = min(least.get(label[k], r[0]), r[0])
    return sorted((str(r[0]), count[k], str(least.get(label[k]))) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile_bytes", [near_vectors.TILE_BYTES, 24 * 8 * 16])
def test_against_all_pairs(spark, tile_bytes):
    rows = rows_of()
    rows += [(7, rows[60][1], "a", "w", 1), (None, rows[61][1], rows[61][2], "w", 1)]  # an id once more, and none
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(5), tile_bytes=tile_bytes).collect()
    want = expected(rows)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert max(w[1] for w in want) > 100 and sum(1 for w in want if w[1]) > 200


def test_pairs_leave_early():
    r = np.random.default_rng(1)
    vectors = r.normal(size=(300, 64))
    axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]
    tile = object.__new__(near_vectors._Tile)
    tile.keys = np.arange(300)
    tile.units = near_vectors.unit(vectors)
    tile.turned = tile.units @ axes
    assert np.allclose((tile.turned**2).sum(axis=1), 1)
    tile.steps = [12, 24]
    tile.rest = [np.sqrt((tile.turned[:, s:] ** 2).sum(axis=1)) for s in tile.steps]
    near = tile.turned[:, :24] @ tile.turned[:, :24].T + np.outer(tile.rest[1], tile.rest[1]) >= 0.93
    assert near.sum() < 0.02 * near.size + 300  # after 24 of 64 coordinates hardly any pair is left
    assert not list(near_vectors.linked_pairs(tile, tile, 0.93, True))


def test_empty_and_unusable_tables(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(1, None, "a", "", 1), (2, [0.0], "a", "", 1), (3, [1.0], None, "", 1)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
