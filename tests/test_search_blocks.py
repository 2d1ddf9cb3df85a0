"""The search inside tasks: against brute force, how much of it is looked at, and in what form rows meet the boxes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohort.operators import search as S


def dealt(c, ids, size=64):
    """Boxes, vectors, ranks and ends of blocks of neighbours."""
    order, blocks = np.arange(len(c)), [np.arange(len(c))]
    while max(map(len, blocks)) > size:
        axes = [int(np.ptp(c[b], axis=0).argmax()) for b in blocks]
        blocks = [half for b, j in zip(blocks, axes, strict=True) for half in np.array_split(b[np.argsort(c[b, j], kind="stable")], 2)]
    blocks = [b[np.argsort(ids[b])] for b in blocks]
    order = np.concatenate(blocks)
    boxes = S.Boxes(np.arange(len(blocks), dtype="int32"), np.array([c[b].min(axis=0) for b in blocks]), np.array([c[b].max(axis=0) for b in blocks]))
    return boxes, c[order], S._ranks(pa.array(ids[order])), np.cumsum([len(b) for b in blocks]), order


@pytest.mark.parametrize(("wanted", "farthest"), [(1, False), (2, True)])
def test_all_is_found_in_part_of_the_blocks(monkeypatch, wanted, farthest):
    rng = np.random.default_rng(2)
    c = np.concatenate([rng.normal(size=(4_000, 4)), np.round(rng.normal(size=(300, 4)))])  # some stand in one place
    ids = rng.permutation(len(c)) * 3
    x = np.concatenate([rng.normal(scale=4, size=(500, 4)), c[:20], np.round(rng.normal(size=(100, 4))), [[np.inf, 0, 0, 0]]])
    boxes, v, ranks, ends, order = dealt(c, ids)
    met, visit = [], S.Found.visit
    monkeypatch.setattr(S.Found, "visit", lambda self, rows, x, members, *rest: met.append(len(rows) * len(members)) or visit(self, rows, x, members, *rest))
    monkeypatch.setattr(S, "TABLE", 1 << 13)
    got = S._searched(x, boxes, v, ranks, ends, wanted, farthest)
    d2 = np.zeros((len(x), len(c)))
    for j in range(4):
        d2 += (x[:, j, None] - c[:, j]) ** 2
    first = [min(np.flatnonzero(row == row.min()), key=lambda i: ids[i]) for row in d2]
    assert order[got.at].tolist() == first and got.best.tolist() == d2.min(axis=1).tolist()
    if wanted > 1:
        assert got.second.tolist() == np.sort(d2, axis=1)[:, 1].tolist()
    if farthest:
        assert got.far.tolist() == d2.max(axis=1).tolist()
    assert sum(met) < 0.4 * d2.size


@pytest.mark.parametrize("way", [S.CARRIED_BYTES, 0])
def test_rows_meet_boxes_in_batches(spark, way):
    rng = np.random.default_rng(4)
    centres = spark.createDataFrame([(f"s{i:04}", v.tolist()) for i, v in enumerate(rng.normal(size=(900, 3)))], "cluster_id string, v array<double>")
    rows = spark.createDataFrame([(i, v.tolist(), {"kept": i}) for i, v in enumerate(rng.normal(size=(40, 3)))], "row_id long, x array<double>, other map<string,int>")
    got = S.nearest(rows, centres, F.col("x"), facts=True, carried_bytes=way)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("ArrowEvalPython" in text or "CoGroups" in text) and "arrays_zip" not in text  # no box is unpacked for each row
    c, x = (np.array([r[n] for r in t.collect()]) for t, n in ((centres, "v"), (rows, "x")))
    d = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
    found = got.orderBy("row_id").collect()
    assert [r["cluster_id"] for r in found] == [f"s{i:04}" for i in d.argmin(axis=1)] and [r["other"]["kept"] for r in found] == list(range(40))
    np.testing.assert_allclose([[r["min_dist"], r["second_dist"], r["max_dist"]] for r in found], np.column_stack([np.sort(d, axis=1)[:, :2], d.max(axis=1)]))
