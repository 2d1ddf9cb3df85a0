"""Claims, whole folders, versions behind a manifest."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from cohort.operators import features as FE
from cohort.operators import metrics as M
from cohort.plans import jobs
from cohort.sources import publish as PU
from cohort.sources import scan as SC


def model(records):
    return jobs.Model(FE.Scaler(("age",), (1.0,), (2.0,)), M.Centroids((0, 1), ("age",), ((0.0,), (1.0,))), [(0, 1.0, "a"), (1, 2.0, "b")],
                      [(2, 1.0, 0.5, 0.7)], 2, 0.5, 2, 0.5, records, "2001-08-01", centroid_silhouettes={2: 0.6})


def test_claims_at_once_get_different_names(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(lambda _: PU.claim(spark, str(tmp_path), "x"), range(24)))
    assert sorted(names) == sorted(["x", *[f"x_{i}" for i in range(1, 24)]])


def test_landings_at_once(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: SC.land(spark.range(i + 1), str(tmp_path), "in"), range(4)))
    assert len(set(got)) == 4 and sorted(spark.read.parquet(p).count() for p in got) == [1, 2, 3, 4]
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("_staged")]


def test_half_written_folder_never_appears(spark, tmp_path):
    def die(folder):
        spark.range(3).write.parquet(f"{folder}/part")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        PU.put(spark, f"{tmp_path}/t", die)
    assert not PU.exists(spark, f"{tmp_path}/t")
    PU.put(spark, f"{tmp_path}/t", lambda f: spark.range(3).write.parquet(f))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_save_that_dies_leaves_the_old_model(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/model"
    jobs.save(model(10), spark, path)
    monkeypatch.setattr(jobs, "metadata_df", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        jobs.save(model(20), spark, path)
    monkeypatch.undo()
    back = jobs.load(spark, path)
    assert back.total_records == 10 and back.labels == [(0, 1.0, "a"), (1, 2.0, "b")] and back.centroids == model(10).centroids and back.sweep == model(10).sweep and back.centroid_silhouettes == {2: 0.6}
    jobs.save(model(30), spark, path)
    assert jobs.load(spark, path).total_records == 30 and jobs.read_metadata(spark, path).first()["total_records"] == 30
    assert len(PU.versions(spark, path)) == 3
    PU.prune(spark, path)
    assert len(PU.versions(spark, path)) == 1 and jobs.load(spark, path).total_records == 30


def test_missing_model(spark, tmp_path):
    assert PU.current(spark, f"{tmp_path}/none") == f"{tmp_path}/none" and jobs.read_metadata(spark, f"{tmp_path}/none").count() == 0
