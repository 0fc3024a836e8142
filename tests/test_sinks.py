import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import raster
from palimpsest.functions.planes import joined_planes
from palimpsest.sources import actions, files, grouped_csv, png
from palimpsest.spec import DCT, DHASH


class Broken(Exception):
    pass


def plan_of(spark, tmp_path, n, action):
    for i in range(n):
        (tmp_path / f"{i:03}.png").write_text(str(i))
    plan = spark.createDataFrame([(str(tmp_path / f"{i:03}.png"), str(tmp_path / "out" / f"group{i % 3}" / f"{i:03}.png")) for i in range(n)], "source string, target string")
    actions.write_plan(plan, str(tmp_path / "log"), action, ["source"])
    return str(tmp_path / "log")


@pytest.mark.parametrize("action", actions.ACTIONS)
@pytest.mark.parametrize("stop", [0, 4, 7, 19])
def test_a_run_that_broke_goes_on(spark, tmp_path, monkeypatch, action, stop):
    monkeypatch.setattr(actions, "STEP", 5)
    log, acted = plan_of(spark, tmp_path, 20, action), []

    def act(*what):
        actions._act(*what)
        acted.append(what[1])
        if len(acted) == stop + 1:
            raise Broken  # the run ends after the action, before it is noted

    with pytest.raises(Broken):
        actions.run_plan(spark, log, act)
    plan = spark.createDataFrame([("other", "other")], "source string, target string")
    actions.write_plan(plan, log, action, ["source"])  # the plan that is there stays
    assert actions.run_plan(spark, log, act) == [] and actions.done(log) == 20
    assert sorted(acted) == sorted(set(acted)) and len(acted) == 20
    assert actions.run_plan(spark, log, act) == [] and len(acted) == 20
    left = sorted(p for p in os.listdir(tmp_path) if p.endswith(".png"))
    moved = sorted(f for _, _, names in os.walk(tmp_path / "out") for f in names)
    every = [f"{i:03}.png" for i in range(20)]
    assert left == (every if action == "link" else []) and moved == ([] if action == "delete" else every)


def test_actions_that_fail_are_errors_and_the_rest_goes_on(spark, tmp_path):
    log = plan_of(spark, tmp_path, 6, "delete")
    (tmp_path / "002.png").unlink()
    errors = actions.run_plan(spark, log)
    assert [e.filename[-7:] for e in errors] == ["002.png"] and not [p for p in os.listdir(tmp_path) if p.endswith(".png")]


def test_committed_csv(spark, tmp_path):
    folder = str(tmp_path / "csv")
    rows = spark.range(1000).select(F.concat_ws(",", F.col("id"), F.expr("repeat('x,', cast(id % 5 as int))")).alias("value")).repartition(5)
    breaks = rows.withColumn("value", F.when(F.col("value").startswith("700,"), F.raise_error(F.lit("the task is killed half-way"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="half-way"):
        grouped_csv.write_grouped_csv(breaks, folder)
    assert grouped_csv.read_grouped_csv(spark, folder).count() == 0 and not grouped_csv.listed(folder)
    assert not os.path.exists(folder) or not [f for f in os.listdir(folder) if f.endswith(".csv")]
    grouped_csv.write_grouped_csv(rows, folder)
    with pytest.raises(Exception, match="half-way"):
        grouped_csv.write_grouped_csv(breaks, folder, "append")
    back = lambda: sorted(r.value for r in grouped_csv.read_grouped_csv(spark, folder).collect())
    assert back() == sorted(r.value for r in rows.collect())
    grouped_csv.write_grouped_csv(rows.limit(3), folder, "append")
    assert len(back()) == 1003
    grouped_csv.write_grouped_csv(rows.limit(4), folder)
    assert len(back()) == 4


def pictures(tmp_path, n):
    rng = np.random.default_rng(0)
    for i in range(n):
        a = rng.integers(0, 256, (12, 12, 4)).astype(np.uint8) if i % 3 else np.full((12, 12, 4), 200, np.uint8)
        (tmp_path / f"p{i:02}.png").write_bytes(png.encode(a, "rgb"))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_bytes(b"no image")


def test_a_scan_moves_no_bytes(spark, tmp_path, monkeypatch):
    pictures(tmp_path, 12)
    found = files.folder_files(spark, str(tmp_path))
    assert [(r.id, r.path.rsplit("/", 1)[1], r.length) for r in found.orderBy("id").collect()] == [(k, p.name, p.stat().st_size) for k, p in enumerate(sorted(tmp_path.glob("*.png")), 1)]
    plans, kept = [], files.numbered
    monkeypatch.setattr(files, "numbered", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    prints, errors = files.folder_fingerprints(spark, str(tmp_path), DHASH)
    assert "Exchange" not in plans[0] and "content" not in plans[0].split("MapInPandas")[0]
    listed, wrong = files.fingerprints(files.listed(spark, [str(p) for p in sorted(tmp_path.glob("*.png"))]), DHASH)
    words = lambda df: sorted((r.id, r.w0, r.w1) for r in df.collect())
    assert words(prints) == words(listed) and [r.id for r in errors.collect()] == [r.id for r in wrong.collect()] == [1]
    members, _ = api.folder_duplicates(spark, DHASH, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in members.collect()} == {f"p{i:02}.png" for i in range(0, 12, 3)}


@pytest.mark.parametrize("name", [DCT.name, DHASH.name, "other"])
def test_many_rasters_at_once_are_each_alone(name):
    many = np.random.default_rng(3).integers(0, 256, (7, 21, 13, 4)).astype(np.uint8)
    assert [list(map(int, w)) for w in raster.words_of_all(name, many)] == [list(w) for w in zip(*(raster.hashes(name, a) for a in many), strict=True)]
    for f in raster.FILTERS.values():
        for size in ((9, 9), (13, 30), (5, 21), (13, 21)):
            assert np.array_equal(raster.resize(many, *size, f), np.stack([raster.resize(a, *size, f) for a in many]))


def test_planes_saturate(spark):
    luma = spark.createDataFrame([(1, y, x, v) for y in range(2) for x, v in enumerate((0, 255))], "id long, y long, x long, v int")
    for cb, cr, want in ((128, 128, [(0, 0, 0), (255, 255, 255)]), (255, 255, [(178, 0, 225), (255, 121, 255)]), (0, 0, [(0, 135, 0), (76, 255, 29)])):
        chroma = spark.createDataFrame([(1, 0, 0, cb, cr)], "id long, y long, x long, cb int, cr int")
        got = {(r.y, r.x): (r.r, r.g, r.b) for r in joined_planes(luma, chroma, "420").collect()}
        assert got == {(y, x): want[x] for y in range(2) for x in range(2)}
