"""Data sources of our own: pieces of files, staged writing, failed and repeated tasks, mesh text and features."""

import io
import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.sources import formats, readers, writers

REPO = Path(__file__).resolve().parent.parent


def rasters(folder, shapes, dtype="float64"):
    folder.mkdir(exist_ok=True)
    out = {}
    for k, shape in enumerate(shapes):
        out[f"f{k}.npy"] = (np.arange(np.prod(shape)).reshape(shape) * 3 - 7).astype(dtype)
        np.save(folder / f"f{k}.npy", out[f"f{k}.npy"])
    return out


def seen(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith(("_", ".")))


def frame_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_rasters_are_read_whole_however_they_are_cut(spark, tmp_path, split):
    known = rasters(tmp_path / "r", [(5, 3), (40, 7), (1, 1), (0, 4), (3, 0)], "int16")
    (tmp_path / "r" / "_staging-x").mkdir()
    np.save(tmp_path / "r" / "_staging-x" / "lost.npy", np.zeros((2, 2)))
    formats.register_formats(spark)
    df = spark.read.format("npy_pixels").option("split", split).load(str(tmp_path / "r"))
    want = sorted((n, i, j, float(a[i, j])) for n, a in known.items() for i in range(a.shape[0]) for j in range(a.shape[1]))
    assert frame_rows(df) == want
    if split == 64:
        assert df.rdd.getNumPartitions() > 8
    assert frame_rows(df.filter("name = 'f0.npy' AND value > 0")) == [r for r in want if r[0] == "f0.npy" and r[3] > 0]


def test_names_choose_files_before_they_are_read(spark, tmp_path):
    rasters(tmp_path / "r", [(2, 2), (2, 2)])
    (tmp_path / "r" / "broken.npy").write_bytes(b"no raster")
    good = readers.read_pixel_maps(spark, str(tmp_path / "r"), "f*.npy")
    assert good.filter("name = 'f0.npy'").count() == 4 and good.count() == 8 and good.filter("name = 'f1.npy'").count() == 4
    with pytest.raises(Exception):
        readers.read_pixel_maps(spark, str(tmp_path / "r")).count()


def test_files_that_are_no_rasters_are_named(spark, tmp_path):
    (tmp_path / "r").mkdir()
    np.save(tmp_path / "r" / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="cube.npy is no raster"):
        readers.read_pixel_maps(spark, str(tmp_path / "r")).count()


def test_rasters_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    known = {f"a_{k}.npy": rng.normal(size=(k + 1, 6)) for k in range(12)}
    rows = [(n, i, j, float(a[i, j])) for n, a in known.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    pixels = spark.createDataFrame(rows, formats.PIXELS).orderBy(F.rand(3))
    out = tmp_path / "out"
    writers.write_pixel_maps(pixels, str(out))
    assert seen(out) == sorted(known) and all(np.array_equal(np.load(out / n), a) for n, a in known.items())
    with pytest.raises(Exception, match="holds files already"):
        writers.write_pixel_maps(pixels, str(out))
    writers.write_pixel_maps(pixels.filter("name = 'a_3.npy'"), str(out), overwrite=True, dtype="float32")
    assert seen(out) == ["a_3.npy"] and np.load(out / "a_3.npy").dtype == np.float32
    checks = readers.check_pixel_maps(readers.read_pixel_maps(spark, str(out)), 4, 6).first()
    assert checks.shape_ok and checks.finite and checks.any_positive
    writers.write_pixel_maps(pixels.limit(0), str(tmp_path / "none"))
    assert seen(tmp_path / "none") == [] and readers.read_pixel_maps(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("rows", [
    [("a.npy", 0, 0, 1.0), ("a.npy", 0, 0, 2.0)], [("a.npy", 0, 0, 1.0), ("a.npy", 1, 1, 2.0)], [(None, 0, 0, 1.0)], [("../a.npy", 0, 0, 1.0)]])
def test_incomplete_frames_fail_and_leave_nothing(spark, tmp_path, rows):
    good = [("ok.npy", 0, 0, 1.0)]
    with pytest.raises(Exception, match="full rectangle"):
        writers.write_pixel_maps(spark.createDataFrame(good + rows, formats.PIXELS), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").rglob("*")] == []


def test_raster_checks_tell_what_is_wrong(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    for name, a in {"ok": [[1.0, 0]], "zero": [[0.0, -1]], "nan": [[float("nan"), 1]], "inf": [[float("inf"), 1]], "small": [[1.0]]}.items():
        np.save(folder / f"{name}.npy", np.array(a))
    found = {r["name"]: (r["shape_ok"], r["finite"], r["any_positive"]) for r in readers.check_pixel_maps(readers.read_pixel_maps(spark, str(folder)), 1, 2).collect()}
    assert found["ok.npy"] == (True, True, True) and found["zero.npy"] == (True, True, False)
    assert not found["nan.npy"][1] and not found["inf.npy"][1] and not found["small.npy"][0]


RETRY = """
import sys
from pyspark import TaskContext
from atrium.session import build_session
from atrium.sources import formats
spark = build_session(master="local[4, 3]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3"})
spark.sparkContext.setLogLevel("OFF")
formats.register_formats(spark)

def shaky(batches):
    for k, batch in enumerate(batches):
        yield batch
    if TaskContext.get().attemptNumber() < 2 and TaskContext.get().partitionId() % 2:
        raise RuntimeError("lost")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
lines = spark.range(0, 4000, 1, 4).selectExpr("concat('line ', id) AS line").mapInArrow(shaky, "line string")
lines.write.format("ordered_lines").mode("append").save(sys.argv[1])
"""


def test_repeated_tasks_are_committed_once(tmp_path):
    out = tmp_path / "out"
    ran = subprocess.run([sys.executable, "-c", RETRY, str(out)], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert sorted(p.name for p in out.rglob("*")) == ["_SUCCESS", *(f"part-{k:08d}.txt" for k in range(4))]
    assert "".join((out / n).read_text() for n in seen(out)).split("\n")[:-1] == [f"line {k}" for k in range(4000)]


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_lines_are_read_once_wherever_a_file_is_cut(spark, tmp_path, split):
    texts = ["first\nsecond é\n\nlast without end", "\n\n", "", "x" * 120 + "\ny\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"p{k}").write_text(text)
    got = [(r.part, r["at"], r.line) for r in readers.read_lines(spark, str(tmp_path), split).orderBy("part", "at").collect()]
    want = []
    for k, text in enumerate(texts):
        at = 0
        for line in text.encode().split(b"\n")[: None if text and not text.endswith("\n") else -1]:
            want.append((k, at, line.decode()))
            at += len(line) + 1
    assert got == want


def test_long_lines_cross_blocks(spark, tmp_path, monkeypatch):
    (tmp_path / "p").write_text("a" * 3_000_000 + "\n" + "b\n" * 5 + "c" * 2_500_000)
    got = readers.read_lines(spark, str(tmp_path)).orderBy("at").select(F.length("line")).collect()
    assert [r[0] for r in got] == [3_000_000, 1, 1, 1, 1, 1, 2_500_000]


@pytest.mark.parametrize("form, lines", [("ply", writers.ply_lines), ("obj", writers.obj_lines)])
def test_mesh_text_round_trip(spark, tmp_path, form, lines):
    vertices = spark.range(500).selectExpr("id AS vertex_id", "id * 0.25D AS x", "-id / 8D AS y", "CAST(id % 7 AS DOUBLE) AS z", "id * 1D AS r", "-3D AS g", "12.5D AS b")
    triangles = spark.range(300).selectExpr("id AS triangle_id", "id AS v0", "id + 1 AS v1", "id + 99 AS v2")
    writers.write_mesh_rows(lines(vertices, triangles), str(tmp_path / "m"), extension=f".{form}")
    assert len(seen(tmp_path / "m")) > 1
    text = "".join((tmp_path / "m" / n).read_text() for n in seen(tmp_path / "m"))
    (tmp_path / f"one.{form}").write_text(text)
    for path in (tmp_path / "m", tmp_path / f"one.{form}"):  # ordered parts, or one foreign file
        v, f = readers.read_mesh(spark, str(path), form, split=777)
        assert sorted((r.vertex_id, r.x, r.y, r.z) for r in v.collect()) == [(k, k / 4, -k / 8, float(k % 7)) for k in range(500)]
        assert sorted((r.triangle_id, r.v0, r.v1, r.v2) for r in f.collect()) == [(k, k, k + 1, k + 99) for k in range(300)]
    if form == "ply":
        assert [tuple(r) for r in v.filter("vertex_id IN (3, 400)").orderBy("vertex_id").select("r", "g", "b").collect()] == [(3, 0, 12), (255, 0, 12)]


def test_features_are_one_json_document(spark, tmp_path):
    rows = [(f"p{k:03d}", "Point", [float(k), 0.5], k % 3, 'quote " and\nbreak') for k in range(200)]
    df = spark.createDataFrame(rows, "id string, geometry_type string, coordinates array<double>, level int, note string")
    writers.write_features(df, str(tmp_path / "f"))
    doc = json.loads("".join((tmp_path / "f" / n).read_text() for n in seen(tmp_path / "f")))
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == [r[0] for r in rows]
    assert doc["features"][7] == {"type": "Feature", "id": "p007", "geometry": {"type": "Point", "coordinates": [7.0, 0.5]}, "properties": {"level": 1, "note": rows[7][4]}}
    back = readers.read_features(spark, str(tmp_path / "f"), "id string, type string, properties struct<level: int>")
    assert sorted((r.id, r.properties.level) for r in back.collect()) == [(r[0], r[3]) for r in rows]
    writers.write_features(df.limit(0), str(tmp_path / "none"))
    assert json.loads("".join((tmp_path / "none" / n).read_text() for n in seen(tmp_path / "none"))) == {"type": "FeatureCollection", "features": []}


def test_npy_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "BLOCK", 100)
    a = np.arange(600, dtype="uint16").reshape(30, 20)
    buffer = io.BytesIO()
    np.save(buffer, a)
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    reader = formats._PixelReader({"path": str(tmp_path)}, "*.npy")
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 10 and np.array_equal(np.concatenate([b.column("value").to_numpy() for b in batches]), a.ravel())
