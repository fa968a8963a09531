"""Readers and writers on a small drive laid out on disk."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helmsway.sources import drives, sinks

BASE = 1316995200000000000


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b""
    for y in range(h):  # a row of each filter in turn
        kind, line, up = y % 3, pixels[y].reshape(-1).astype(int), pixels[y - 1].reshape(-1).astype(int) if y else 0
        left = np.r_[[0, 0, 0], line[:-3]]
        rows += bytes([kind]) + ((line - (0, left, up)[kind]) % 256).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def drive(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    d = root / "2011_09_26" / "2011_09_26_drive_0005_sync"
    for s in ("image_02", "velodyne_points", "oxts"):
        (d / s / "data").mkdir(parents=True)
    for i in (0, 1, 3):
        pixels = np.array([[[i, x, y] for x in range(8)] for y in range(4)], np.uint8)
        (d / "image_02/data" / f"{i:010}.png").write_bytes(png(pixels))
    (d / "image_02/data/0000000009.png").write_bytes(b"broken")
    for i in range(3):
        p = np.array([[j, -j, i, 0.5] for j in range(4 + i)], "<f4")
        (d / "velodyne_points/data" / f"{i:010}.bin").write_bytes(p.tobytes())
        fields = [float(k + i) for k in range(30)]
        (d / "oxts/data" / f"{i:010}.txt").write_text(" ".join(map(str, fields)) + "\n")
    (d / "velodyne_points/data/0000000003.bin").write_bytes(b"12345")
    (d / "oxts/data/0000000003.txt").write_text("1 2 3")
    (d / "oxts/data/0000000004.txt").write_text(" ".join(["nan"] * 30))
    (d / "image_02/timestamps.txt").write_text("2011-09-26 00:00:00.000000001\n2011-09-26 00:00:00.1\n\n2011-09-26 00:00:00.05\n2011-09-26 00:00:01\n")
    return root, str(d)


def test_times(spark, drive):
    got = {r["seq"]: r["at_ns"] for r in drives.read_timestamps(spark, drive[1] + "/image_02/timestamps.txt").collect()}
    assert got == {0: BASE + 1, 1: BASE + 100_000_000, 2: None, 3: BASE + 50_000_000, 4: BASE + 1_000_000_000}


def test_frame_index_names_each_fault(spark, drive):
    files = drives.list_files(spark, drive[1] + "/image_02/data", "png").select("path", "seq")
    files = files.unionByName(spark.createDataFrame([("/x/7.png", None)], "path string, seq bigint"))
    times = drives.read_timestamps(spark, drive[1] + "/image_02/timestamps.txt")
    got = {r["seq"]: r["fault"] for r in drives.frame_index(files, times).collect()}
    assert got == {0: None, 1: None, 3: "not_increasing", 4: "time_without_file", 9: "file_past_end", None: "bad_name"}


def test_camera(spark, drive):
    got = {r["seq"]: r for r in drives.read_camera(spark, drive[1] + "/image_02/data").collect()}
    assert got[3]["width"] == 8 and got[3]["height"] == 4 and got[9]["error"].startswith("decode_error")
    pixels = np.frombuffer(got[3]["pixels"], np.uint8).reshape(4, 8, 3)
    assert (pixels[..., 0] == 3).all() and (pixels[2, :, 1] == np.arange(8)).all() and (pixels[3, :, 2] == 3).all()


def test_sweeps(spark, drive):
    p = drives.read_sweeps(spark, drive[1] + "/velodyne_points/data")
    got = p.groupBy("seq").agg(F.count("idx").alias("n"), F.min("y").alias("y"), F.max("z").alias("z")).orderBy("seq").collect()
    assert [(r["seq"], r["n"], r["y"], r["z"]) for r in got] == [(0, 4, -3.0, 0.0), (1, 5, -4.0, 1.0), (2, 6, -5.0, 2.0), (3, 0, None, None)]


def test_sweep_times(spark):
    t = lambda rows: spark.createDataFrame(rows, "seq bigint, at_ns bigint")
    got = drives.sweep_times(t([(0, 1), (1, 5), (2, None)]), t([(0, 2), (1, 6), (2, None)]), t([(0, 3), (1, 5), (2, 9)]))
    assert {r["seq"]: r["fault"] for r in got.collect()} == {0: None, 1: "end_not_after_start", 2: "blanks_differ"}


def test_motion(spark, drive):
    got = {r["seq"]: (r["vf"], r["vl"], r["yaw_rate"], r["fault"]) for r in drives.read_motion(spark, drive[1] + "/oxts/data").collect()}
    assert got == {0: (8.0, 9.0, 22.0, None), 1: (9.0, 10.0, 23.0, None), 2: (10.0, 11.0, 24.0, None), 3: (None, None, None, "wrong_count"), 4: (None, None, None, "not_finite")}


def test_calibration(tmp_path):
    (tmp_path / "c").write_text("calib_time: 09-Jan-2012 13:57:47\nR: 0 -1 0 0 0 -1 1 0 0\nT: 0 0 0\n")
    velo = drives.read_calibration(str(tmp_path / "c"))
    cam = {"R_rect_00": [1.0, 0, 0, 0, 1, 0, 0, 0, 1], "P_rect_02": [700.0, 0, 600, 0, 0, 700, 180, 0, 0, 0, 1, 0]}
    p = np.array(drives.camera_matrix(velo, cam, "02"))
    a, b, w = p @ [10.0, 0.0, 0.0, 1.0]
    assert (a / w, b / w, w) == (600.0, 180.0, 10.0)
    with pytest.raises(ValueError):
        drives.camera_matrix({"R": [2.0, 0, 0, 0, 1, 0, 0, 0, 1], "T": [0, 0, 0]}, cam, "02")
    with pytest.raises(ValueError):
        drives.camera_matrix({"R": [1.0], "T": [0, 0, 0]}, cam, "02")


def test_catalogue_and_digests(spark, drive):
    r = drives.catalogue(spark, str(drive[0])).collect()
    assert [(x["drive"][-9:], x["left"], x["right"], x["sweeps"], x["readings"], x["has_right"]) for x in r] == [("0005_sync", 4, 0, 4, 5, False)]
    assert all(len(x["sha256"]) == 64 for x in drives.file_digests(spark, drive[1] + "/oxts/data").collect())


def test_tracklets(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        "<boost><tracklets><item><objectType>Car</objectType><h>1.5</h><w>1.6</w><l>4.0</l><first_frame>7</first_frame><poses><count>2</count>"
        "<item><tx>1</tx><ty>2</ty><tz>3</tz><rx>0</rx><ry>0</ry><rz>0.5</rz><occlusion>0</occlusion><truncation>1</truncation></item>"
        "<item><tx>2</tx><ty>2</ty><tz>3</tz><rx>0</rx><ry>0</ry><rz>0.5</rz><occlusion>1</occlusion><truncation>1</truncation></item></poses></item></tracklets></boost>"
    )
    got = drives.read_tracklets(spark, str(tmp_path / "t.xml")).orderBy("frame").collect()
    assert [(r["frame"], r["type"], r["x"], r["occlusion"]) for r in got] == [(7, "Car", 1.0, 0), (8, "Car", 2.0, 1)]


def test_arrow_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n bigint, t string")
    for i, r in enumerate(sinks.arrow_streams(df).collect()):
        (tmp_path / f"{i}.arrows").write_bytes(r["content"])
    got = drives.read_arrow(spark, str(tmp_path), "n bigint, t string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "b")]
    assert pa.ipc.open_stream(sinks.arrow_streams(spark.range(9).where("id > rand() + 100")).first()["content"]).read_all().num_rows == 0


def test_run_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n bigint, t string")
    sinks.write_run(str(tmp_path / "run"), {"evidence": df}, df)
    assert spark.read.parquet(str(tmp_path / "run/evidence.parquet")).collect() == df.collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "run/evidence.csv")).columns == ["n", "t"]
    assert spark.read.text(str(tmp_path / "run/summary.json")).first()[0] == '{"n":1,"t":"a"}' and (tmp_path / "run/_COMPLETE").exists()
    assert "n t" in " ".join(sinks.console(df).split())
