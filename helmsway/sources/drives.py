"""Readers of a recorded drive's folder: images, sweeps, motion, times, calibration, labels.

Files are found and read by Spark's file sources; Python only decodes their bytes, in batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.functions.boxes import luma
from helmsway.operators.sequences import with_previous

#: Places of the fields used among the 30 of a motion record.
MOTION_FIELDS = {"vf": 8, "vl": 9, "yaw_rate": 22}


def frame_number(path: Column, ext: str) -> Column:
    """Number of a frame from its file's name, exactly ten digits; null for any other name."""
    digits = F.regexp_extract(path, rf"(?:^|/)(\d{{10}})\.{ext}$", 1)
    return F.when(digits != "", digits).cast("bigint")


def timestamp_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of ``2011-09-26 13:02:25.964389445`` (UTC, up to nine digits); null if malformed."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$")
    whole = F.unix_seconds(F.to_timestamp(F.left(text, F.lit(19)), "yyyy-MM-dd HH:mm:ss")) * 1_000_000_000
    part = F.rpad(F.regexp_extract(text, r"\.(\d+)$", 1), 9, "0").cast("bigint")
    return F.when(ok, whole + part)


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ``at_ns``) of a file with one time a line; a blank line is an absent frame and keeps its number."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("seq", "line"))
    return lines.select(F.col("seq").cast("bigint").alias("seq"), timestamp_ns(F.trim("line")).alias("at_ns"))


def frame_index(files: DataFrame, times: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(seq, path, at_ns, ``fault``): files (path, seq) merged with times (seq, at_ns), both ways.

    ``fault`` is null, bad_name, file_without_time, time_without_file, file_past_end or not_increasing.
    """
    named = files.where(F.col("seq").isNotNull())
    last = times.agg(F.max("seq")).first()[0]
    both = named.join(times, "seq", "full_outer").where(F.col("path").isNotNull() | F.col("at_ns").isNotNull()).withColumn("_one", F.lit(1))
    before = with_previous(both.where(F.col("at_ns").isNotNull()), ["_one"], "seq", "_prev", chunk).select("seq", "_prev")
    prior = times.select(F.col("seq").alias("_prev"), F.col("at_ns").alias("_before"))
    merged = both.join(before, "seq", "left").join(prior, "_prev", "left")
    fault = (
        F.when(F.col("path").isNotNull() & (F.col("seq") > F.lit(last)), "file_past_end").when(F.col("at_ns").isNull(), "file_without_time").when(F.col("path").isNull(), "time_without_file").when(F.col("at_ns") <= F.col("_before"), "not_increasing")
    )
    bad = files.where(F.col("seq").isNull()).select(F.lit(None).cast("bigint").alias("seq"), "path", F.lit(None).cast("bigint").alias("at_ns"), F.lit("bad_name").alias("fault"))
    return merged.select("seq", "path", "at_ns", fault.alias("fault")).unionByName(bad)


def list_files(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """(path, seq, bytes) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", frame_number(F.col("path"), ext).alias("seq"), F.col("length").alias("bytes"))


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of an 8-bit RGB image without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, size = 8, b"", None
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + length
    if size is None or size[2:4] != (8, 2) or size[6]:
        raise ValueError("not 8-bit RGB")
    width, height = size[:2]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    out = np.zeros((height, 3 * width), np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros_like(line)
        if kind == 1:
            line = line.reshape(-1, 3).cumsum(axis=0).ravel() % 256
        elif kind == 2:
            line = (line + up) % 256
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - 3] if x > 2 else 0), up[x], (up[x - 3] if x > 2 else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (line[x] + guess) % 256
        out[y] = line
    return out.reshape(height, width, 3)


def read_camera(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, width, height, pixels, mean_luma, error) of a folder of PNG images, one row per file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for seq, data in zip(pdf["seq"], pdf["content"]):
                try:
                    p = decode_png(data)
                    out.append((seq, p.shape[1], p.shape[0], p.tobytes(), float(luma(p).mean()), None))
                except (ValueError, zlib.error, struct.error) as e:
                    out.append((seq, None, None, None, None, f"decode_error: {e}"))
            yield pd.DataFrame(out, columns=["seq", "width", "height", "pixels", "mean_luma", "error"])

    files = spark.read.format("binaryFile").load(folder).select(frame_number(F.col("path"), "png").alias("seq"), "content")
    return files.where(F.col("seq").isNotNull()).mapInPandas(run, "seq bigint, width bigint, height bigint, pixels binary, mean_luma double, error string")


def read_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, idx, x, y, z, r) of a folder of sweeps, files of little-endian 32-bit floats, four a point.

    A file whose size is no whole number of points gives one row with null ``idx``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for seq, data in zip(pdf["seq"], pdf["content"]):
                if len(data) % 16:
                    yield pd.DataFrame({"seq": [seq], "idx": [None], "x": [None], "y": [None], "z": [None], "r": [None]})
                    continue
                p = np.frombuffer(data, "<f4").reshape(-1, 4)
                yield pd.DataFrame({"seq": seq, "idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "r": p[:, 3]})

    files = spark.read.format("binaryFile").load(folder).select(frame_number(F.col("path"), "bin").alias("seq"), "content")
    return files.where(F.col("seq").isNotNull()).mapInPandas(run, "seq bigint, idx bigint, x float, y float, z float, r float")


def sweep_times(start: DataFrame, trigger: DataFrame, end: DataFrame) -> DataFrame:
    """(seq, tov_start_ns, trigger_ns, tov_end_ns, ``fault``) of three time tables; a sweep is due at its end.

    ``fault``: blanks_differ, end_not_after_start, or null.
    """
    one = lambda df, name: df.withColumnRenamed("at_ns", name)
    all_ = one(start, "tov_start_ns").join(one(trigger, "trigger_ns"), "seq", "full_outer").join(one(end, "tov_end_ns"), "seq", "full_outer")
    given = sum((F.col(c).isNotNull().cast("int") for c in ("tov_start_ns", "trigger_ns", "tov_end_ns")), F.lit(0))
    fault = F.when(~given.isin(0, 3), "blanks_differ").when(F.col("tov_end_ns") <= F.col("tov_start_ns"), "end_not_after_start")
    return all_.select("seq", "tov_start_ns", "trigger_ns", "tov_end_ns", fault.alias("fault"))


def read_motion(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, fields, vf, vl, yaw_rate, ``fault``) of a folder of motion records, 30 numbers in a text file."""
    text = spark.read.text(folder, wholetext=True).select(frame_number(F.col("_metadata.file_path"), "txt").alias("seq"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("parts"))
    fields = F.transform("parts", lambda p: p.try_cast("double"))
    rows = text.where(F.col("seq").isNotNull()).select("seq", "parts", fields.alias("fields"))
    bad = F.exists("fields", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fault = F.when(F.size("parts") != 30, "wrong_count").when(bad, "not_finite")
    return rows.select("seq", "fields", *[F.when(fault.isNull(), F.get("fields", F.lit(i))).alias(n) for n, i in MOTION_FIELDS.items()], fault.alias("fault"))


def read_calibration(path: str) -> dict[str, list[float]]:
    """The ``key: numbers`` lines of a calibration file (a few lines; read on the driver)."""
    out = {}
    for line in Path(path).read_text().splitlines():
        key, _, rest = line.partition(":")
        try:
            out[key.strip()] = [float(v) for v in rest.split()]
        except ValueError:
            continue
    return out


def camera_matrix(velo_to_cam: dict[str, list[float]], cam_to_cam: dict[str, list[float]], camera: str) -> list[list[float]]:
    """The 3x4 matrix from sensor to image coordinates: projection, rectification and rigid motion composed.

    Raises ValueError if a key has the wrong number of values or a rotation isn't one (within 1e-6).
    """

    def take(src: dict, key: str, shape: tuple[int, int]) -> np.ndarray:
        if len(src.get(key, [])) != shape[0] * shape[1]:
            raise ValueError(f"{key}: {shape[0] * shape[1]} numbers expected")
        return np.array(src[key]).reshape(shape)

    def rotation(src: dict, key: str) -> np.ndarray:
        m = take(src, key, (3, 3))
        if np.abs(m @ m.T - np.eye(3)).max() > 1e-6 or abs(np.linalg.det(m) - 1) > 1e-6:
            raise ValueError(f"{key}: not a rotation")
        return m

    rigid, rect = np.eye(4), np.eye(4)
    rigid[:3, :3], rigid[:3, 3] = rotation(velo_to_cam, "R"), take(velo_to_cam, "T", (3, 1))[:, 0]
    rect[:3, :3] = rotation(cam_to_cam, "R_rect_00")
    return (take(cam_to_cam, f"P_rect_{camera}", (3, 4)) @ rect @ rigid).tolist()


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """(frame, type, l, w, h, x, y, z, yaw, occlusion, truncation) of labelled objects in an XML file."""
    pose = "array<struct<tx double, ty double, tz double, rz double, occlusion int, truncation int>>"
    schema = f"objectType string, h double, w double, l double, first_frame bigint, poses struct<item {pose}>"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).where(F.col("objectType").isNotNull())
    poses = items.select("objectType", "l", "w", "h", "first_frame", F.posexplode("poses.item").alias("k", "p"))
    return poses.select(
        (F.col("first_frame") + F.col("k")).alias("frame"), F.col("objectType").alias("type"), "l", "w", "h", F.col("p.tx").alias("x"), F.col("p.ty").alias("y"), F.col("p.tz").alias("z"), F.col("p.rz").alias("yaw"), "p.occlusion", "p.truncation"
    )


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow stream files, of the given schema."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["content"]:
                for batch in pa.ipc.open_stream(data):
                    yield batch.to_pandas()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of files, to be held against pinned digests."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(date, drive, left, right, sweeps, readings, has_*) of every drive below a root of ``date/drive/sensor/data``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = files.select(*[F.regexp_extract("path", r"/([^/]+)/([^/]+)/([^/]+)/data/[^/]+$", i).alias(n) for i, n in enumerate(("date", "drive", "sensor"), 1)])
    sensors = {"left": "image_02", "right": "image_03", "sweeps": "velodyne_points", "readings": "oxts"}
    tall = parts.where(F.col("drive") != "").groupBy("date", "drive").agg(*[F.count_if(F.col("sensor") == s).alias(n) for n, s in sensors.items()])
    return tall.select("date", "drive", *sensors, *[(F.col(n) > 0).alias(f"has_{n}") for n in sensors]).orderBy("date", "drive")
