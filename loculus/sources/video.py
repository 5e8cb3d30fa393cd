"""Videos as tables of frames: a data source that reads the index of MP4 files, and samples of frames with gaps filled.

Nothing is decoded here: a frame is its place in the file, its time, and if asked for its coded bytes; decoders are plug-ins.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loculus.functions.geometry import frame_sample

FRAMES = "path string, frame_idx bigint, seconds double, file_offset bigint, size bigint, is_key boolean, data binary"
VIDEOS = "path string, frames bigint, fps double, width int, height int, duration double, error string"
#: Boxes that hold boxes on the way to a track's tables.
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


@dataclass
class Index:
    """Where a video's frames are: ticks a second, and of each frame its time in ticks, offset, size, and whether it stands alone."""

    scale: int
    width: int
    height: int
    ticks: int
    times: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    @property
    def fps(self) -> float:
        return len(self.sizes) * self.scale / self.ticks if self.ticks else 0.0


def boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, start and end of what is in each box between two places of a file."""
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", f.read(8))[0], at + 16
        stop = at + size if size else end
        if stop > end or stop < start:
            raise ValueError(f"box {kind!r} ends beyond what holds it")
        yield kind, start, stop
        at = stop


def tables(f: BinaryIO, at: int, end: int) -> Iterator[dict[bytes, bytes]]:
    """The tables of each track, by their boxes' kinds; what frames are made of is passed over."""

    def walk(at: int, end: int, found: dict[bytes, bytes]) -> None:
        for kind, start, stop in boxes(f, at, end):
            if kind in HOLDERS:
                walk(start, stop, found)
            elif kind in (b"tkhd", b"mdhd", b"hdlr", b"stts", b"stsz", b"stsc", b"stco", b"co64", b"stss"):
                f.seek(start)
                found[kind] = f.read(stop - start)

    for kind, start, stop in boxes(f, at, end):
        if kind == b"moov":
            for inner, a, b in boxes(f, start, stop):
                if inner == b"trak":
                    found: dict[bytes, bytes] = {}
                    walk(a, b, found)
                    yield found


def read_index(f: BinaryIO, length: int) -> Index:
    """The index of the first track with pictures."""
    track = next((t for t in tables(f, 0, length) if t.get(b"hdlr", b"")[8:12] == b"vide"), None)
    if track is None:
        raise ValueError("no track with pictures")
    numbers = lambda b, at, kind=">u4": np.frombuffer(b, kind, offset=at).astype(np.int64)
    head, place = track[b"mdhd"], 20 if track[b"mdhd"][0] else 12
    scale = struct.unpack_from(">I", head, place)[0]
    width, height = (v >> 16 for v in struct.unpack(">II", track[b"tkhd"][-8:]))
    count, step = numbers(track[b"stts"], 8).reshape(-1, 2).T
    durations = np.repeat(step, count)
    every, n = struct.unpack_from(">II", track[b"stsz"], 4)
    sizes = np.full(n, every, np.int64) if every else numbers(track[b"stsz"], 12)[:n]
    chunks = numbers(track[b"stco"], 8) if b"stco" in track else numbers(track[b"co64"], 8, ">u8")
    first, per, _ = numbers(track[b"stsc"], 8).reshape(-1, 3).T
    many = np.repeat(per, np.diff(np.r_[first, len(chunks) + 1]))
    chunk = np.repeat(np.arange(len(chunks)), many)[:n]
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if n else np.zeros(0, int)
    offsets = chunks[chunk] + before - np.repeat(before[starts], np.diff(np.r_[starts, n])) if n else np.zeros(0, np.int64)
    keys = np.zeros(n, bool)
    keys[numbers(track[b"stss"], 8) - 1 if b"stss" in track else slice(None)] = True
    if len(durations) < n or len(chunk) < n:
        raise ValueError("the index lacks frames")
    return Index(scale, width, height, int(durations[:n].sum()), np.cumsum(durations[:n]) - durations[:n], offsets, sizes, keys)


@dataclass
class Part(InputPartition):
    """A share of one file's frames."""

    path: str
    share: int
    of: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str], videos: bool):
        self.options, self.videos = options, videos

    def files(self) -> list[str]:
        found = []
        for root in filter(None, (p.strip() for p in self.options["path"].split("\n"))):
            root = root.removeprefix("file://")
            found += [root] if os.path.isfile(root) else sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.lower().endswith(".mp4"))
        return list(dict.fromkeys(found))

    def partitions(self) -> list[InputPartition]:
        """Files alone are listed and their sizes asked; a file is shared out by its size, and its index is read where its frames are."""
        most = int(self.options.get("partitionbytes", 128 << 20))
        share = lambda p: 1 if self.videos else max(1, -(-os.path.getsize(p) // most))
        return [Part(p, k, n) for p in self.files() for n in [share(p)] for k in range(n)] or [Part("", 0, 1)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            try:
                index, error = read_index(f, os.path.getsize(part.path)), None
            except (ValueError, KeyError, struct.error, IndexError) as e:
                index, error = None, f"{type(e).__name__}: {e}"
            if self.videos:
                row = [[part.path], [len(index.sizes) if index else 0], [index.fps if index else 0.0], [index.width if index else 0], [index.height if index else 0], [index.ticks / index.scale if index and index.scale else 0.0], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.string()))], names=["path", "frames", "fps", "width", "height", "duration", "error"])
                return
            if index is None:
                return
            with_data, n = self.options.get("data", "false") == "true", len(index.sizes)
            low, high, step = part.share * n // part.of, (part.share + 1) * n // part.of, 64 if with_data else 65_536
            for at in range(low, high, step):
                own = np.arange(at, min(high, at + step))
                data = [self._bytes(f, int(index.offsets[k]), int(index.sizes[k])) if with_data else None for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(own)), pa.array(own), pa.array(index.times[own] / index.scale), pa.array(index.offsets[own]), pa.array(index.sizes[own]), pa.array(index.keys[own]), pa.array(data, pa.binary())], names=["path", "frame_idx", "seconds", "file_offset", "size", "is_key", "data"])

    @staticmethod
    def _bytes(f: BinaryIO, offset: int, size: int) -> bytes | None:
        """A frame's bytes; none where the file ends before."""
        f.seek(offset)
        got = f.read(size)
        return got if len(got) == size else None


class FrameSource(DataSource):
    """Frames of MP4 files. Options: path (files or folders, a line each), data (true: coded bytes, too), partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "mp4frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options, False)


class VideoSource(DataSource):
    """A row for each MP4 file: frames, rate, size, duration, and what is wrong with it if it can't be read."""

    @classmethod
    def name(cls) -> str:
        return "mp4videos"

    def schema(self) -> str:
        return VIDEOS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options, True)


def read_frames(spark: SparkSession, paths: list[str], data: bool = False, partition_bytes: int = 128 << 20) -> DataFrame:
    """Frames of all MP4 files under folders that driver and executors share, in parts of a file; files that can't be read have none."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("mp4frames").option("path", "\n".join(paths)).option("data", str(data).lower()).option("partitionBytes", str(partition_bytes)).load()


def read_videos(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(VideoSource)
    return spark.read.format("mp4videos").option("path", "\n".join(paths)).load()


def sampled_frames(samples: DataFrame, videos: DataFrame, frames: DataFrame, n: int = 16) -> DataFrame:
    """samples (with path) with n frames each, spread evenly over the video: k, frame_idx, seconds, data, blank.

    A sample whose video is missing or can't be read keeps n blank frames at 0 seconds; a frame that can't be read is blank in its place.
    """
    total = videos.filter("frames > 0").select("path", "frames", "fps")
    idx = F.when(F.col("frames").isNotNull(), frame_sample(F.col("frames"), n)).otherwise(F.array_repeat(F.lit(None).cast("int"), n))
    wanted = samples.join(total, "path", "left").select(*samples.columns, "fps", F.posexplode(idx).alias("k", "frame_idx"))
    wanted = wanted.withColumn("seconds", F.coalesce(F.try_divide(F.col("frame_idx"), F.col("fps")), F.lit(0.0))).drop("fps")
    got = frames.select(F.col("path").alias("_p"), F.col("frame_idx").alias("_i"), "data")
    return wanted.join(got, (F.col("path") == F.col("_p")) & (F.col("frame_idx") == F.col("_i")), "left").drop("_p", "_i").withColumn("blank", F.col("data").isNull())
