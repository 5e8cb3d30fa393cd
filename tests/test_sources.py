"""Videos and scenes from files that the tests write themselves."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest

from loculus.sources import clouds, video


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def numbers(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def mp4(sizes: list[int], steps: list[tuple[int, int]], per_chunk: list[int], scale: int = 600, keys: list[int] | None = None, long: bool = False, moov_first: bool = False) -> tuple[bytes, list[bytes]]:
    """A file with a track of sound and one of pictures; returns it and its frames' bytes."""
    frames = [bytes([k % 251]) * s for k, s in enumerate(sizes)]

    def tables(base: int) -> bytes:
        offsets, at, k = [], base, 0
        for n in per_chunk:
            offsets.append(at)
            at += sum(sizes[k : k + n]) + 5  # something stands between chunks
            k += n
        place = full(b"co64", numbers(len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)) if long else full(b"stco", numbers(len(offsets), *offsets))
        same = len(set(sizes)) == 1
        stsc = [(k + 1, n) for k, n in enumerate(per_chunk) if k == 0 or per_chunk[k - 1] != n]
        stbl = box(b"stbl", full(b"stts", numbers(len(steps), *[v for s in steps for v in s])), full(b"stsz", numbers(sizes[0] if same else 0, len(sizes), *([] if same else sizes))), full(b"stsc", numbers(len(stsc), *[v for f, n in stsc for v in (f, n, 1)])), place, *([full(b"stss", numbers(len(keys), *keys))] if keys else []))
        ticks = sum(n * d for n, d in steps)
        mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, scale, ticks), bytes(4), version=1) if long else full(b"mdhd", numbers(0, 0, scale, ticks), bytes(4))
        tkhd = full(b"tkhd", bytes(72), struct.pack(">II", 640 << 16, 480 << 16))
        sound = box(b"trak", full(b"tkhd", bytes(80)), box(b"mdia", full(b"mdhd", numbers(0, 0, 8000, 1), bytes(4)), full(b"hdlr", bytes(4), b"soun", bytes(12))))
        return box(b"moov", full(b"mvhd", bytes(96)), sound, box(b"trak", tkhd, box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", full(b"vmhd", bytes(8)), stbl))))

    body, k = b"", 0
    for n in per_chunk:
        body += b"".join(frames[k : k + n]) + b"-----"
        k += n
    front = box(b"ftyp", b"isom", bytes(4))
    moov = tables(0)
    base = len(front) + (len(moov) if moov_first else 0) + 8
    moov = tables(base)
    return front + (moov + box(b"mdat", body) if moov_first else box(b"mdat", body) + moov), frames


@pytest.fixture
def videos(tmp_path):
    cases = {
        "plain": mp4([10 + k for k in range(50)], [(50, 20)], [7] * 7 + [1]),
        "long": mp4([33] * 40, [(30, 25), (10, 50)], [5, 5, 10, 10, 10], keys=[1, 11, 31], long=True, moov_first=True),
        "sub/one": mp4([9], [(1, 600)], [1]),
    }
    for name, (data, _) in cases.items():
        (tmp_path / f"{name}.mp4").parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.mp4").write_bytes(data)
    (tmp_path / "broken.mp4").write_bytes(cases["plain"][0][:600])
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no video")
    return tmp_path, {str(tmp_path / f"{n}.mp4"): f for n, (_, f) in cases.items()}


def test_frames_of_videos(spark, videos):
    root, frames = videos
    for part in (1 << 20, 150):  # whole files, and files in parts
        df = video.read_frames(spark, [str(root)], data=True, partition_bytes=part)
        rows = df.collect()
        assert (df.rdd.getNumPartitions() > 8) == (part == 150)
        got = {(r["path"], r["frame_idx"]): r for r in rows}
        assert len(rows) == len(got) == 91
        for path, own in frames.items():
            assert [bytes(got[path, k]["data"]) for k in range(len(own))] == own
    long = str(root / "long.mp4")
    assert [k for k in range(40) if got[long, k]["is_key"]] == [0, 10, 30]
    assert [got[long, k]["seconds"] for k in (0, 1, 30, 31)] == pytest.approx([0, 25 / 600, 750 / 600, 800 / 600])
    assert video.read_frames(spark, [str(root)]).filter("data IS NOT NULL").count() == 0
    assert video.read_frames(spark, [str(root / "sub")]).count() == 1 and video.read_frames(spark, [str(root / "note.txt") + ".none"]).count() == 0


def test_what_videos_are_like(spark, videos):
    root, _ = videos
    got = {r["path"].rsplit("/", 1)[-1]: r for r in video.read_videos(spark, [str(root)]).collect()}
    assert {n: r["frames"] for n, r in got.items()} == {"plain.mp4": 50, "long.mp4": 40, "one.mp4": 1, "broken.mp4": 0, "empty.mp4": 0}
    assert got["plain.mp4"]["fps"] == pytest.approx(30.0) and got["long.mp4"]["fps"] == pytest.approx(40 * 600 / 1250)
    assert (got["plain.mp4"]["width"], got["plain.mp4"]["height"], got["long.mp4"]["duration"]) == (640, 480, pytest.approx(1250 / 600))
    assert got["broken.mp4"]["error"] and got["empty.mp4"]["error"] and got["plain.mp4"]["error"] is None


def test_samples_keep_blank_frames(spark, videos):
    """A video that can't be read, or is not there, gives blank frames; a frame cut off at a file's end is blank in its place."""
    root, _ = videos
    data, _ = mp4([20] * 10, [(10, 20)], [10], moov_first=True)
    (root / "cut.mp4").write_bytes(data)
    with (root / "cut.mp4").open("r+b") as f:
        f.truncate(len(data) - 30)  # the last frame and a part of the one before
    index = video.read_videos(spark, [str(root)])
    names = ["plain", "broken", "cut", "missing", "sub/one"]
    samples = spark.createDataFrame([(str(root / f"{n}.mp4"), f"question on {n}") for n in names], "path string, question string")
    got = video.sampled_frames(samples, index, video.read_frames(spark, [str(root)], data=True), 4).orderBy("path", "k").collect()
    of = lambda n: [r for r in got if r["path"].endswith(f"{n}.mp4")]
    assert len(got) == 20 and [r["frame_idx"] for r in of("plain")] == [0, 16, 32, 49] and not any(r["blank"] for r in of("plain"))
    assert [r["seconds"] for r in of("plain")] == pytest.approx([0, 16 / 30, 32 / 30, 49 / 30])
    for n in ("broken", "missing"):
        assert [(r["frame_idx"], r["seconds"], r["blank"]) for r in of(n)] == [(None, 0.0, True)] * 4
    assert [r["frame_idx"] for r in of("sub/one")] == [0] * 4 and len({r["question"] for r in got}) == 5


def glb(doc: dict, blob: bytes) -> bytes:
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def test_glb_nodes_are_composed(spark, tmp_path):
    """A node that is turned and moved within one that is scaled within a matrix; a mesh that two nodes show; cameras as rows."""
    points = np.array([[1, 0, 0], [0, 2, 0], [0, 0, 3]], "<f4")
    lines = np.array([[0, 0, 0], [1, 1, 1]], "<f4")
    half = math.sqrt(0.5)
    doc = {
        "scene": 0, "scenes": [{"nodes": [0, 3]}, {"nodes": [4]}],
        "nodes": [
            {"matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 20, 30, 1], "children": [1]},
            {"scale": [2, 3, 4], "children": [2, 5]},
            {"rotation": [0, 0, half, half], "translation": [1, 1, 1], "mesh": 0},
            {"mesh": 0, "name": "again"},
            {"mesh": 0, "name": "of another scene"},
            {"camera": 0, "name": "eye", "translation": [1, 0, 0]},
        ],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "mode": 0}, {"attributes": {"POSITION": 1}, "mode": 1}]}],
        "cameras": [{"type": "perspective", "perspective": {"yfov": 0.8, "aspectRatio": 1.5, "znear": 0.1}}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5126, "count": 2, "type": "VEC3"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 24}],
    }
    data = glb(doc, points.tobytes() + lines.tobytes())
    got, _ = clouds.parse_glb(data)
    turned = np.array([[0, 1, 0], [-2, 0, 0], [0, 0, 3]], float)  # a quarter turn about z
    want = [(turned + 1) * [2, 3, 4] + [10, 20, 30], points.astype(float)]
    assert got == pytest.approx(np.concatenate(want), abs=1e-6)  # lines are frames of cameras, no points of the scene
    (tmp_path / "room.glb").write_bytes(data)
    cams = clouds.read_cameras(spark, str(tmp_path)).collect()
    assert [(c["scene"], c["camera"], c["yfov"]) for c in cams] == [("room", "eye", 0.8)]
    assert [cams[0][k] for k in ("cx", "cy", "cz")] == pytest.approx([12, 20, 30]) and [cams[0][k] for k in ("fx", "fy", "fz")] == pytest.approx([0, 0, -1])
    frames = clouds.read_frusta(spark, str(tmp_path)).collect()
    assert len(frames) == 4 and {f["shape"] for f in frames} == {0, 1}  # two nodes show the mesh, and each its line
    assert clouds.read_clouds(spark, str(tmp_path), "glb").count() == 6
    flat = {k: v for k, v in doc.items() if k not in ("scene", "scenes", "nodes")}
    assert clouds.parse_glb(glb(flat, points.tobytes() + lines.tobytes()))[0] == pytest.approx(points)
