"""Point clouds from files of several formats, a task a file: scene, x, y, z, r, g, b."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "scene string, x double, y double, z double, r double, g double, b double"
KINDS = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Vertices and colours (0 to 1) of an ASCII or binary PLY file."""
    head, _, body = data.partition(b"end_header\n")
    form, n, props, inside = "", 0, [], False
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside and w[1] != "list":
            props.append((w[2], KINDS[w[1]]))
    if form == "ascii":
        rows = np.array([line.split()[: len(props)] for line in body.decode("ascii").splitlines()[:n]], float).reshape(n, len(props))
        col = {name: rows[:, k] for k, (name, _) in enumerate(props)}
    else:
        t = np.frombuffer(body, np.dtype([(name, (">" if "big" in form else "<") + k) for name, k in props]), n)
        col = {name: t[name].astype(float) for name, _ in props}
    kinds = dict(props)
    colours = [c for c in ("red", "green", "blue") if c in col]
    rgb = np.stack([col[c] / (255.0 if kinds[c].startswith("u1") else 1.0) for c in colours], 1) if len(colours) == 3 else None
    return np.stack([col[c] for c in "xyz"], 1), rgb


def parse_npz(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Points under points or point_cloud, colours under colors or colours."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        pick = lambda *names: next((z[n] for n in names if n in z), None)
        points, colours = pick("points", "point_cloud"), pick("colors", "colours")
    if points is None:
        return np.zeros((0, 3)), None
    if colours is not None and colours.dtype == np.uint8:
        colours = colours / 255.0
    return points.reshape(-1, 3).astype(float), None if colours is None else colours.reshape(-1, colours.shape[-1])[:, :3].astype(float)


class Glb:
    """A binary glTF file: its document, its numbers, and its nodes with the matrices of all above them."""

    def __init__(self, data: bytes):
        magic, _, length = struct.unpack_from("<4sII", data)
        if magic != b"glTF":
            raise ValueError("not a binary glTF file")
        at, chunks = 12, {}
        while at < length:
            size, kind = struct.unpack_from("<I4s", data, at)
            chunks[kind] = data[at + 8 : at + 8 + size]
            at += 8 + size
        self.doc, self.blob = json.loads(chunks[b"JSON"]), chunks.get(b"BIN\x00", b"")

    def accessor(self, i: int) -> np.ndarray:
        width, kind = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}, {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
        a = self.doc["accessors"][i]
        v = self.doc["bufferViews"][a["bufferView"]]
        t, w = np.dtype(kind[a["componentType"]]), width[a["type"]]
        start, step = v.get("byteOffset", 0) + a.get("byteOffset", 0), v.get("byteStride", t.itemsize * w)
        rows = np.lib.stride_tricks.as_strided(np.frombuffer(self.blob, np.uint8)[start:], (a["count"], t.itemsize * w), (step, 1))
        out = np.ascontiguousarray(rows).view(t).reshape(a["count"], w)
        return out / float(np.iinfo(t).max) if t.kind == "u" else out.astype(float)

    @staticmethod
    def own_matrix(node: dict) -> np.ndarray:
        """A node's matrix, or what its scale, turn (x, y, z, w) and shift make."""
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", (0, 0, 0, 1))
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = turn * np.array(node.get("scale", (1, 1, 1)), float), node.get("translation", (0, 0, 0))
        return out

    def nodes(self) -> Iterator[tuple[dict, np.ndarray]]:
        """The nodes of the scene that is shown, each as often as it stands there, with the matrix to the world."""
        scenes, every = self.doc.get("scenes", []), self.doc.get("nodes", [])
        shown = scenes[self.doc.get("scene", 0)].get("nodes", []) if scenes else sorted(set(range(len(every))) - {c for n in every for c in n.get("children", [])})
        todo = [(i, np.eye(4), 0) for i in reversed(shown)]
        while todo:
            i, above, deep = todo.pop()
            if deep > len(every):
                raise ValueError("nodes hold one another")
            world = above @ self.own_matrix(every[i])
            yield every[i], world
            todo += [(c, world, deep + 1) for c in reversed(every[i].get("children", []))]

    def shapes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """mode, places in the world and colours of every primitive that is shown; without nodes, of every mesh as it is."""
        meshes = self.doc.get("meshes", [])
        shown = [(meshes[n["mesh"]], m) for n, m in self.nodes() if "mesh" in n] if self.doc.get("nodes") else [(mesh, np.eye(4)) for mesh in meshes]
        for mesh, m in shown:
            for p in mesh["primitives"]:
                at = self.accessor(p["attributes"]["POSITION"])
                c = p["attributes"].get("COLOR_0")
                yield p.get("mode", 4), at @ m[:3, :3].T + m[:3, 3], self.accessor(c)[:, :3] if c is not None else np.full((len(at), 3), np.nan)


#: Modes of primitives that are lines: the outlines of cameras, not of things.
LINES = (1, 2, 3)


def parse_glb(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Places in the world and colours of all points and surfaces of a binary glTF file."""
    own = [s for s in Glb(data).shapes() if s[0] not in LINES]
    return (np.concatenate([p for _, p, _ in own]), np.concatenate([c for *_, c in own])) if own else (np.zeros((0, 3)), None)


PARSERS = {"glb": parse_glb, "ply": parse_ply, "npz": parse_npz}


def read_clouds(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All files of one kind under a path; a scene is its file's name without its ending. Rows leave a file in parts."""
    parse = PARSERS[kind]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"]):
                p, c = parse(bytes(data))
                scene = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for at in range(0, len(p), 100_000):
                    part = pd.DataFrame(p[at : at + 100_000], columns=["x", "y", "z"]).assign(scene=scene, r=None, g=None, b=None)
                    if c is not None:
                        part[["r", "g", "b"]] = c[at : at + 100_000]
                    yield part[["scene", "x", "y", "z", "r", "g", "b"]].astype({k: float for k in "rgb"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def _of_files(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """Rows that a function makes of each GLB file, with its scene."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"]):
                yield rows(Glb(bytes(data))).assign(scene=name.rsplit("/", 1)[-1].rsplit(".", 1)[0])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """scene, camera, cx, cy, cz and the way it looks fx, fy, fz (a camera looks along its own -z), yfov (null where it has none)."""

    def rows(g: Glb) -> pd.DataFrame:
        out = []
        for k, (n, m) in enumerate((n, m) for n, m in g.nodes() if "camera" in n):
            ahead = m[:3, :3] @ (0.0, 0.0, -1.0)
            out.append((n.get("name", f"camera_{k}"), *m[:3, 3], *(ahead / max(float(np.sqrt(ahead @ ahead)), 1e-12)), g.doc["cameras"][n["camera"]].get("perspective", {}).get("yfov")))
        return pd.DataFrame(out, columns=["camera", "cx", "cy", "cz", "fx", "fy", "fz", "yfov"])

    return _of_files(spark, path, "scene string, camera string, cx double, cy double, cz double, fx double, fy double, fz double, yfov double", rows)


def read_frusta(spark: SparkSession, path: str) -> DataFrame:
    """scene, shape, x, y, z: the corners of outlines of cameras, which clouds leave out."""

    def rows(g: Glb) -> pd.DataFrame:
        own = [p for mode, p, _ in g.shapes() if mode in LINES]
        out = pd.DataFrame(np.concatenate(own) if own else np.zeros((0, 3)), columns=["x", "y", "z"])
        return out.assign(shape=np.repeat(np.arange(len(own)), [len(p) for p in own]) if own else np.zeros(0, int))

    return _of_files(spark, path, "scene string, shape long, x double, y double, z double", rows)


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """The first kind of file there is under a path: glb, then ply, then npz."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind in PARSERS:
        if fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*.{kind}")):
            return read_clouds(spark, path, kind)
    raise FileNotFoundError(f"no {', '.join(PARSERS)} file under {path}")
