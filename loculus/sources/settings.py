"""Where inputs lie: an environment file, lists of folders, and the manifest of an evaluation. Driver-side and small."""

from __future__ import annotations

import os
import re
from pathlib import Path


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines (export, quotes and # allowed) set where the environment has no such key; what was set."""
    done = {}
    if os.path.isfile(path):
        for line in Path(path).read_text().splitlines():
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
            if m and not line.lstrip().startswith("#") and m[1] not in os.environ:
                done[m[1]] = os.environ[m[1]] = m[2].strip("\"'")
    return done


def split_paths(raw: str | None) -> list[str]:
    """Paths parted by colons, commas or lines."""
    return [p.strip() for p in re.split(r"[:,\n]", raw or "") if p.strip()]


def video_dirs(paths: list[str]) -> list[str]:
    """Folders with videos among candidates and their sub-folders, each once, in order."""
    out: dict[str, None] = {}
    for p in paths:
        if any(Path(p).glob("*.mp4")):
            out[p] = None
        for sub in sorted(Path(p).glob("*")) if os.path.isdir(p) else []:
            if sub.is_dir() and any(sub.glob("*.mp4")):
                out[str(sub)] = None
    return list(out)


def manifest_path(given: str | None, variable: str, default: str) -> str:
    """The path given, else the environment's, else the default, else the first JSON file beside that."""
    for p in (given, os.environ.get(variable), default):
        if p and os.path.isfile(p):
            return p
    found = sorted(Path(default).parent.glob("*.json"))
    if not found:
        raise FileNotFoundError(f"no manifest: {given or os.environ.get(variable) or default}")
    return str(found[0])


def frame_budget(total: int, fps: float, per_second: float = 2.0, most: int = 128) -> int:
    """How many frames of a video are taken: two a second, 8 at least, no more than `most` or there are."""
    return max(8, min(int(total / fps * per_second), most, total))


def frame_at(seconds: float, fps: float, total: int) -> int:
    return max(0, min(int(seconds * fps), total - 1))


def frame_batches(total: int, n: int = 16, size: int = 4):
    """The numbers of n frames spread evenly over a video, `size` at a time."""
    frames = [total - 1 if n > 1 and i == n - 1 else int(i * ((total - 1) / max(n - 1, 1))) for i in range(n)]
    for i in range(0, n, size):
        yield frames[i : i + size]


def newest_run(root: str) -> str:
    """The sub-folder written last that holds logs or detailed results, its own or its workers'; the root without any."""
    kinds = ("gpu*.log", "detailed_results.json", "gpu*/detailed_results.json")
    runs = [p for p in Path(root).iterdir() if p.is_dir() and any(next(p.glob(k), None) for k in kinds)]
    return str(max(runs, key=lambda p: p.stat().st_mtime)) if runs else root


def output_dir(given: str | None, worker: int | None, stamp: str, root: str = "outputs", name: str = "run") -> str:
    """Where a run writes: the folder given, else one for all workers, else one with a time stamp; a worker has its own within it."""
    base = Path(given).expanduser() if given else Path(root) / (name if worker is not None else f"{name}_{stamp}")
    return str(base / f"gpu{worker}" if worker is not None else base)
