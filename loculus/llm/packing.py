"""Best-fit packing: token sequences of one length filled by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import light, prefix_sums, read_table, write_table
from loculus.llm.tokens import KEPT_WORDS, tokenizer_path, word_ids

CAPACITY, END = 2048, 0
#: How far the search goes in all: dead ends, and steps, those within fillings among them. The best packing found so far stands in any case.
NODES, STEPS = 2000, 400_000


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row's ids and its end id."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, kept)
        last = np.array([end], "<u4").tobytes()
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            doc, piece, start, length, crc = [], [], [], [], []
            flat, bounds = words.encode_many(b.column(1))
            for i in range(b.num_rows):
                ids = flat[bounds[i] : bounds[i + 1]].tobytes() + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(light(cut), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer: the total, and for each k the items above capacity - k, alone, with those of k and more."""
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    for k in [0, *(s for s in counts if s <= capacity // 2)]:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        room = sum((capacity - s) * n for s, n in half)
        rest = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over sizes with their counts: (items, how many such bins)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(items: tuple[int, ...], n: int, room: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((items, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                per = min(capacity // size, left)
                put((size,) * per, left // per, capacity - per * size)
                left -= left // per * per
                continue
            room = rooms[k]
            items, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            fit = min(room // size, left)
            many = min(n, left // fit)
            put(items + (size,) * fit, many, room - fit * size)
            if n > many:
                put(items, n - many, room)
            left -= fit * many
    return [x for room in open_bins.values() for x in room]


class Effort:
    """Steps that are left to a search."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int, effort: Effort) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill a bin's room from what is left with a waste of at most `most`, those of less waste first.

    sizes: ascending, those with a count. A filling is dominated, and left out, if an item that is left fits into its waste, or if
    one of its items or two of them together could give way to a larger item that is left and fits in their place with the
    waste: whatever then goes elsewhere is no larger. The search's effort alone can end this earlier.
    """

    def left(size: int, items: tuple[int, ...]) -> bool:
        return items.count(size) < counts[size]

    def dominated(items: tuple[int, ...], waste: int) -> bool:
        if any(left(s, items) for s in sizes[: bisect_right(sizes, waste)]):
            return True
        for i, a in enumerate(items):
            if any(left(s, items) for s in sizes[bisect_right(sizes, a) : bisect_right(sizes, a + waste)]):
                return True
            for b in items[i + 1 :]:
                if any(left(s, items) for s in sizes[bisect_left(sizes, a + b) : bisect_right(sizes, a + b + waste)]):
                    return True
        return False

    def exactly(target: int, top: int, items: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not target:
            yield items
            return
        for k in range(bisect_right(sizes, min(target, top)) - 1, -1, -1):
            if not effort.spend():
                return
            if left(sizes[k], items):
                yield from exactly(target - sizes[k], sizes[k], (*items, sizes[k]))

    for waste in range(min(room, most) + 1):
        for items in exactly(room - waste, room, ()):
            if not dominated(items, waste):
                yield items
        if effort.left <= 0:
            return


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS, report: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Packs sizes with their counts into few bins: (items, how many such bins).

    Equal sizes are one kind, so the search sees at most `capacity` kinds however many items there are. Best-fit decreasing is
    the first incumbent. Then, depth first, the largest size left gets its undominated fillings in turn, a filling for as
    many bins as the counts allow and then for one; a branch ends when its waste is more than an incumbent with one bin less
    could have, and best-fit packs what a branch that has got deeper than any before has left. A packing with fewer bins becomes the
    incumbent. The search ends at the lower bound, when all is tried, or after `nodes` dead ends or `steps` steps. report gets
    bins, bound, best_fit, nodes and steps.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bins = first = sum(n for _, n in best)
    floor, total = least_bins(counts, capacity), sum(s * n for s, n in counts.items())
    left, sizes, effort, ends, seen, deepest = dict(counts), sorted(counts), Effort(steps), 0, 0, 0
    path: list[list] = []  # of [choices, filling, times still to try, bins, waste]
    used, waste = 0, 0

    def take(items: tuple[int, ...], n: int) -> None:
        for s in items:
            left[s] -= n
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))

    def give(items: tuple[int, ...], n: int) -> None:
        for s in items:
            if not left[s]:
                insort(sizes, s)
            left[s] += n

    def choices() -> Iterator[tuple[int, ...]]:
        # what a filling may draw on stays as it is now while its branch is gone through
        top, room, own = sizes[-1], dict(left), list(sizes)
        room[top] -= 1
        if not room[top]:
            own.pop()
        most = (bins - 1) * capacity - total - waste
        return ((top, *f) for f in fillings(own, room, capacity - top, most, effort))

    forward = True
    while bins > floor and ends < nodes and effort.spend():
        if forward:
            seen += 1
            if not sizes:
                best, bins = [(p[1], p[3]) for p in path], used
                forward = False
                continue
            if used > deepest:
                deepest = used
                rest = best_fit({s: left[s] for s in sizes}, capacity)
                if used + sum(n for _, n in rest) < bins:
                    best, bins = [*((p[1], p[3]) for p in path), *rest], used + sum(n for _, n in rest)
                    continue
            path.append([choices(), None, [], 0, 0])
        if not path:
            break
        node = path[-1]
        if node[3]:
            give(node[1], node[3])
            used, waste, node[3], node[4] = used - node[3], waste - node[4], 0, 0
        if not node[2]:
            node[1] = next(node[0], None)
            if node[1] is None:
                path.pop()
                forward, ends = False, ends + 1
                continue
            many = min(left[s] // node[1].count(s) for s in set(node[1]))
            node[2] = [1, many] if many > 1 else [1]
        items, many = node[1], node[2].pop()
        lost = (capacity - sum(items)) * many
        # a waste beyond what one bin less would leave cannot improve on the incumbent
        if waste + lost > (bins - 1) * capacity - total:
            forward, ends = False, ends + 1
            continue
        take(items, many)
        node[3], node[4] = many, lost
        used, waste = used + many, waste + lost
        forward = True
    if report is not None:
        report.update(bins=bins, bound=floor, best_fit=first, nodes=seen, steps=steps - max(0, effort.left))
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Only the counts of the at most `capacity` lengths come to the driver, which packs lengths; then each piece takes the
    place that its rank among the pieces of its length has in that packing.
    """
    pieces = write_table(pieces, "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = bin_completion(counts, capacity)
    length, first, per, sequence, offset = [], [], [], [], []
    rank, base = dict.fromkeys(counts, 0), 0
    for items, n in sorted(plan, key=lambda x: (tuple(-s for s in x[0]), x[1])):
        at = 0
        for s in dict.fromkeys(items):
            k = items.count(s)
            length.append(s)
            first.append(rank[s])
            per.append(k)
            sequence.append(base)
            offset.append(at)
            rank[s] += k * n
            at += k * s
        base += n
    order = np.lexsort((first, length))
    length, first, per, sequence, offset = (np.array(x, np.int64)[order] for x in (length, first, per, sequence, offset))
    begin = {int(s): int(np.searchsorted(length, s)) for s in counts}
    end = {int(s): int(np.searchsorted(length, s, "right")) for s in counts}
    ranked = prefix_sums(pieces.withColumn("_one", F.lit(1).cast("long")), "length", ["doc_id", "piece", "ids_crc32"], {"_rank": "_one"}, "packing").drop("_one")
    names = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(b.schema.get_field_index("length")).to_numpy()
            r = b.column(b.schema.get_field_index("_rank")).to_numpy()
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                at[own] = begin[int(s)] + np.searchsorted(first[begin[int(s)] : end[int(s)]], r[own], "right") - 1
            within = r - first[at]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(sequence[at] + within // per[at]), pa.array(offset[at] + within % per[at] * size)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(light(place), f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END, kept: int = KEPT_WORDS) -> DataFrame:
    """Every row of docs as pieces with their places in sequences of at most `capacity` ids. kept: words whose ids a process remembers.

    A null or empty text is its end id alone, a piece of length 1. Rows with one doc_id, or wholly repeated, are packed each
    for itself. Null doc_ids are kept. An empty table gives an empty result. Other columns are left behind.
    """
    return pack(cut_pieces(docs, capacity, tokenizer, end, kept), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
