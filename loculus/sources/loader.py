"""Rows in batches for one consumer: written once as batches of bounded size, then read one after another, the next one ahead."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.session import ensure_checkpoint_dir

BATCHES = "part int, k bigint, n bigint, data binary"


def write_batches(rows: DataFrame, size: int, path: str | None = None) -> str:
    """Writes rows as batches of at most `size` rows each; returns the folder, one in the checkpoint folder where none is given.

    A task packs its own rows in their order, so all but its last batch are full. Each batch is a row of its own row group.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    path = path or f"{ensure_checkpoint_dir(rows.sparkSession)}/batches-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, have = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k]), pa.array([table.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "k", "n", "data"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(size - have, b.num_rows - at)
                held.append(b.slice(at, take))
                have, at = have + take, at + take
                if have == size:
                    yield out()
                    k, held, have = k + 1, [], 0
        if held:
            yield out()

    rows.mapInArrow(pack, BATCHES).write.option("parquet.block.size", 1 << 16).partitionBy("part").parquet(path)
    return path


class BatchLoader:
    """Batches of a folder of write_batches as Arrow tables, in the order of tasks and rows.

    One batch is ahead of the one that is in hand, so two are held at most. `position` is (task, batch) of the next one: a loader that
    is made with it goes on there, in another process too. A part's list of batches, numbers alone, is read when it is reached.
    """

    def __init__(self, spark: SparkSession, path: str, position: tuple[int, int] = (-1, 0)):
        self.rows, self.position = spark.read.schema(BATCHES).parquet(path), tuple(position)

    def numbers(self) -> Iterator[tuple[int, int]]:
        part, k = self.position
        while True:
            own = self.rows.filter((F.col("part") == part) & (F.col("k") >= k)).select("k").sort("k").collect() if part >= 0 else []
            yield from ((part, r["k"]) for r in own)
            part, k = self.rows.filter(F.col("part") > part).agg(F.min("part")).first()[0], 0
            if part is None:
                return

    def load(self, part: int, k: int) -> pa.Table:
        data = self.rows.filter((F.col("part") == part) & (F.col("k") == k)).select("data").first()["data"]
        return pa.ipc.open_stream(pa.BufferReader(bytes(data))).read_all()

    def __iter__(self) -> Iterator[pa.Table]:
        with ThreadPoolExecutor(1) as ahead:
            coming: tuple[tuple[int, int], Future] | None = None
            for number in self.numbers():
                last, coming = coming, (number, ahead.submit(self.load, *number))
                if last:
                    self.position = number
                    yield last[1].result()
                    last = None
            if coming:
                self.position = (coming[0][0], coming[0][1] + 1)
                yield coming[1].result()
