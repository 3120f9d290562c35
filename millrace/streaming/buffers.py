"""Streams with a memory: a shuffle buffer that mixes rows across micro-batches, and a training clock that sends stale groups back."""

from __future__ import annotations

import contextlib
import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from .streams import ROWS_AT_ONCE, in_order

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that lists and values of a key need; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def _hash(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


class _ShuffleBuffer(StatefulProcessor):
    """Of a lane: the buffer's slots, rows that left it and fill no batch yet, and the epoch, rows seen and batches made so far."""

    def __init__(self, buffer: int, size: int, seed: int, start: tuple[int, int]):
        self.buffer, self.size, self.seed, self.start = buffer, size, seed, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getListState("slots", _longs("item"))
        self.ready = handle.getListState("ready", _longs("item"))
        self.counts = handle.getValueState("counts", _longs("epoch", "seen", "batches"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        lane = int(key[0])
        epoch, seen, batches = map(int, self.counts.get()) if self.counts.exists() else (self.start[0], 0, 0)
        slots, ready = ([int(x[0]) for x in state.get()] for state in (self.slots, self.ready))
        given = in_order(rows, ["epoch", "position", "ends", "item"])
        out = []

        def leaves(item: int) -> None:
            nonlocal batches
            ready.append(item)
            if len(ready) == self.size:
                if (epoch, batches) >= self.start:
                    out.extend((lane, epoch, batches, place, own) for place, own in enumerate(ready))
                batches += 1
                ready.clear()

        def end_epoch(following: int) -> None:
            nonlocal epoch, seen, batches
            for slot in sorted(range(len(slots)), key=lambda s: (_hash(self.seed, epoch, lane, "end", s), s)):
                leaves(slots[slot])
            slots.clear()
            ready.clear()
            epoch, seen, batches = following, 0, 0

        for own_epoch, _, ends, item in (x for lo in range(0, len(given[0]), ROWS_AT_ONCE) for x in zip(*(c[lo : lo + ROWS_AT_ONCE].tolist() for c in given), strict=True)):
            if len(out) >= ROWS_AT_ONCE:
                yield pd.DataFrame(out, columns=["lane", "epoch", "batch_idx", "place", "item"])
                out.clear()
            if own_epoch < epoch:
                if own_epoch < self.start[0]:
                    continue
                raise ValueError(f"a row of epoch {own_epoch} came after its end")
            if own_epoch > epoch:
                end_epoch(own_epoch)
            if ends:
                end_epoch(epoch + 1)
                continue
            if seen < self.buffer:
                slots.append(item)
            else:
                slot = _hash(self.seed, epoch, lane, seen) % self.buffer
                leaves(slots[slot])
                slots[slot] = item
            seen += 1
        for state, held in ((self.slots, slots), (self.ready, ready)):
            state.put([(x,) for x in held]) if held else state.clear()
        self.counts.update((epoch, seen, batches))
        yield pd.DataFrame(out, columns=["lane", "epoch", "batch_idx", "place", "item"])

    def close(self) -> None:
        pass


def shuffle_buffer(stream: DataFrame, item: str, position: str, buffer: int, size: int, seed: int = 0, epoch: Column | int = 0, ends: Column | None = None, lane: Column | None = None, lanes: int = 1, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """(lane, epoch, batch_idx, place, item): batches of ``size`` rows that left a buffer of ``buffer`` rows, in which rows of many micro-batches mix.

    Row n of an epoch and lane, in the order of ``position``, takes the place of a row that md5 of (seed, epoch, lane, n) picks, and that row leaves.
    Where ``ends`` is true an epoch's last row has come: what its buffers hold leaves in an order that (seed, epoch, lane) decides, and rows that fill no batch
    go. Rows of a later epoch end the one before, too; rows of an ended one are an error. Batches are the same however the rows are parted
    into micro-batches, if those come in the order of positions; a query started again from its checkpoint goes on as if it had not stopped.

    ``start`` is an (epoch, batch) to go on from without one: earlier epochs are passed over, and of the first epoch, which is read from its
    begin, batches before that are made but not given. ``lane`` (0 to ``lanes`` - 1; by default from a hash of the item) parts the stream: each has buffer, batches and
    state of its own, in a task of its own. Null items are an error; repeated ones are rows of their own. State is kept in RocksDB (``keyed_state``).
    """
    lane = F.pmod(F.xxhash64(item), F.lit(lanes)) if lane is None else lane
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    missing = F.raise_error(F.lit("a row of the shuffle buffer has no item")).cast("long")
    row = lambda to, end: F.struct(to.cast("long").alias("lane"), epoch.cast("long").alias("epoch"), F.col(position).cast("long").alias("position"), F.lit(end).cast("long").alias("ends"), F.coalesce(F.col(item).cast("long"), missing).alias("item"))
    own = F.array(row(lane, 0))
    if ends is not None:
        own = F.when(ends, F.concat(own, F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda k: row(k, 1)))).otherwise(own)
    rows = stream.select(F.explode(own).alias("r")).select("r.*")
    return rows.groupBy("lane").transformWithStateInPandas(_ShuffleBuffer(buffer, size, seed, tuple(start)), "lane long, epoch long, batch_idx long, place long, item long", "Append", "None")


class _TrainingClock(StatefulProcessor):
    """Of a lane: the training step it has reached, and the fresh groups that wait for the next one."""

    def __init__(self, size: int, most: int, again: bool):
        self.size, self.most, self.again = size, most, again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", _longs("item"))
        self.clock = handle.getValueState("clock", _longs("step"))

    def _passed(self, sampled: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each group of the queue is fresh when it comes, and the step then; ``fresh`` groups have been so before."""
        ok, now = np.zeros(len(sampled), bool), np.empty(len(sampled), np.int64)
        for lo in range(0, len(sampled), ROWS_AT_ONCE):
            for k, own in enumerate(sampled[lo : lo + ROWS_AT_ONCE].tolist(), lo):
                now[k] = step = fresh // self.size
                if step - own <= self.most:
                    ok[k] = True
                    fresh += 1
        return ok, now

    def _rounds(self, now: np.ndarray, fresh: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """What becomes of groups that went back at the steps ``now``, until none is left: (begin, end, times) of stretches in the order in which they are fresh
        at last, and (step, round, begin) of those that go back together in each later round.

        They are sampled at the step at which they went back, so a stretch that went back at one step is fresh up to a place and stale from there: the next round
        has no more stretches than this one, and its cost doesn't depend on how many groups they hold.
        """
        begin = np.flatnonzero(np.diff(now, prepend=-1))
        runs = [(int(now[a]), deque([(int(a), int(b))])) for a, b in zip(begin, [*begin[1:], len(now)], strict=False)]
        taken, went, times = [], [], 1
        while runs:
            following: list[tuple[int, deque]] = []
            for own, pieces in runs:
                room = (own + self.most + 1) * self.size - fresh
                while pieces and room > 0:
                    a, b = pieces.popleft()
                    end = min(b, a + room)
                    if end < b:
                        pieces.appendleft((end, b))
                    taken.append((a, end, times))
                    fresh, room = fresh + end - a, room - (end - a)
                if not pieces:
                    continue
                step = fresh // self.size
                if not following or following[-1][0] != step:
                    following.append((step, pieces))
                    went.append((step, times + 1, pieces[0][0]))
                    continue
                held = following[-1][1]
                if held[-1][1] == pieces[0][0]:
                    pieces[0] = (held.pop()[0], pieces[0][1])
                held.extend(pieces)
            runs, times = following, times + 1
        return taken, went

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        lane, step = int(key[0]), int(self.clock.get()[0]) if self.clock.exists() else 0
        waiting = np.array([int(x[0]) for x in self.waiting.get()], np.int64)
        _, item, sampled = in_order(rows, ["position", "item", "sampled"])
        ok, now = self._passed(sampled, step * self.size + len(waiting))
        back, now = item[~ok], now[~ok]
        fresh, times, went = [waiting, item[ok]], np.ones(len(back), np.int64), []
        if self.again:
            taken, went = self._rounds(now, step * self.size + len(waiting) + int(ok.sum()))
            for a, b, n in taken:
                times[a:b] = n
            fresh += [back[a:b] for a, b, _ in taken]
        trained = np.concatenate(fresh)
        full = len(trained) // self.size
        places = np.arange(full * self.size)
        ends = np.array(went, np.int64).reshape(-1, 3)
        for to, at, place, own, n in (("train", step + places // self.size, places % self.size, trained, None), ("queue", now, np.arange(len(back)), back, times), ("round", ends[:, 0], ends[:, 1], ends[:, 2], None)):
            for lo in range(0, len(at), ROWS_AT_ONCE):
                part = slice(lo, min(lo + ROWS_AT_ONCE, len(at)))
                yield pd.DataFrame({"lane": lane, "goes_to": to, "step": at[part], "place": place[part], "item": own[part], "times": 0 if n is None else n[part]})
        left = trained[full * self.size :].tolist()
        self.waiting.put([(x,) for x in left]) if left else self.waiting.clear()
        self.clock.update((step + full,))

    def close(self) -> None:
        pass


def train_or_queue(stream: DataFrame, item: str, sampled: str, position: str, size: int, most: int, lane: Column | None = None, again: bool = False) -> DataFrame:
    """(lane, goes_to, step, place, item, times): every group goes to the training step whose batch it fills, or back to the queue.

    The clock of a lane is the number of batches of ``size`` groups that it has trained. A group sampled more than ``most`` steps before the
    clock is stale: it goes to the queue at once, with the step at which it is to be sampled anew. Groups of a micro-batch are taken in the order of
    ``position``. What fills no batch waits, over micro-batches and restarts. Null columns are an error.

    With ``again``, stale groups of a micro-batch come again behind its others, sampled at that step and else as they are, until all are fresh. A row to the queue
    then tells the first step, its place among those that went back, and how many ``times`` it went; rows to ``round`` tell the rest: of the groups that went
    back for time ``place``, those from place ``item`` on, up to the next such row, did so at ``step``.
    """
    if again and most < 0:
        raise ValueError("groups that are stale as soon as they are sampled are never trained on")
    lane = F.lit(0) if lane is None else lane
    need = lambda c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit(f"a group has no {c}")).cast("long"))
    rows = stream.select(lane.cast("long").alias("lane"), need(item).alias("item"), need(sampled).alias("sampled"), need(position).alias("position"))
    return rows.groupBy("lane").transformWithStateInPandas(_TrainingClock(size, most, again), "lane long, goes_to string, step long, place long, item long, times long", "Append", "None")


class Stretches:
    """Rows of a table under ``path``, in files of about ``most`` rows that lie in the order of a key, to be streamed file by file as if they arrived so.

    A table's own files are in any order, and one of them may be as large as the table.
    """

    def __init__(self, rows: DataFrame, key: str, path: str, most: int = 1 << 20):
        self.spark, self.path, self.schema, self.times = rows.sparkSession, path, rows.schema, 0
        count = max(1, -(-rows.count() // most))
        rows.repartitionByRange(count, key).sortWithinPartitions(key).write.mode("overwrite").parquet(self._folder())

    def _folder(self) -> str:
        return f"{self.path}/given{self.times}"

    def run(self, build: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
        """What the stream that ``build`` makes of the rows writes, when each file has been given in a micro-batch of its own. The driver renames the files, a call for each."""
        jvm, before = self.spark.sparkContext._jvm, self._folder()
        self.times += 1
        path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        store = path(before).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path(self._folder()))
        made = build(self.spark.readStream.schema(self.schema).parquet(self._folder()))
        with keyed_state(self.spark):
            query = made.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").start()
        try:
            for name in sorted(n for x in store.listStatus(path(before)) if (n := x.getPath().getName()).startswith("part-")):
                if not store.rename(path(f"{before}/{name}"), path(f"{self._folder()}/{name}")):
                    raise OSError(f"{name} can't be moved to {self._folder()}")
                query.processAllAvailable()
        finally:
            query.stop()
        return self.spark.read.schema(made.schema).parquet(f"{out}/out")


class WorkQueue:
    """A folder of groups to train on, that a stream reads and to which it gives stale groups back.

    ``resampled`` turns stale groups (item, sampled: the step now, position, lane) into groups of the same columns, and these go back by way of the folder. By default they come
    back as they are, and then all rounds of what a micro-batch has brought are in that micro-batch: as many rounds as groups go back in the end would else take a micro-batch each.
    Every micro-batch writes under its own number, so one that is run again leaves one copy.
    """

    SCHEMA = "item long, sampled long, position long, lane long"

    def __init__(self, path: str, size: int, most: int, resampled: Callable[[DataFrame], DataFrame] | None = None):
        self.path, self.size, self.most, self.resampled = path, size, most, resampled

    def put(self, groups: DataFrame, name: str) -> None:
        """Append groups (item, sampled, position, lane) under a name of their own."""
        groups.selectExpr("item", "sampled", "position", "lane").write.mode("overwrite").parquet(f"{self.path}/queue/{name}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.where("goes_to = 'train'").drop("goes_to", "times").write.mode("overwrite").parquet(f"{self.path}/trained/batch={number}")
            stale = kept.where("goes_to = 'queue'")
            stale.write.mode("overwrite").parquet(f"{self.path}/stale/batch={number}")
            kept.where("goes_to = 'round'").selectExpr("lane", "step", "place AS nth", "item AS begin").write.mode("overwrite").parquet(f"{self.path}/rounds/batch={number}")
            if self.resampled and not stale.isEmpty():
                self.put(self.resampled(stale.select("item", F.col("step").alias("sampled"), F.col("place").alias("position"), "lane")), f"back-{number:09d}")
        finally:
            kept.unpersist()

    def run(self, spark: SparkSession) -> None:
        """Train until the queue holds no more groups than fill a batch; a run that was stopped is gone on with."""
        with keyed_state(spark):
            stream = spark.readStream.schema(self.SCHEMA).parquet(f"{self.path}/queue/*")
            out = train_or_queue(stream, "item", "sampled", "position", self.size, self.most, F.col("lane"), self.resampled is None)
            query = out.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/checkpoint").start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()

    def trained(self, spark: SparkSession) -> DataFrame:
        """(lane, step, place, item) of all groups that were trained on."""
        return spark.read.parquet(f"{self.path}/trained").drop("batch")

    def stale(self, spark: SparkSession) -> DataFrame:
        """(lane, step, place, item): every time that a group went back. Long where groups go back often: ``times_stale`` has a row for each group."""
        first = spark.read.schema("lane long, step long, place long, item long, times long").parquet(f"{self.path}/stale")
        later = first.where("times > 1").select("batch", "lane", "place", "item", F.explode(F.sequence(F.lit(2).cast("long"), "times")).alias("nth"))
        rounds = spark.read.schema("lane long, step long, nth long, begin long").parquet(f"{self.path}/rounds")
        own = later.join(rounds, ["batch", "lane", "nth"]).where("begin <= place").groupBy("batch", "lane", "nth", "place", "item").agg(F.max_by("step", "begin").alias("step"))
        place = F.row_number().over(Window.partitionBy("batch", "lane", "nth").orderBy("place")) - 1
        return first.select("lane", "step", "place", "item").union(own.select("lane", "step", place.cast("long").alias("place"), "item"))

    def times_stale(self, spark: SparkSession) -> DataFrame:
        """(lane, item, times): how often each group went back, of those that did."""
        return spark.read.parquet(f"{self.path}/stale").groupBy("lane", "item").agg(F.sum("times").alias("times"))
