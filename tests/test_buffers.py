import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.plans import registry, rollout_queries, stream_queries  # noqa: F401
from millrace.streaming import streams
from millrace.streaming.buffers import Stretches, WorkQueue, keyed_state, shuffle_buffer

from oracle import assert_same


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def by_window(items, buffer, size, seed, epoch, lane):
    """Batches told without a buffer: row n pushes out the row that had its slot last."""
    last, out = {}, []
    for n, item in enumerate(items):
        slot = n if n < buffer else number(seed, epoch, lane, n) % buffer
        if slot in last:
            out.append(last[slot])
        last[slot] = item
    out += [last[s] for s in sorted(last, key=lambda s: (number(seed, epoch, lane, "end", s), s))]
    return [(lane, epoch, k // size, k % size, x) for k, x in enumerate(out[: len(out) // size * size])]


def feed(spark, folder, splits):
    for k, rows in enumerate(splits):
        spark.createDataFrame(rows, "epoch long, n long, item long, ends boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in{k:03d}")


def run(spark, folder, out, **options):
    with keyed_state(spark):
        stream = spark.readStream.schema("epoch long, n long, item long, ends boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        made = shuffle_buffer(stream, "item", "n", 7, 4, seed=3, epoch=F.col("epoch"), ends=F.col("ends"), lane=F.col("item") % 2, lanes=2, **options)
        writer = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").select("lane", "epoch", "batch_idx", "place", "item").collect())


ROWS = [(e, n, 100 * e + n, n == 59) for e in (0, 1) for n in range(60)]
WANT = sorted(x for e in (0, 1) for lane in (0, 1) for x in by_window([i for ep, _, i, _ in ROWS if ep == e and i % 2 == lane], 7, 4, 3, e, lane))


def test_any_split_gives_the_same_batches(spark, tmp_path):
    for name, cuts in (("a", [0, 120]), ("b", [0, 5, 6, 40, 61, 90, 120])):
        feed(spark, tmp_path / name / "in", [ROWS[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        assert run(spark, tmp_path / name / "in", tmp_path / name) == WANT
    assert len(WANT) == 4 * 28 and [x[4] for x in WANT if x[:2] == (0, 0)] != sorted(x[4] for x in WANT if x[:2] == (0, 0))


def test_a_run_that_stops_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    feed(spark, folder, [ROWS[:33], ROWS[33:70]])
    part = run(spark, folder, tmp_path / "out")
    assert part and len(part) < len(WANT) and set(part) <= set(WANT)
    feed(spark, tmp_path / "more", [ROWS[70:]])
    (tmp_path / "more" / "in000").rename(folder / "in9")
    assert run(spark, folder, tmp_path / "out") == WANT
    # from a checkpoint row, without the state of the first run
    for start in ((0, 2), (1, 0), (1, 5)):
        assert run(spark, folder, tmp_path / f"from{start}", start=start) == [x for x in WANT if (x[1], x[2]) >= start]


def test_rows_of_an_ended_epoch_are_an_error(spark, tmp_path):
    feed(spark, tmp_path / "in", [ROWS[60:], ROWS[:60]])
    with pytest.raises(Exception, match="after its end"):
        run(spark, tmp_path / "in", tmp_path)


def simulate(groups, size, most):
    """The queue taken one group at a time."""
    queue, fresh, back = list(groups), [], defaultdict(int)
    for item, sampled in queue:
        step = len(fresh) // size
        if step - sampled > most:
            back[item] += 1
            queue.append((item, step))
        else:
            fresh.append(item)
    whole = len(fresh) // size * size
    return {x: k // size for k, x in enumerate(fresh[:whole])}, back


def test_stale_groups_come_back_until_they_are_trained(spark, tmp_path):
    groups = [(k, k // 9) for k in range(200)]
    want, back = simulate(groups, 4, 2)
    assert sum(back.values()) > 50 and max(back.values()) > 1
    queue = WorkQueue(str(tmp_path / "q"), 4, 2)
    queue.put(spark.createDataFrame([(i, s, i, 0) for i, s in groups[:120]], WorkQueue.SCHEMA), "first")
    queue.put(spark.createDataFrame([(i, s, i, 0) for i, s in groups[120:]], WorkQueue.SCHEMA), "second")
    queue.run(spark)
    rows = queue.trained(spark).collect()
    assert {r.item: r.step for r in rows} == want and len(rows) == len(want) == 200
    counts = {r.item: r.n for r in queue.stale(spark).groupBy("item").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: v for k, v in back.items() if v}
    queue.run(spark)  # nothing is left; a second run changes nothing
    assert queue.trained(spark).count() == 200
    # three more: they wait, then are trained with the next
    for name, more in (("third", range(200, 203)), ("fourth", range(203, 204))):
        queue.put(spark.createDataFrame([(i, 10**6, i, 0) for i in more], WorkQueue.SCHEMA), name)
        queue.run(spark)
    assert queue.trained(spark).count() == 204


def test_rounds_of_stale_groups_take_few_micro_batches(spark, tmp_path):
    groups = [(k, k // 5 + k % 3) for k in range(600)]
    queue, fresh, back = [*groups], [], []
    for item, sampled in queue:
        step = len(fresh) // 4
        if step - sampled > 2:
            back.append((step, item))
            queue.append((item, step))
        else:
            fresh.append(item)
    own = WorkQueue(str(tmp_path / "q"), 4, 2)
    own.put(spark.createDataFrame([(i, s, i, 0) for i, s in groups], WorkQueue.SCHEMA), "first")
    own.run(spark)
    # the queue goes round ten times; a micro-batch for each round took minutes on larger tables
    assert max(sum(i == item for _, i in back) for item, _ in groups) >= 10
    assert len(list((tmp_path / "q" / "trained").glob("batch=*"))) == 1
    assert {(r.step, r.place): r.item for r in own.trained(spark).collect()} == {(k // 4, k % 4): x for k, x in enumerate(fresh)}
    assert sorted((r.step, r.item) for r in own.stale(spark).collect()) == sorted(back)
    assert {r.item: r.times for r in own.times_stale(spark).collect()} == {i: n for i, n in simulate(groups, 4, 2)[1].items() if n}
    # groups that a function samples anew go by way of the folder, with the same result where it changes nothing
    other = WorkQueue(str(tmp_path / "r"), 4, 2, lambda rows: rows)
    other.put(spark.createDataFrame([(i, s, i, 0) for i, s in groups[:60]], WorkQueue.SCHEMA), "first")
    other.run(spark)
    want, times = simulate(groups[:60], 4, 2)
    assert {r.item: r.step for r in other.trained(spark).collect()} == want
    assert {r.item: r.times for r in other.times_stale(spark).collect()} == {i: n for i, n in times.items() if n}


@pytest.fixture()
def small_frames(spark):
    """Rows reach Python in frames of seven."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 7)
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("valid_only", [False, True])
def test_minibatches_are_in_order_over_several_frames(spark, tmp_path, small_frames, valid_only):
    rows = [((k * 37) % 101, (k * 37) % 101 % 3 > 0) for k in range(101)]
    spark.createDataFrame(rows, "item long, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        stream = spark.readStream.schema("item long, ok boolean").parquet(str(tmp_path / "in"))
        made = streams.minibatches(stream, "item", 8, valid="ok", valid_only=valid_only)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want, batch, number, count = [], [], 0, 0
    for item in range(101):
        batch.append(item)
        count += item % 3 > 0 or not valid_only
        if count == 8:
            want += [(number, x) for x in batch if x % 3]
            number, batch, count = number + 1, [], 0
    assert sorted((r.batch_idx, r.item) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


@pytest.mark.parametrize("name", ["stream_minibatch", "stream_valid_minibatch", "stream_shuffle_buffer"])
def test_files_in_another_order_than_their_rows(spark, data, tmp_path, small_frames, name):
    events = spark.read.parquet(f"{data}/events.parquet")
    # the later half arrives first, and neither lies in order
    for part, which in (("b", "event_id >= 500"), ("a", "event_id < 500")):
        events.where(which).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{part}")
    spark.read.parquet(f"{tmp_path}/b").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{tmp_path}/a").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    own = registry.QUERIES[name](spark, str(tmp_path))
    assert_same(own, registry.ORACLES[name], data)


def test_stretches_come_one_by_one_and_again(spark, tmp_path):
    given = Stretches(spark.range(1000).select((999 - F.col("id")).alias("item")).repartition(5), "item", str(tmp_path / "rows"), 300)
    for k in range(2):
        made = given.run(lambda s: streams.minibatches(s, "item", 10), str(tmp_path / f"out{k}"))
        assert sorted((r.batch_idx, r.item) for r in made.collect()) == [(i // 10, i) for i in range(1000)]
        # a micro-batch for each of four files
        assert len(list((tmp_path / f"out{k}" / "state" / "commits").glob("[0-9]*"))) == 4
