import io
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import appended
from millrace.sources.appended import _Appended, append_once, append_stream, drain, line_end, read_appended, tail_json, tail_lines


def test_line_end(monkeypatch):
    monkeypatch.setattr(appended, "LOOK_BYTES", 3)
    r = random.Random(1)
    for _ in range(400):
        data = bytes(r.choice(b"ab\n") for _ in range(r.randrange(1, 30)))
        begin = 0
        cut = r.randrange(len(data) + 1)
        got = line_end(io.BytesIO(data), begin, cut, len(data))
        whole = data[:cut].rfind(b"\n") + 1
        assert got == (whole or data.find(b"\n", cut) + 1)


def test_ranges_give_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "PART_BYTES", 7)
    monkeypatch.setattr(appended, "LOOK_BYTES", 4)
    r = random.Random(2)
    for k in range(60):
        lines = ["x" * r.choice([0, 1, 2, 5, 6, 7, 8, 30]) for _ in range(r.randrange(1, 20))]
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "log").write_text("".join(f"{line}\n" for line in lines) + "no end")
        reader = _Appended({"path": str(tmp_path / f"{k}")})
        start = reader.initialOffset()
        parts = reader.partitions(start, reader.latestOffset())
        rows = [row for p in parts for b in reader.read(p) for row in b.to_pylist()]
        assert [row["value"] for row in rows] == lines
        assert [row["at"] for row in rows] == [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]


def run(spark, folder, out, most=None):
    query = tail_lines(spark, str(folder), ".jsonl", most).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        drain(query)
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_appended_lines_are_read_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    want, r = [], random.Random(3)
    for k in range(4):
        for name in ("a", "b"):
            with open(folder / f"{name}.jsonl", "a") as f:
                for i in range(r.randrange(5, 30)):
                    line = json.dumps({"k": k, "i": i, "s": "é" * r.randrange(20)}, ensure_ascii=False)
                    f.write(line + "\n")
                    want.append(line)
        (folder / "other.txt").write_text("not read\n")
        if k == 2:  # a line that isn't whole waits
            with open(folder / "a.jsonl", "a") as f:
                f.write('{"k": 9,')
        counts = run(spark, folder, tmp_path / "out", 300)
        assert len(counts) > 2 and max(counts) < 25
        assert sorted(x.value for x in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == sorted(want)
        if k == 2:
            with open(folder / "a.jsonl", "a") as f:
                f.write(' "i": 0}\n')
            want.append('{"k": 9, "i": 0}')
    places = spark.read.parquet(f"{tmp_path}/out/rows").groupBy("file", "at").count().where("count > 1")
    assert places.isEmpty()
    (folder / "b.jsonl").write_text("short\n")
    with pytest.raises(Exception, match="shorter"):
        run(spark, folder, tmp_path / "out")


def test_json_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"n": 1}\n\n{"n": 2, "m": 3}\n')
    stream = tail_json(spark, str(tmp_path / "in"), "n long")
    query = stream.writeStream.format("memory").queryName("tailed").start()
    drain(query)
    query.stop()
    assert sorted(x.n for x in spark.table("tailed").collect()) == [1, 2]


def test_a_batch_counts_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "n long, s string"
    assert read_appended(spark, path, schema).count() == 0
    rows = spark.range(100).select(F.col("id").alias("n"), F.lit("a\nb").alias("s")).repartition(3)
    for batch in ("one", "one", "two", "one"):
        append_once(rows, path, batch)
    append_once(rows.limit(0), path, "three")
    out = read_appended(spark, path, schema)
    assert {(x.batch, x["count"]) for x in out.groupBy("batch").count().collect()} == {("one", 100), ("two", 100)}
    assert out.where("s = 'a\nb'").count() == 200
    with pytest.raises(Exception, match="failed on purpose"):
        append_once(rows.select(F.when(F.col("n") == 99, F.raise_error(F.lit("failed on purpose"))).otherwise(F.col("n")).alias("n"), "s"), path, "four")
    assert read_appended(spark, path, schema).count() == 200
    with pytest.raises(Exception, match="name the batch"):
        append_once(rows, path, "")


def test_a_micro_batch_run_twice_leaves_one_copy(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "log")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(str(folder))
    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(folder))
        append_stream(stream, path, "w").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    first = sorted(x.id for x in read_appended(spark, path, "id long").collect())
    assert first == list(range(30))
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died after the sink's commit: the batch is run again
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    run()
    assert sorted(x.id for x in read_appended(spark, path, "id long").collect()) == first
