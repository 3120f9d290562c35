import os
import random
import re
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq

from millrace.functions.text import PUNCTUATION
from millrace.plans import registry, rollout_queries, text_queries  # noqa: F401


def test_discounted_return_has_no_horizon(spark, tmp_path):
    r, at = random.Random(6), datetime(2024, 1, 1)
    users = {1: 3000, 2: 33, 3: 32, 4: 1}
    events = [(i, at + timedelta(seconds=r.randrange(2000)), u, round(r.uniform(-1, 5), 3)) for i, u in enumerate(u for u, n in users.items() for _ in range(n))]
    r.shuffle(events)
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {(x.user_id, x.step): x.future for x in registry.QUERIES["discounted_return"](spark, str(tmp_path)).collect()}
    want = {}
    for u in users:
        own = [v for _, _, v in sorted((ts, i, v) for i, ts, w, v in events if w == u)]
        want |= {(u, k): sum(v * 0.9**j for j, v in enumerate(own[k:])) for k in range(len(own))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_qa_exact_match_reads_every_language(spark, tmp_path, data):
    rows = [(i, x.text, x.lang) for i, x in enumerate(spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect())]
    rows += [(1001, "L'Été à la plage: the A-team, an Ärger!", "fr"), (1002, "Una  niña\ta ¿qué?", "es"), (1003, "The Straße", None), (1004, "the", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    bare = lambda x: " ".join(re.sub(r"\b(a|an|the)\b", " ", x.lower().translate(str.maketrans("", "", PUNCTUATION))).split())
    got = {x.doc_id: (x.normal, x.self_match) for x in registry.QUERIES["qa_exact_match"](spark, str(tmp_path)).collect()}
    assert {x[2] for x in rows} >= {"en", "de", "fr", "es", None}
    assert got == {i: (bare(x), True) for i, x, _ in rows}


def test_stream_tumbling_loses_no_row_of_many_files(spark, tmp_path, data):
    whole = pq.read_table(f"{data}/events.parquet").sort_by([("ts", "descending")])
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(5):
        part = folder / f"part-{k}.parquet"
        pq.write_table(whole.slice(k * 200, 200), part)
        os.utime(part, (1_700_000_000 + 60 * k,) * 2)
    got = registry.QUERIES["stream_tumbling"](spark, str(tmp_path)).select("start", "event_type", "n", "total").collect()
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
        want = con.execute(f"SELECT start, event_type, n, total FROM ({registry.ORACLES['stream_tumbling']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
