import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.sharding import least_capacity, shard_documents


def brute_capacity(sizes, shards):
    """Least maximum over all contiguous partitions."""
    best = [[0] * (len(sizes) + 1) for _ in range(shards + 1)]
    for n in range(1, len(sizes) + 1):
        best[0][n] = float("inf")
    for k in range(1, shards + 1):
        for n in range(1, len(sizes) + 1):
            best[k][n] = min(max(best[k - 1][m], sum(sizes[m:n])) for m in range(n + 1))
    return best[shards][len(sizes)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(1, 5))
def test_least_capacity(sizes, shards):
    assert least_capacity(sizes, shards) == brute_capacity(sizes, shards)


def check(rows, got, shards):
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in rows), key=repr)
    slots, groups, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        groups[r.text or ""].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(g) == 1 for g in groups.values())
    return load


def test_documents(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(50, 400) + str(i)) for i in range(900)] + [(i, "copy " * 20) for i in range(900, 1000)] + [(None, None), (None, ""), (5, "again"), (5, "again"), (2000, "é" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS shard", "1 AS key", "7 AS _cell").repartition(3)
    out = shard_documents(df, 8)
    assert "key" in out.columns and "_cell" in out.columns
    load = check(rows, out.collect(), 8)
    assert max(load.values()) <= 1.02 * sum(load.values()) / 8


def test_giant_groups_have_a_shard_alone(spark):
    rows = [(i, "giant " * 10) for i in range(400)] + [(1000 + i, f"small {i} " * 5) for i in range(600)]
    load = check(rows, shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect(), 6)
    small = sorted(load.values())[:-1]
    assert len(load) == 6 and max(small) - min(small) <= 0.1 * max(small)


def test_the_cut_is_minimal_over_the_groups(spark):
    import hashlib

    rows = [(i, "y" * (i * 37 % 211)) for i in range(300)]
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.md5(t.encode()).hexdigest()] += len(t) + 8
    load = check(rows, shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect(), 7)
    assert max(load.values()) == least_capacity([sizes[k] for k in sorted(sizes)], 7)


def test_few_and_no_documents(spark):
    few = shard_documents(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 24).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0


def test_the_documents_table_by_brute_force(spark, data):
    import hashlib

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    load = check(rows, shard_documents(docs, 24).collect(), 24)
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    total, alone = sum(sizes.values()), []
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if len(alone) == 23 or size * (24 - len(alone)) < total:
            break
        alone.append(key)
        total -= size
    rest = brute_capacity([sizes[k] for k in sorted(sizes) if k not in alone], 24 - len(alone))
    assert sorted(load.values())[-1 - len(alone)] <= rest and sorted(load.values(), reverse=True)[: len(alone)] == sorted((sizes[k] for k in alone), reverse=True)
    assert max(v for k, v in load.items() if k >= len(alone)) == rest


def test_columns_of_clashing_names_are_replaced_or_stay(spark):
    from millrace.llm.sharding import shard_documents

    rows = [(i if i % 5 else None, f"text {i % 17} " * (i % 9)) for i in range(120)] + [(1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    odd = df.selectExpr("*", "'x' AS shard", "'y' AS slot", "1 AS key", "2 AS n", "3 AS rows", "'z' AS law")
    out = shard_documents(odd, shards=4)
    assert out.columns == ["doc_id", "text", "key", "n", "rows", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    named = lambda d: sorted(str((r.doc_id, r.text, r["size"], r.shard)) for r in d.collect())
    assert named(out) == named(shard_documents(df, shards=4))
    for k in range(4):
        slots = sorted(r.slot for r in out.where(f"shard = {k}").collect())
        assert slots == list(range(len(slots)))
