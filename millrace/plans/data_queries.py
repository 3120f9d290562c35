"""Queries on datasets: shuffling, splitting, batching, pairing, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, preference, retrieval, vector_index
from ..sources.scratch import scratch_folder
from .registry import query


def _numbered(df, *columns):
    """The columns, with places and batches as the integers that the SQL gives."""
    return df.select(*columns, *[F.col(c).cast("int").alias(c) for c in ("rn", "batch_idx", "part") if c in df.columns])


_RN = "CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{s}'), doc_id) AS INT)"


@query(f"SELECT doc_id, rn, CAST((rn - 1) // 32 AS INT) AS batch_idx FROM (SELECT doc_id, {_RN.format(s=3)} AS rn FROM documents) WHERE (rn - 1) // 32 < (SELECT count(*) FROM documents) // 32")
def epoch_shuffle_batches(t):
    return dataset.batches(dataset.with_position(t.documents.select("doc_id"), "doc_id", 3), 32).transform(_numbered, "doc_id")


@query(f"SELECT doc_id, rn, CAST((rn - 1) // 32 AS INT) AS batch_idx FROM (SELECT doc_id, {_RN.format(s=4)} AS rn FROM documents)")
def batch_keep_last(t):
    return dataset.batches(dataset.with_position(t.documents.select("doc_id"), "doc_id", 4), 32, keep_last=True).transform(_numbered, "doc_id")


@query(f"SELECT doc_id, CASE WHEN rn <= least(1024, n // 10) AND n > least(1024, n // 10) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, {_RN.format(s=0)} AS rn, count(*) OVER () AS n FROM documents)")
def train_test_split(t):
    return dataset.train_test_split(t.documents.select("doc_id"), "doc_id", 0).select("doc_id", "split")


@query("SELECT conv_id, CASE WHEN back <= least(n // 5, 100) THEN 'test' ELSE 'train' END AS split FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id DESC) AS back, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))")
def tail_split(t):
    return dataset.tail_split(t.conversations.select("conv_id").distinct(), "conv_id").select("conv_id", "split")


@query(f"SELECT doc_id, CAST((SELECT count(*) FROM range(1, 7) r(j) WHERE CAST(trunc(j * (n / 7.0::DOUBLE)) AS BIGINT) < rn) AS INT) AS part FROM (SELECT doc_id, {_RN.format(s=5)} AS rn, count(*) OVER () AS n FROM documents)")
def balanced_split(t):
    return dataset.balanced_parts(dataset.with_position(t.documents.select("doc_id"), "doc_id", 5), 7).select("doc_id", "part")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':9'), doc_id) AS rn FROM documents) WHERE rn <= 5")
def stratified_sample(t):
    return dataset.stratified_sample(t.documents.select("doc_id", "source"), "doc_id", "source", 5, 9).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':2'), doc_id LIMIT 100")
def uniform_sample(t):
    return dataset.sample_rows(t.documents.select("doc_id"), "doc_id", 100, 2)


_MEMBER = "SELECT doc_id, CAST({i} AS INT) AS dataset_idx, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1) // {b} AS batch_idx, count(*) OVER () // {b} AS n FROM documents WHERE lang = '{l}'"


@query(f"WITH m AS ({_MEMBER.format(i=0, b=8, l='en')} UNION ALL {_MEMBER.format(i=1, b=4, l='fr')} UNION ALL {_MEMBER.format(i=2, b=4, l='de')} UNION ALL {_MEMBER.format(i=3, b=4, l='es')}) SELECT doc_id, dataset_idx, CAST(batch_idx AS INT) AS batch_idx FROM m WHERE batch_idx < (SELECT min(n) FROM m)")
def composite_batches(t):
    docs = t.documents.select("doc_id", "lang")
    return dataset.composite_batches([docs.where(F.col("lang") == x) for x in ("en", "fr", "de", "es")], [8, 4, 4, 4], "doc_id", 1).drop("rn").transform(_numbered, "doc_id", "dataset_idx")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def decontaminate_exact(t):
    return dataset.without(t.documents, t.benchmark, "text").select("doc_id")


@query("SELECT doc_id, CAST(env AS INT) AS env FROM documents, range(4) r(env)")
def group_replication(t):
    return dataset.repeated(t.documents.select("doc_id"), 4, "env")


@query("SELECT doc_id, CASE WHEN rn = 1 THEN source ELSE source || '-' || rn END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)")
def unique_names(t):
    return dataset.unique_names(t.documents.select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_name")


@query("SELECT conv_id AS group_id, CAST(conv_id % 13 AS BIGINT) AS sampled_at_step, (12 - conv_id % 13) > 5 AS requeue FROM (SELECT DISTINCT conv_id FROM conversations)")
def stale_groups(t):
    groups = t.conversations.select(F.col("conv_id").alias("group_id")).distinct().withColumn("sampled_at_step", F.col("group_id") % 13)
    return dataset.fresh(groups, F.lit(12), "sampled_at_step", 5).select("group_id", "sampled_at_step", "requeue")


_RATED = "SELECT d.source, d.doc_id, l.quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"


def _rated(t):
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.join(labels, "doc_id")


@query(f"WITH r AS ({_RATED}) SELECT source, (arg_max(doc_id, quality * 1000000000000 - doc_id)) AS chosen, (arg_min(doc_id, quality * 1000000000000 - doc_id)) AS rejected, max(quality) - min(quality) AS gap FROM r GROUP BY source HAVING count(*) >= 2 AND max(quality) > min(quality)")
def best_vs_worst_pairs(t):
    return preference.best_and_worst(_rated(t), "source", "doc_id", "quality", "doc_id")


@query(f"WITH r AS ({_RATED}), p AS (SELECT source, arg_max(doc_id, quality * 1000000000000 - doc_id) AS a, arg_min(doc_id, quality * 1000000000000 - doc_id) AS b FROM r GROUP BY source HAVING count(*) >= 2 AND max(quality) > min(quality)) SELECT source, a AS completion_a, b AS completion_b, 'A' AS label, FALSE AS swapped FROM p UNION ALL SELECT source, b, a, 'B', TRUE FROM p")
def dpo_swap_augment(t):
    pairs = preference.best_and_worst(_rated(t), "source", "doc_id", "quality", "doc_id").select("source", F.col("chosen").alias("completion_a"), F.col("rejected").alias("completion_b"), F.lit("A").alias("label"))
    return dataset.both_orders(pairs, "completion_a", "completion_b", "label")


@query("SELECT conv_id, side, CASE WHEN (side = 'chosen') = (label = 'A') THEN 'yes' ELSE 'no' END AS reply FROM (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Tie' END AS label FROM (SELECT DISTINCT conv_id FROM conversations)), (VALUES ('chosen'), ('rejected')) s(side)")
def dpo_pairs_tie_is_b(t):
    one = lambda s: F.array(preference.message("assistant", F.lit(s)))
    c = t.conversations.select("conv_id").distinct().withColumns({"prompt_conversation": F.array(preference.message("user", F.lit("?"))), "completion_a": one("yes"), "completion_b": one("no"), "label": F.when(F.col("conv_id") % 3 == 0, "A").when(F.col("conv_id") % 3 == 1, "B").otherwise("Tie")})
    return preference.dpo_pairs(c, "conv_id").select("conv_id", "side", F.element_at("messages", -1)["content"].alias("reply"))


_PLAYERS = "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, n_chars, n_chars % 5 > 0 AS ok FROM documents"
_ENDS = f"WITH p AS ({_PLAYERS}), m AS (SELECT a.source, a.idx AS i, b.idx AS j, sign(a.n_chars - b.n_chars)::DOUBLE AS r FROM p a JOIN p b ON a.source = b.source AND a.idx // 4 = b.idx // 4 AND a.idx < b.idx), e AS (SELECT source, j AS idx, r FROM m UNION ALL SELECT source, i, -r FROM m)"


def _matches(t):
    from pyspark.sql import Window

    players = t.documents.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("bigint").alias("idx"), "n_chars", (F.col("n_chars") % 5 > 0).alias("ok"))
    return players, preference.matchups(players, "source", 4).withColumn("reward_j", preference.shorter_wins("n_chars_i", "n_chars_j"))


@query(f"{_ENDS} SELECT p.source, p.idx, round(sum(r) / count(r), 6) AS win_minus_loss, round(sum(r) / count(r) + p.ok::INT - 1.0, 6) AS reward FROM p LEFT JOIN e USING (source, idx) GROUP BY p.source, p.idx, p.ok")
def tournament(t):
    players, matches = _matches(t)
    out = preference.tournament(matches, players, "source", F.col("ok"))
    return out.select("source", "idx", F.round("win_minus_loss", 6).alias("win_minus_loss"), F.round("reward", 6).alias("reward"))


@query(f"{_ENDS} SELECT round(avg((r - -r + 2) / 4), 6) AS win_rate, round(stddev_pop((r - -r + 2) / 4) / sqrt(count(*)), 6) AS stderr FROM m")
def win_rate_stderr(t):
    _, matches = _matches(t)
    out = preference.win_rate(matches.select(F.col("reward_j").alias("r0"), (-F.col("reward_j")).alias("r1")))
    return out.select(F.round("win_rate", 6).alias("win_rate"), F.round("stderr", 6).alias("stderr"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS neighbour_id, list_cosine_distance(q, embedding::DOUBLE[]) AS d FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, neighbour_id, CAST(rank AS INT) AS rank, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM s) WHERE rank <= 3""")
def knn_top3(t):
    """A search: the queries are the vectors whose id is divisible by 20, held against all vectors."""
    e = t.embeddings
    out = retrieval.top_k(e.where("vec_id % 20 = 0"), e, 3, others_only=True)
    return out.select("query_id", "neighbour_id", "rank", F.round("distance", 4).alias("distance"))


def _indexed(t):
    """An index of all vectors, stored and read back, how many of its lists to probe, and how many candidates to compare exactly: told by 256 of the queries."""
    folder = scratch_folder(t.spark, "vector_index")
    vector_index.build_index(t.embeddings, folder)
    index = vector_index.VectorIndex(t.spark, folder)
    some = t.embeddings.where("vec_id % 20 = 0").orderBy(F.xxhash64("vec_id")).limit(256)
    probes = index.probes_for(t.embeddings, some, 0.99, 3, others_only=True)
    return index, probes, max(32, index.refine_for(t.embeddings, some, probes, 0.99, 3, others_only=True))


@query()
def knn_index_top3(t):
    """The search of ``knn_top3`` through the index: approximate, so without SQL; ``knn_index_recall`` tells how near it comes."""
    index, probes, refine = _indexed(t)
    e = t.embeddings
    out = index.search(e.where("vec_id % 20 = 0"), e, 3, probes, refine, others_only=True)
    return out.select("query_id", "neighbour_id", "rank", F.round("distance", 4).alias("distance"))


@query("""SELECT count(*) AS queries, CAST(sum(there) AS BIGINT) AS there, TRUE AS enough FROM (SELECT vec_id, least(3, (SELECT count(*) - 1 FROM embeddings)) AS there FROM embeddings WHERE vec_id % 20 = 0)""")
def knn_index_recall(t):
    """Of the true neighbours of all queries, whether the index finds 95 in 100."""
    index, probes, refine = _indexed(t)
    e = t.embeddings
    queries = e.where("vec_id % 20 = 0")
    measured = vector_index.recall(index.search(queries, e, 3, probes, refine, others_only=True), retrieval.top_k(queries, e, 3, others_only=True))
    return measured.select("queries", "there", (F.col("recall") >= 0.95).alias("enough"))
