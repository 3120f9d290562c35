import random

import numpy as np

from millrace.llm._store import Scratch
from millrace.llm.quality import ABSTAIN, BELIEF, NO, YES, _first_of_kind, believed, classify, fit_labellers, keep_good, learn_words, sample_table, train_scorer


def corpus(n=700):
    r = random.Random(8)
    v = ["the", "of", "and"] + [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in ("r", "n", "sting", "ment", "tion")]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(v) for _ in range(r.randrange(15, 150))]
        kind = r.random()
        bad, toxic = kind < 0.2, r.random() < 0.15
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "scum", "vexlor", "vexlane", "vexuth"])
        text = " ".join(w).capitalize() + "."
        if kind < 0.05:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind < 0.1:
            text = " ".join(x + r.choice(["***", "$$$"]) for x in w)
        elif kind < 0.15:
            text = " | ".join(w)
        elif kind < 0.2:
            text = " ".join(x for x in w for _ in range(8))
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS quality", "'x' AS keep")
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(d, known).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    should_go = [i for i, q, t in held if not q or t]
    stay = [i for i, q, t in held if q and not t]
    assert sum(not got[i].keep for i in should_go) >= 0.95 * len(should_go)
    assert sum(got[i].keep for i in stay) >= 0.97 * len(stay)


def test_odd_rows(spark):
    docs, labels = corpus(150)
    docs += [(None, "plain words here and there"), (900, None), (901, ""), (0, docs[0][1]), (902, "x" * 50_000), (903, "idiot " * 5)]
    labels += [(None, 0, 1), (900, None, None), (1, 1 - labels[1][1], labels[1][2])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS __mr", "2 AS text_key")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = keep_good(d, given)
    assert kept.columns == d.columns
    scored = classify(d, given).collect()
    assert len(scored) == len(docs) and len({r.keep for r in scored if r.doc_id == 0}) == 1
    assert kept.count() == sum(r.keep for r in scored)
    assert not next(r.keep for r in scored if r.doc_id == 903)


def test_without_labels_and_without_documents(spark):
    docs, _ = corpus(200)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert classify(d, none).count() == 200
    assert classify(d.limit(0), none).count() == 0


def test_expectation_maximisation_finds_accuracies():
    r = random.Random(5)
    counts, right = {}, 0
    truth = []
    for _ in range(4000):
        y = r.random() < 0.3
        votes = [(YES if (y if r.random() < a else not y) else NO) if r.random() < 0.8 else 0 for a in (0.9, 0.8, 0.75, 0.6)]
        p = sum(v * 3**i for i, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
        truth.append((p, y))
    post, chances = fit_labellers(counts, 4, 0.3)
    for k, a in enumerate((0.9, 0.8, 0.75, 0.6)):
        assert abs(chances[0, k, 0] - a) < 0.08 and abs(chances[1, k, 1] - a) < 0.08
    right = sum((post[p] > 0.5) == y for p, y in truth) / len(truth)
    assert right > 0.85


def test_different_rows_with_common_words_all_count():
    r = np.random.Generator(np.random.PCG64(3))
    common = np.arange(40)
    rows = [np.unique(np.concatenate((common, r.integers(100, 1 << 20, 40)))) for _ in range(400)]
    near = [np.unique(np.append(x[:-1], 77)) for x in rows[:50]]
    assert _first_of_kind(rows).all()
    assert _first_of_kind([*rows, *rows]).sum() == 400
    assert _first_of_kind([*rows[:50], *near])[50:].sum() <= 2
    toxic = np.array([YES if i % 8 == 0 else NO for i in range(len(rows))])
    rows = [np.append(x, (1 << 20) - 1 - i // 8 % 10) if t == YES else x for i, (x, t) in enumerate(zip(rows, toxic, strict=True))]
    assert set(range((1 << 20) - 10, 1 << 20)) <= set(learn_words(rows, toxic).tolist())


def plain_em(rows, labellers, prior, given, rounds):
    """The same model, row by row and without patterns."""
    start = believed(labellers, given).tolist()
    chance = start
    for k in range(rounds):
        post = []
        for votes in rows:
            like = [1 - prior, prior]
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    like = [like[c] * chance[c][j][v - 1] for c in (0, 1)]
            post.append(like[1] / sum(like))
        if k == rounds - 1:
            return post, chance
        chance = []
        for c in (0, 1):
            own = []
            for j in range(labellers):
                n = [sum(p if c else 1 - p for p, votes in zip(post, rows, strict=True) if votes[j] == v) for v in (NO, YES)]
                n = [x + (BELIEF * sum(n) + 1) * b for x, b in zip(n, start[c][j], strict=True)]
                own.append([x / sum(n) for x in n])
            chance.append(own)
        prior = min(0.5, max(1e-4, sum(post) / len(rows)))


def test_expectation_maximisation_against_plain_rows():
    r = random.Random(6)
    rows = []
    for _ in range(400):
        y = r.random() < 0.25
        rows.append([r.choice([ABSTAIN, YES if y == (r.random() < a) else NO]) for a in (0.9, 0.7, 0.8)])
    counts = {}
    for v in rows:
        p = sum(x * 3**i for i, x in enumerate(v))
        counts[p] = counts.get(p, 0) + 1
    post, chances = fit_labellers(counts, 3, 0.2, given=2, rounds=12)
    want, known = plain_em(rows, 3, 0.2, 2, 12)
    assert np.allclose([post[sum(x * 3**i for i, x in enumerate(v))] for v in rows], want, atol=1e-9) and np.allclose(chances, known, atol=1e-9)


def test_any_partitioning_gives_the_same_rows(spark):
    docs, labels = corpus(400)
    docs += docs[:20] + [(None, "null id"), (900, None), (5, "another text of the same id"), (6, docs[6][1] + " twice")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    ways = [sorted(map(tuple, classify(x, known, sample=200).collect()), key=repr) for x in (d.repartition(3, "text"), d.repartition(7, "doc_id"), d.coalesce(1))]
    assert ways[0] == ways[1] == ways[2]


def test_held_out_documents_of_the_tables(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).collect()}
    for known, least in ((labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), 0.9), (labels.limit(0), 0.65)):
        kept = {r.doc_id: r.keep for r in classify(docs, known).collect()}
        share = lambda ids: sum(kept[i] for i in ids) / len(ids)
        assert 1 - share([i for i, r in truth.items() if r.toxic]) >= least
        assert 1 - share([i for i, r in truth.items() if not r.quality]) >= 0.95
        assert share([i for i, r in truth.items() if r.quality and not r.toxic]) >= 0.98


def test_sampled_documents_keep_all_their_cells(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    docs = [(i, f"{long} own{i}" if i < 3 else f"short text number {i}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "xxhash64(text) AS text_key").repartition(3)
    given = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, given_q int, given_t int")
    got = lambda size, cells: sorted(len(r.cells) for r in sample_table(d, given, size, cells, Scratch(spark, "sample_test")).collect())
    whole = got(40, 10**9)
    assert len(whole) == 40 and whole[-3] > 35_000
    assert len(got(40, 2 * whole[-1] + 10)) == 2
    assert len(got(40, 1)) == 1 and len(got(5, 10**9)) == 5


def plain_scorer(rows, target, passes=3, rate=0.1, sparse=0.4):
    """The same steps cell by cell, over a dictionary."""
    z, n, bias = {}, {}, 0.0
    weight = lambda c: 0.0 if abs(z.get(c, 0.0)) <= sparse else -(z[c] - np.sign(z[c]) * sparse) * rate / (1 + np.sqrt(n[c]))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            cells = rows[i].tolist()
            w = {c: weight(c) for c in cells}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()) + bias, -30, 30))) - target[i]
            for c in cells:
                step = (np.sqrt(n.get(c, 0.0) + g * g) - np.sqrt(n.get(c, 0.0))) / rate
                z[c] = z.get(c, 0.0) + g - step * w[c]
                n[c] = n.get(c, 0.0) + g * g
            bias -= 0.01 * g
    return {c: weight(c) for c in z if weight(c)}, bias


def test_scorer_against_plain_steps():
    r = np.random.Generator(np.random.PCG64(4))
    rows = [np.unique(r.integers(0, 300, int(r.integers(1, 40)))) for _ in range(120)]
    target = np.array([float(7 in x) * 0.9 for x in rows])
    made = train_scorer(rows, target)
    want, bias = plain_scorer(rows, target)
    assert abs(made.bias - bias) < 1e-9 and made.cells.tolist() == sorted(want)
    assert np.allclose(made.weights, [want[c] for c in made.cells.tolist()], atol=1e-6)
