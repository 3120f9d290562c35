import random
import re

from millrace.llm.decontaminate import alignment, contaminated, decontaminate


def score(item, passage):
    """Smith-Waterman by the textbook."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(item))


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())


def test_alignment_against_the_textbook():
    import numpy as np

    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 15))] for _ in range(2))
        assert abs(alignment(np.array(a), np.array(b))[0] - score(a, b)) < 1e-9


def corpus():
    r = random.Random(4)
    v = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(v) for _ in range(r.randrange(12, 40)))) for i in range(12)]
    docs = []
    for d in range(120):
        text = [r.choice(v) for _ in range(r.randrange(0, 150))]
        if d % 3 == 0:
            copy = items[d % 12][1].split()
            for k in range(d % 4):
                copy[r.randrange(len(copy))] = "changed"
            if d % 5 == 0:
                copy.insert(len(copy) // 2, "put in")
            at = r.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((d, " ".join(text).title() + "."))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1]), (502, items[1][1] + " " + items[1][1])]
    items += [(90, None), (91, "too short"), (92, ""), (3, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS seeds").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(d, b).collect()}
    want = {(i, k): s for i, t in docs for k, q in items if len(words(q or "")) >= 4 and (s := score(words(q), words(t or ""))) >= 0.5}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    clean = decontaminate(d, b)
    assert clean.columns == d.columns
    bad = {t for i, t in docs if any((i, k) in want for k, _ in items)}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, t in docs if t not in bad), key=repr)


def test_bounds_of_broadcasts_and_lists_do_not_change_results(spark, monkeypatch):
    import millrace.llm._skew as skew
    import millrace.llm.decontaminate as m

    docs, items = corpus()
    docs += [(1000 + k, docs[0][1]) for k in range(60)] + [(2000 + k, f"{docs[3][1]} end{k}") for k in range(60)]
    items += [(100 + k, items[k][1]) for k in range(3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda: sorted((r.doc_id, r.item_id, r.score, r.end_word) for r in contaminated(d, b).collect())
    clean = lambda: sorted(r.doc_id for r in decontaminate(d, b).collect())
    whole, left = pairs(), clean()
    assert len(whole) > 150
    for name, value in (("BROADCAST_TEXTS", 0), ("ITEMS_AT_ONCE", 1), ("MOST_BITS", 7)):
        monkeypatch.setattr(m, name, value)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert pairs() == whole and clean() == left


def test_items_of_few_words_are_matched_whole(spark):
    items = spark.createDataFrame([(1, "The of, and"), (2, "one"), (3, "two words"), (4, ""), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the OF and!"), (2, "the of and more"), (3, "one"), (4, "one one"), (5, "words two"), (6, "Two  words"), (None, "one"), (7, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.score, r.end_word) for r in contaminated(docs, items).collect()), key=repr)
    assert got == [(1, 1, 1.0, 3), (3, 2, 1.0, 1), (6, 3, 1.0, 2), (None, 2, 1.0, 1)]
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [2, 4, 5, 7]


def test_items_do_not_add_reads_of_the_documents(spark):
    import millrace.llm.decontaminate as m

    docs, items = corpus()
    assert m.SHARED <= 8
    many = items + [(100 + k, " ".join(f"own{k}x{i}" for i in range(30))) for k in range(300)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(many, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    assert got == {(r.doc_id, r.item_id) for r in contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contaminated(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0


def test_evenly_edited_copies_are_found(spark):
    r = random.Random(11)
    v = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(v) for _ in range(n))) for i, n in enumerate((15, 20, 38, 59))]
    docs = []
    for i, t in items:
        own = t.split()
        for k, every in enumerate((3, 4, 5)):
            docs.append((10 * i + k, " ".join(["x"] * 30 + ["new" if j % every == every - 1 else w for j, w in enumerate(own)] + ["y"] * 30)))
        docs.append((10 * i + 3, " ".join(f"{w} put" for w in own)))
        docs.append((10 * i + 4, " ".join(w for j, w in enumerate(own) if j % 4)))
        for k in range(5, 10):
            docs.append((10 * i + k, " ".join(r.choice(v) if r.random() < 0.25 else w for w in own)))
    got = {(x.doc_id, x.item_id): x.score for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): s for d, t in docs for i, q in items if (s := score(q.split(), t.split())) >= 0.5}
    assert len(want) >= 30
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_very_long_texts(spark):
    docs, items = corpus()
    filler = " ".join(f"f{i}" for i in range(40_000))
    copy = items[2][1].split()
    copy[4:6] = ["changed"]
    rows = [(1, f"{filler} {' '.join(copy)} {filler}"), (2, filler * 2), (3, "")]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 2)}
    assert abs(got[0].score - score(words(items[2][1]), copy)) < 1e-9 and 40_000 < got[0].end_word <= 40_000 + len(copy)


def test_the_tables_against_the_textbook(spark, data):
    """Every pair of the small tables that shares half an item's words, unwindowed."""
    import numpy as np

    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, items).collect()}
    known = [(r.item_id, np.unique(words(r.text), return_inverse=True)) for r in items.collect()]
    want = {}
    for d in docs.collect():
        own = words(d.text)
        for i, (vocabulary, item) in known:
            at = {w: k for k, w in enumerate(vocabulary)}
            passage = np.array([at.get(w, -1) for w in own], np.int64)
            if len(item) >= 4 and (passage >= 0).sum() >= len(item) / 2 and (s := alignment(item, passage)[0]) >= 0.5:
                want[d.doc_id, i] = s
    assert set(got) == set(want) and want and all(abs(got[k] - want[k]) < 1e-9 for k in got)
