import random

import pytest

from millrace.llm.ngram_join import ngram_jaccard_join


def brute(rows, n, percent):
    """(doc_id, set size, least doc_id reachable) of every row."""
    import re

    sets = []
    for _, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, n, percent, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "1 AS rid", "'x' AS gram", "2 AS n", "3 AS root", "4 AS component_id")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, n, percent).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(60):  # a group whose members are linked through others
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(60)] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(r.choice(vocabulary[:6]) for _ in range(r.randrange(12))) for _ in range(60)]
    texts += ["", None, None, "  ", "One two", "one TWO ", "a b c d", "é É", "É é", texts[0], texts[0].upper(), "x " * 3000]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "alone in the world here"), (-5, texts[2])]
    for n, percent in ((4, 85), (5, 80)):
        assert joined(spark, rows, n, percent, extra=n == 4) == brute(rows, n, percent)


def test_hot_texts_and_grams_are_joined_as_well(spark, monkeypatch):
    import millrace.llm._skew as skew
    import millrace.llm.ngram_join as m

    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    for name, value in (("BROADCAST_TEXTS", 0), ("BLOCK", 4), ("BUCKET", 2), ("FIRSTS", 2)):
        monkeypatch.setattr(m, name, value)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(50)]
    texts = []
    for _ in range(50):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(50)] = f"w{r.randrange(500)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts + texts[:1] * 20 + [" ".join(f"v{r.randrange(40)}" for _ in range(30)) for _ in range(20)]))
    assert joined(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_very_long_texts(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    near = list(long)
    for _ in range(900):
        near[r.randrange(len(near))] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:20_000])), (4, "short text of few words")]
    assert joined(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_empty_table(spark):
    assert joined(spark, [], 5, 80) == []


def test_pipeline_stage_keeps_one_of_each_group(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text.upper(), "en", "t", 1), (4, None, "en", "t", 0), (5, "", None, None, 0), (6, "something else altogether", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.ngram_join(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_shared_rows_are_the_same_in_parts(spark, monkeypatch):
    from millrace.llm import ngram_join

    rows = [(k, 40, k * 11, k * 13, -k, k << 40, [k * 1000003 + j * 7919 for j in range(12)], list(range(k % 12))) for k in range(30)]
    schema = f"rid long, n int, {', '.join(f'{c} long' for c in ngram_join.SKETCH)}, prefix array<long>, shared array<int>"
    texts = spark.createDataFrame(rows, schema).coalesce(1)
    whole = sorted(map(str, ngram_join._shared_rows(texts).collect()))
    monkeypatch.setattr(ngram_join, "PLACES", 5)
    assert len(whole) == sum(k % 12 for k in range(30)) and sorted(map(str, ngram_join._shared_rows(texts).collect())) == whole
