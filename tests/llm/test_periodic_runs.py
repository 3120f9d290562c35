import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm.periodic_runs import lyndon_array, most_periodic, periodic_runs, runs_of
from millrace.llm.queries import op11_periodic_runs


def smallest_period(x):
    return next(p for p in range(1, len(x) + 1) if all(a == b for a, b in zip(x, x[p:], strict=False)))


def brute_runs(words, exponent=4, shortest=6):
    """Every stretch that some period has and no neighbour extends, looked for period by period."""
    x = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out = []
    for q in range(1, len(x) // exponent + 1):
        same = np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0]))
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a + q >= max(shortest, exponent * q) and smallest_period(x[a : a + 2 * q].tolist()) == q:
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_array_by_comparing_suffixes():
    r = random.Random(1)
    for _ in range(600):
        x = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(1, 40))]
        after, match = lyndon_array(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert after[i] == j
            if j < len(x):
                m = 0
                while j + m < len(x) and x[i + m] == x[j + m]:
                    m += 1
                assert match[i] == m


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_by_trying_all_periods(exponent):
    r = random.Random(exponent)
    for k in range(500):
        x = [r.randrange(2 + k % 2) for _ in range(r.randrange(60))]
        while r.random() < 0.6 and len(x) < 400:
            a = r.randrange(len(x) + 1)
            x = x[:a] + x[a : a + r.randrange(9)] * r.randrange(2, 7) + x[a:]
        assert runs_of(x, exponent, 2 * exponent) == brute_runs(x, exponent, 2 * exponent)


def test_comparisons_grow_with_the_length():
    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    cost = []
    for k in (6, 8):
        x = [0, 1]
        for c in range(k - 1):
            x = x * 4 + [c % 2 + 2]
        Counted.seen = 0
        lyndon_array([Counted(v) for v in x])
        cost.append(Counted.seen / len(x))
    assert max(cost) < 3


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    """The words of a document as the query takes them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op11_periodic_runs(spark, data).collect()
    assert len(rows) == len(docs) and sum(r.n_runs for r in rows) > 10
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == expected(r.doc_id, docs[r.doc_id])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " x y" * 5000
    texts = [None, "", " \t\x0b ", "a a a a a", "a a a a a a", "\na\ta  a a\ra a\x0ca b", "é é " * 7, "a b " * 4, "a b " * 3 + "a", long, long, "x " * 9 + "y y y y y y"]
    rows = [(i if i % 3 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, n_words int, word int").repartition(3)
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "word", "n_words", "runs", "collapsed"]
    seen = out.withColumn("best", most_periodic()).collect()
    assert len(seen) == len(rows)
    for r in seen:
        words = words_of(r.text)
        runs = brute_runs(words) if r.text != long else [(30_000, 10_000, 2)]
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r.best is None) == (not runs)
    assert periodic_runs(docs.limit(0)).count() == 0
