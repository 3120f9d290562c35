import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm.vector_codes import books_sha256, compress_vectors, cuts, dimension_order, nearest


def test_nearest_by_all_distances():
    r = np.random.Generator(np.random.PCG64(3))
    for k in range(200):
        dim, entries, span = int(r.integers(0, 7)), int(r.integers(1, 70)), int(r.choice([2, 5, 4000]))
        book = r.integers(-span, span, (entries, dim))
        rows = np.vstack([r.integers(-span, span, (int(r.integers(0, 90)), dim)), book[:3]])
        far = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        which, best = nearest(rows, book)
        assert (which == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_dimensions_by_falling_variance():
    book = np.array([[0, 5, 1, 0], [0, -5, 2, 1], [0, 5, 3, 2]])
    assert dimension_order(book).tolist() == [1, 2, 3, 0]
    assert cuts(10, 4) == [0, 3, 6, 8, 10] and cuts(0, 2) == [0, 0, 0]


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) and the books of sound rows (vec_id, vector), in plain numbers."""
    ints = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows]
    at = cuts(len(ints[0][1]), parts)
    first = {}
    for i, e in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, [int(np.floor(256 * float(x))) for x in e])
    out, total, books = defaultdict(str), defaultdict(int), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        book = [e[a:b] for e in list(first.values())[:entries]]
        near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), k) for k, c in enumerate(book))  # noqa: B023,E731
        for _ in range(rounds):
            own = defaultdict(list)
            for _, e in ints:
                own[near(e[a:b])[1]].append(e[a:b])
            book = [[sum(c) // len(c) for c in zip(*own[k], strict=True)] if own[k] else c for k, c in enumerate(book)]
        for n, (_, e) in enumerate(ints):
            far, k = near(e[a:b])
            out[n] += f"{k:02x}"
            total[n] += far
        books.append(np.array(book, np.int64).reshape(len(book), b - a))
    return [(i, out[n], total[n]) for n, (i, _) in enumerate(ints)], books_sha256(books)


@pytest.mark.parametrize("dim", [32, 18])
def test_odd_rows(spark, dim):
    r = random.Random(dim)
    some = [[r.choice([-1.5, -0.25, 0.001, 2.0]) + r.random() * (k % 3) for _ in range(dim)] for k in range(150)]
    some += some[:40] + [some[0]] * 60
    rows = [(None if k % 41 == 5 else k if k % 7 else 3, e, None if k % 3 else k % 4, "x") for k, e in enumerate(some)]
    bad = [(900, None, 1, "x"), (901, [None] + some[0][1:], 1, "x"), (902, [float("nan")] * dim, None, "x"), (903, [float("inf")] + some[0][1:], 1, "x"), (904, [float("-inf")] * dim, 1, "x")]
    schema = "vec_id long, embedding array<double>, label int, code string"
    out = compress_vectors(spark.createDataFrame(rows + bad, schema).selectExpr("*", "1 AS error", "2 AS part").repartition(5))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    want, sha = plain([(i, e) for i, e, _, _ in rows])
    seen = out.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(x.vec_id, x.code, x.error) for x in seen], key=key) == sorted(want, key=key)
    assert {x.codebooks_sha256 for x in seen} == {sha}
    sums = defaultdict(int)
    for (_, _, label, _), (_, _, error) in zip(rows, want, strict=True):
        sums[label] += error
    assert {(x.label, x.label_error) for x in seen} == set(sums.items())
    assert compress_vectors(spark.createDataFrame(bad, schema)).collect() == []
    assert compress_vectors(spark.createDataFrame([], schema)).collect() == []


def test_lengths_have_books_of_their_own_and_far_components_are_held(spark):
    rows = [(1, [1.0] * 16, 1), (2, [2.0] * 16, 1), (3, [1.0] * 3, 2), (4, [], 2), (5, [1e30] * 16, None)]
    out = {x.vec_id: x for x in compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(out) == 5 and all(x.error == 0 for x in out.values())
    assert out[2].code == "01" * 16 and out[5].code == "02" * 16 and out[4].code == "00" * 16
    assert len({x.codebooks_sha256 for x in out.values()}) == 3
