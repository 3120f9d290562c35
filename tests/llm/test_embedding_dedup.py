import numpy as np
import pytest


from millrace.llm.embedding_dedup import directions, embedding_near_duplicates, list_decode


def brute(rows, least):
    ok = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ok:
        for j in ok:
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                n[i] += 1
                parent[find(i)] = find(j)
    name = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            name[find(i)] = min(v, name.get(find(i), v))
    return sorted(((v, n[i], name.get(find(i)), v == name.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def vectors(kind):
    r = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = r.standard_normal(24)
        for _ in range(1 + c % 6):
            rows.append((len(rows), (centre + r.standard_normal(24) * r.uniform(0.05, 0.4)).astype(kind).tolist()))
    centre = r.standard_normal(24)
    for _ in range(60):
        rows.append((len(rows), (centre + r.standard_normal(24) * 0.15).astype(kind).tolist()))
    same = rows[0][1]
    rows += [(len(rows) + k, same) for k in range(5)] + [(0, same), (None, same), (None, r.standard_normal(24).tolist())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + same[1:]), (1005, [None, *same[1:]]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [3.0]), (1009, [1e-30 * x for x in same]), (1010, [1e30 * x for x in same])]
    return rows


def test_against_brute_force(spark):
    for kind, sql in ((np.float32, "float"), (np.float64, "double")):
        rows = vectors(kind)
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{sql}>").selectExpr("*", "1 AS key", "2 AS root", "3 AS kept").repartition(3)
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df).collect()), key=repr)
        want = [(v, n, c, v == c if v is not None or c is not None else True) for v, n, c, _ in brute(rows, 0.95)]
        assert got == sorted(want, key=repr)


def test_recall_on_random_pairs(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.standard_normal((400, 64))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    pairs = 0.951 * base + np.sqrt(1 - 0.951**2) * other
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, pairs]))]
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert got >= 0.97 * 800


def test_list_decoding_finds_all_and_only_exceeding_filters():
    a, b = (x @ np.ones(x.shape[1]) for x in directions(10, 9, 1))
    for t in (-1.0, 0.0, 0.7):
        want = [i * len(b) + j for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] >= t]
        assert list_decode(a, b, t, 0).tolist() == want
    assert len(list_decode(a, b, 99.0, 5)) == 5


def test_empty_table(spark):
    assert embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_vector_has_the_same_products_in_any_company():
    import numpy as np

    from millrace.llm.embedding_dedup import _block_products, _unit

    r = np.random.default_rng(4)
    for dim in (2, 3, 17, 64, 129):
        blocks, unit = directions(dim, 9, 1), _unit(r.standard_normal((40, dim)))
        whole = _block_products(unit, blocks)
        for which in ([0], [7, 3], list(range(5, 40, 3)), list(range(40))):
            for a, b in zip(whole, _block_products(unit[which], blocks), strict=True):
                assert (a[which] == b).all()


@pytest.mark.parametrize(("dim", "count"), [(64, 10_000), (64, 10_000_000), (384, 10_000_000)])
def test_filters_follow_from_the_wanted_recall(dim, count):
    from millrace.llm.embedding_dedup import fitted, share_found

    rng = np.random.Generator(np.random.PCG64(5))
    unit = rng.standard_normal((300, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    blocks, threshold, share = fitted(unit, count, 0.95, 0.97, 1)
    assert share >= 0.97
    # other pairs at the threshold do nearly as well, closer ones better
    assert share_found(unit, blocks, threshold, 0.95, 9) >= 0.93 and share_found(unit, blocks, threshold, 0.98, 9) >= 0.97
