import math
import random

import numpy as np
import pytest

from meterlens.llm import whitening as W
from meterlens.llm.catalog import QUERIES

INF, NAN = math.inf, math.nan


def brute(rows, components=16):
    """The definition on plain lists: (id, component) -> row, with exact sums in Python's whole numbers."""
    usable = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            usable.append((i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)))
    lengths = [len(x) for x in {x for _, x in usable}]
    if not lengths:
        return []
    d = max(set(lengths), key=lambda s: (lengths.count(s), s))
    usable = [(i, x) for i, x in usable if len(x) == d]
    fit = sorted({x for _, x in usable})
    n, S = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    cov = np.empty((d, d))
    for a in range(d):
        for b in range(d):
            cov[a, b] = sum((n * x[a] - S[a]) * (n * x[b] - S[b]) for x in fit) / n**3
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(cov[a, a] for a in range(d))
    white = {x: np.array([x[k] - S[k] / n for k in range(d)]) @ axes[:, order] for x in fit}
    out = []
    for i, x in usable:
        dev = sum((n * x[k] - S[k]) ** 2 for k in range(d))
        for c, e in enumerate(values[order]):
            spread = e > trace * d * 2.3e-16
            out.append((i, c + 1, n, dev, white[x][c] / math.sqrt(e) if spread else None, e / trace if trace else None))
    return out


def same(got, want):
    """Equal rows up to one sign for each component."""
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], str(r[3]), abs(r[4] or 0))
    signs = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:3] == w[:3] and int(g[3]) == w[3]
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if w[4] is not None:
            assert math.isclose(abs(g[4]), abs(w[4]), rel_tol=1e-7, abs_tol=1e-9)
            if abs(w[4]) > 1e-6:
                assert signs.setdefault(w[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
        if w[5] is not None:
            assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-12)


def table_of(spark, rows, kind="float"):
    full = [(i, v, 1, "a", 2) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, n long, x string, component int")


def tuples(frame):
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in frame.collect()]


def cloud(d, n, seed=3):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) * (k + 1) for _ in range(d)] for k in range(d)]
    return [[sum(m[k] * g for m, g in zip(mix, [rng.gauss(0, 1) for _ in range(d)])) for k in range(d)] for _ in range(n)]


def test_edges_against_brute_force(spark):
    vectors = cloud(5, 60)
    rows = list(enumerate(vectors)) + [(7, vectors[3])] * 40 + [(None, vectors[4]), (None, None), (70, [])]
    rows += [(71, [1.0, None, 0.0, 0.0, 0.0]), (72, [NAN] * 5), (73, [INF, 1.0, 1.0, 1.0, 1.0]), (74, [1.0, 2.0])]
    rows += [(75, [c + 1e-9 for c in vectors[5]]), (76, [1e4, -1e4, 0.0, 1.0, 2.0])]
    got = W.whiten(table_of(spark, rows, "double"), 16)
    same(tuples(got), brute(rows))
    errors = {r.identity_error for r in got.collect()}
    assert len(errors) == 1 and errors.pop() < 1e-6
    same(tuples(W.whiten(table_of(spark, rows, "double"), 2)), brute(rows, 2))


def test_slices_give_the_same(spark, monkeypatch):
    rows = list(enumerate(cloud(6, 50, 4)))
    monkeypatch.setattr(W, "SLICE", 13)
    same(tuples(W.whiten(table_of(spark, rows, "double"))), brute(rows))


def test_huge_entries_stay_exact(spark):
    """Squares beyond 64 bits: the sums and the deviation are those of whole numbers of any size."""
    rows = [(i, [float((i * 7919) % 100) * 1e9, float(i % 13) * 1e11, float(i % 5)]) for i in range(40)]
    got = W.whiten(table_of(spark, rows, "double"))
    want = brute(rows)
    assert max(w[3] for w in want) > 2**63
    same(tuples(got), want)
    far = W.whiten(table_of(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])], "double")).collect()
    assert len(far) == 3 and all(math.isfinite(r.whitened) for r in far)


@pytest.mark.parametrize(
    "rows",
    [[(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(i, [float(i), 1.0, -2.0 * i]) for i in range(9)]],
)
def test_without_spread(spark, rows):
    """One vector, constant and dependent dimensions: no division by zero, nulls where nothing can be said."""
    got = W.whiten(table_of(spark, rows, "double"))
    same(tuples(got), brute(rows))
    assert all(r.identity_error is None or r.identity_error < 1e-9 for r in got.collect())


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, []), (3, [NAN])]):
        got = W.whiten(table_of(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert got.count() == 0


def test_covariance_is_exact(spark):
    """Far from zero the matrix is the same to the last digit as near it."""
    near = cloud(4, 50, 9)
    far = [[math.floor(64 * c) / 64 + 2.0**30 for c in v] for v in near]
    models = []
    for vectors in (near, far):
        distinct = W.fit_list(table_of(spark, list(enumerate(vectors)), "double"))
        models.append(W.fit(distinct, 4, 4))
    assert models[0].values.tolist() == models[1].values.tolist()
    assert models[0].vectors.tolist() == models[1].vectors.tolist() and models[0].rest == models[1].rest


def test_query_against_brute_force(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = QUERIES["op12_embedding_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    want = brute([(r.vec_id, r.embedding) for r in data])
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(rows) == len(want) == 16 * len(data)
    for i, c, n, dev, white, share in want:
        r = rows[i, c]
        assert (r.n, r.deviation) == (n, dev) and r.identity_error < 1e-4
        assert math.isclose(abs(r.whitened), abs(white), rel_tol=1e-6, abs_tol=1e-7)
        assert math.isclose(r.explained, share, rel_tol=1e-8)
