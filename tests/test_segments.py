"""Density clustering against brute force, and the segment rules."""

import numpy as np
from pyspark.sql import functions as F

from meterlens.operators import density, segment
from meterlens.plans.clean import add_upload, clean_readings

EPS, MIN = 0.3425, 3


def brute_force(x, names):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= EPS * EPS
    core = near.sum(1) >= MIN
    label = [None] * len(x)
    for i in range(len(x)):
        if label[i] is not None or not core[i]:
            continue
        label[i], todo = names[i], [i]
        while todo:
            j = todo.pop()
            if core[j]:
                for k in np.flatnonzero(near[j]):
                    if label[k] is None:
                        label[k] = names[i]
                        todo.append(k)
    return dict(zip(names, label))


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(density, "SALT_ROWS", 40)
    rng = np.random.default_rng(5)
    shift = np.array([0.34, 0, 0, 0])
    x = np.concatenate(
        [
            rng.uniform(-2.5, 2.5, size=(90, 4)),
            rng.normal(scale=0.02, size=(200, 4)),  # a third of all points in a few cells
            rng.normal(scale=0.03, size=(120, 4)) + shift,
            rng.normal(scale=0.15, size=(150, 4)) + rng.uniform(-2, 2, size=(5, 4))[rng.integers(0, 5, 150)],
            np.zeros((20, 4)),  # equal points
        ]
    )
    x = x[rng.permutation(len(x))]
    names = [f"p{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, *map(float, r)) for n, r in zip(names, x)], "id string, x0 double, x1 double, x2 double, x3 double")
    got = {r.id: r.cluster for r in density.density_clusters(df, EPS, MIN, 4).collect()}
    assert got == brute_force(x, names)


def test_labels_of_a_long_chain(spark):
    n = 60
    nodes = spark.createDataFrame([(f"c{i}", f"n{(i * 37) % n:03d}") for i in range(n)] + [("lone", "z")], "cell string, own string")
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n - 1)], "a string, b string")
    got = {r.cell: r.label for r in density.connected_labels(nodes, edges).collect()}
    assert got.pop("lone") == "z" and set(got.values()) == {"n000"}


def profiles(spark, rows):
    return spark.createDataFrame([(f"c{i:02d}", *map(float, r), 10) for i, r in enumerate(rows)], "client_id string, vol_med double, vol_p90 double, pres_med double, pres_p90 double, n_obs long")


def segments(spark, rows):
    return [r.segment for r in segment.segment_profiles(profiles(spark, rows)).orderBy("client_id").collect()]


def test_two_clusters_and_noise(spark):
    small, large = (1, 2, 3, 4), (100, 120, 3, 4)
    rows = [small] * 4 + [large] * 4 + [(95, 110, 9, 9)]
    assert segments(spark, rows) == ["Comercial"] * 4 + ["Industrial"] * 5


def test_one_cluster_becomes_industrial(spark):
    assert segments(spark, [(1, 2, 3, 4)] * 5) == ["Industrial"] * 5


def test_all_noise_falls_back_to_the_median(spark):
    rows = [(i * 10, i * 12, i, i) for i in range(5)]
    assert segments(spark, rows) == ["Comercial"] * 3 + ["Industrial"] * 2


def test_single_client_is_commercial(spark):
    assert segments(spark, [(1, 2, 3, 4)]) == ["Comercial"]


def test_packed_centres(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pts, cen = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    points = spark.createDataFrame([(f"p{i}", *map(float, r)) for i, r in enumerate(pts)], "client_id string, x0 double, x1 double, x2 double, x3 double")
    centres = spark.createDataFrame([(f"k{i:02d}", f"s{i}", *map(float, r)) for i, r in enumerate(cen)], "cluster string, segment string, x0 double, x1 double, x2 double, x3 double")
    monkeypatch.setattr(segment, "CENTRES_PER_ROW", 7)
    got = {r.client_id: r.segment for r in segment.nearest_centre(points, centres).collect()}
    want = np.argmin(((pts[:, None] - cen[None]) ** 2).sum(-1), axis=1)
    assert got == {f"p{i}": f"s{k}" for i, k in enumerate(want)}


RAW = "Cliente string, Fecha string, Presion string, Temperatura string, Volumen string"


def raw(spark, days, clients, shift=0.0):
    rows = [
        (c, f"{d:02d}-01-2024 {h:02d}:00", "0" if h == 5 else "4", "20", str(v + shift + (h % 3)))
        for c, v in clients.items()
        for d in days
        for h in range(24)
    ]
    return spark.createDataFrame(rows + [(next(iter(clients)), "zz", "1", "1", "1"), rows[0]], RAW)


def test_cleaning_job(spark):
    clients = {f"small{i}": 2.0 for i in range(4)} | {f"large{i}": 200.0 for i in range(4)}
    got = clean_readings(raw(spark, [1, 2], clients))
    assert got.counts.first().asDict() == {"n_unparseable": 1, "n_removed": 1, "negative_volume": 0, "negative_pressure": 0}
    out = got.readings
    assert out.columns[:3] == ["ts", "client_id", "segment"] and out.count() == 8 * 48
    assert out.where("pressure = 0").count() == 0
    assert {r.client_id: r.n_imputed for r in got.imputations.collect()} == {c: 2 for c in clients}
    assert {r.segment: r.n_clients for r in got.segments.collect()} == {"Comercial": 4, "Industrial": 4}

    more = add_upload(out, raw(spark, [2, 3], {"small0": 2.0, "new": 200.0}, shift=1.0))
    by = {(r.client_id, r.segment): r.n for r in more.groupBy("client_id", "segment").agg(F.count("*").alias("n")).collect()}
    assert by[("small0", "Comercial")] == 72 and by[("new", "Industrial")] == 48 and len(by) == 9
    # The uploaded value replaced the stored one.
    assert more.where("client_id = 'small0' AND ts = timestamp_ntz'2024-01-02 00:00:00'").first().volume == 3.0
