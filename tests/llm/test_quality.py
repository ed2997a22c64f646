import zlib

import numpy as np
import pytest

from meterlens.llm import quality as Q
from meterlens.llm.catalog import QUERIES


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def test_query_scores_the_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id) == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    test = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good = [p for y, p in test if y]
    bad = [1 - p for y, p in test if not y]
    assert np.mean(good) >= 0.98 and np.mean(bad) >= 0.85


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = (Q.train(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    draw = lambda n, at: rng.normal(at, 1.0, (n, 3))
    positive, unlabelled = draw(2000, 1.5), np.concatenate([draw(2400, 1.5), draw(1600, -1.5)])
    model = Q.fit(positive, unlabelled, 0.6, Q.QualityParams())
    assert (model.scores(draw(1000, 1.5)) >= 0.5).mean() > 0.95
    assert (model.scores(draw(1000, -1.5)) < 0.5).mean() > 0.95


ROWS = [
    (0, None), (1, ""), (2, "x" * 500_000), (3, "Good text. " * 30), (3, "Good text. " * 30), (None, "no id"),
    (4, "!!! ### " * 50), (5, "\n\n"), (6, "日本語 😀"),
]


def test_edges(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = Q.train(docs(ROWS), labels)
    got = Q.score(docs(ROWS), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    kept = Q.keep_good(docs(ROWS), model)
    assert kept.columns == docs(ROWS).columns and kept.count() == sum(r.predicted for r in got)


@pytest.mark.parametrize("labelled", [[], [(0, 0, 0)]])
def test_without_positives_or_documents(spark, docs, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    model = Q.train(docs([(0, "a b"), (2, "c")]), labels)
    assert len({r.score for r in Q.score(docs([(0, "a b"), (2, "c")]), model).collect()}) == 1
    empty = Q.train(docs([]), labels)
    assert Q.score(docs([]), empty).count() == 0 and Q.keep_good(docs([]), empty).count() == 0
