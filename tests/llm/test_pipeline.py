import string

import regex
from test_packing import check
from test_simhash import brute_classes, brute_print

import corpus_pipeline
from meterlens.llm import packing, quality, secret_scan
from meterlens.llm.catalog import QUERIES
from meterlens.session import cut

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    """Every stage does its whole job on what the one before kept, and its decisions take effect."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    predicted = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    given, now = rows_of(docs), docs
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]

    now = cut(stages["quality"](spark, now, sf))
    good = rows_of(now)
    assert good == {i: r for i, r in given.items() if predicted[i]} and now.columns == docs.columns

    now = cut(stages["exact_dedup"](spark, now, sf))
    last = {}
    for i, r in sorted(good.items()):
        last[r.text.translate(LOWER)] = i
    single = rows_of(now)
    assert single == {i: good[i] for i in last.values()} and now.columns == docs.columns and len(single) < len(good)

    now = cut(stages["near_dedup"](spark, now, sf))
    classes = brute_classes({i: brute_print(r.text) for i, r in single.items()})
    kept = rows_of(now)
    assert kept == {i: single[i] for i in set(classes.values())} and now.columns == docs.columns

    now = cut(stages["secrets"](spark, now, sf))
    clean = rows_of(now)
    hide = lambda t: regex.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', rf"\1{secret_scan.MARK}", t)
    assert {i: r.text for i, r in clean.items()} == {i: hide(r.text) for i, r in kept.items()}
    assert now.columns == docs.columns and all(r.n_chars == len(r.text) for r in clean.values())
    assert any(secret_scan.MARK in r.text for r in clean.values())

    check(
        stages["packing"](spark, now, sf).collect(),
        {i: len(r.text.encode().split()) + 1 for i, r in clean.items()},
        packing.PackParams(),
    )


def test_query_gives_the_last_stage(spark, sf):
    got = QUERIES["pipeline"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "group", "bin", "offset", "capacity"]
    assert 0 < got.select("doc_id").distinct().count() < 200


def test_empty_and_odd_documents(spark, docs, tmp_path):
    """Nulls, repeated rows and tables without rows pass through all stages."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (None, "a b")]):
        now = docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, str(tmp_path)))
            assert name == "packing" or now.columns == docs(rows).columns
        assert (now.count() > 0) == bool(rows)
