import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from meterlens.llm import resampling as R
from meterlens.llm.catalog import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target, buckets=10_000, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) of every row, straight from the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, brute_features(text)[1]))
    for text in target:
        t.update(map(bucket, brute_features(text)[1]))
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets))))
    out = []
    for i, text in rows:
        words, feats = brute_features(text)
        weight = sum(gain(bucket(f)) for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(feats), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return out


def rows_of(frame):
    return sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in frame.collect()), key=str)


TARGET = ["Alpha beta 12 gamma", None, "", "beta-beta été", "Alpha BETA"]
ROWS = [
    (1, None), (2, ""), (3, " \t.!"), (4, "Alpha beta"), (5, "été É alpha\x85beta x" * 9), (6, "a b c d e " * 5),
    (7, "A b C d E " * 5), (7, "A b C d E " * 5), (None, "w " * 30), (9, "alpha beta gamma " * 40), (10, "gamma " * 25),
    (11, "12 12a A12 9" * 12), (12, "beta " * 19), (13, "beta " * 20), (14, "日本語 テキスト " * 15), (-3, "q r s t " * 8),
]


def test_byte_table_follows_the_word_pattern():
    assert len(R.TABLE) == 256
    for b in range(256):
        if b < 0x80:
            kept = WORD.fullmatch(chr(b).lower()) is not None
            assert R.TABLE[b] == (ord(chr(b).lower()) if kept else 0x20)
        else:
            assert R.TABLE[b] == b


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_features_of_slices(monkeypatch, size):
    """The chained checksums are those of the joined runs, wherever a text is cut."""
    monkeypatch.setattr(R, "SLICE", size)
    for _, text in ROWS:
        words, feats = brute_features(text)
        got = list(R.feature_sums(text))
        assert sum(n for n, _ in got) == len(words)
        assert Counter(x for _, s in got for x in s) == Counter(zlib.crc32(f.encode()) for f in feats)


def test_edges_against_brute_force(spark, docs):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, bucket int")
    for percent, least, buckets in ((25, 20, 10_000), (100, 0, 7), (50, 1, 64), (0, 1, 64)):
        params = R.ResampleParams(buckets, percent, least)
        got = rows_of(R.resample(docs(ROWS), target, params))
        assert got == sorted(brute(ROWS, TARGET, buckets, percent, least), key=str)


def test_ties_go_to_the_smaller_id(spark):
    """Rows of one score are numbered by id, nulls last, and the cut may fall among them."""
    rows = [(i, 30, 5, 0, i % 3) for i in range(30)] + [(None, 30, 5, 0, 2), (99, 3, 5, 0, 9)]
    weighed = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r["rank"] for r in R.draw(weighed, 50, 20).collect()}
    want = [*range(2, 30, 3), None, *range(1, 30, 3)][:15]
    assert {i: n for i, n in got.items() if n} == {i: n + 1 for n, i in enumerate(want)}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert R.resample(docs([]), none).count() == 0
    assert rows_of(R.resample(docs(ROWS), none)) == sorted(brute(ROWS, []), key=str)


def test_long_text_and_drawn_rows(spark, docs):
    rows = [(i, f"word{i} " * (20 + i)) for i in range(40)] + [(50, "Long text. " * 200_000)]
    df = docs(rows)
    target = spark.createDataFrame([("word3 word3",)], "text string")
    want = {r[0] for r in brute(rows, ["word3 word3"]) if r[5]}
    kept = R.drawn_documents(df, target)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want and len(want) == 10


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(list, got.collect()), key=str) == sorted(([r[0], *r[2:]] for r in brute(rows, target)), key=str)
