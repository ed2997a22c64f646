import hashlib
import string
from collections import defaultdict

import pytest
from compare import compare, duck

from meterlens.llm import exact_dedup as X
from meterlens.llm.catalog import ORACLES, QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [
    (1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000),
    (None, "abc"), (None, "only null id"), (9, "rep"), (9, "rep"), (10, "İ"), (11, "ß A"), (12, "ß a"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        low = (t or "").translate(LOWER)
        ids = groups[low]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 4096, X.MAX_FILTER_BYTES])
def test_edges_at_any_filter_size(docs, size):
    """A filter far too small shuffles more rows and gives the same result."""
    many = ROWS + [(100 + i, f"t{i % 700}") for i in range(1500)]
    assert sorted((tuple(r) for r in X.exact_groups(docs(many), max_filter_bytes=size).collect()), key=str) == brute(many)


def test_kept_rows(docs):
    df = docs(ROWS)
    kept = X.drop_exact_copies(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = {t[4]: t[1] for t in brute(ROWS)}
    assert len(got) == len(want) and sorted((i for i, _ in got), key=str) == sorted(want.values(), key=str)


def test_empty_table(docs):
    assert X.exact_groups(docs([])).count() == 0
    assert X.drop_exact_copies(docs([])).count() == 0


def test_query_matches_sql(spark, sf):
    name = "op10_exact_dedup"
    assert compare(spark, duck(sf), QUERIES[name], ORACLES[name], sf)[1] == ""


def test_only_suspects_shuffle_their_digest(docs):
    df = docs([(i, f"t{i}") for i in range(3000)] + [(5000, "t1")])
    light = X.cut(X.digests(df))
    cells = X.cells_for(light.count())
    tested = X.ask(light, "h", X.build(light, "h", cells, least=2), cells, "s")
    assert 2 <= tested.where("s").count() <= 150
