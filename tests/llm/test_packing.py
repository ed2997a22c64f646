from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm import packing as P
from meterlens.llm.catalog import QUERIES


def plain_pack(lengths, p):
    """The rule by looking at every open bin each time."""
    bins, where, left = [], {}, sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= lengths[i]]
        if fits:
            k = min(fits)[1]
        else:
            sizes = [c for c in p.capacities if c >= lengths[i]]
            k = len(bins)
            bins.append([min(sizes, key=lambda c: (p.cost(c) / min(c, left), c)), 0])
        where[i] = (k, bins[k][1])
        bins[k][1] += lengths[i]
        left -= lengths[i]
    size = [min(c for c in p.capacities if c >= u) for _, u in bins]
    return [(*where[i], size[where[i][0]]) for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    p = P.PackParams(capacities=(16, 64, 100, 256), attention=float(rng.choice([50.0, 300.0, 1e9])), fixed=float(seed * 5))
    lengths = np.minimum(256, rng.geometric(0.03, 300))
    got = list(zip(*(x.tolist() for x in P.pack(lengths, p))))
    assert got == plain_pack(lengths.tolist(), p)


def test_sizes_are_chosen_jointly():
    """Dear attention opens short sequences, cheap attention and dear sequences long ones."""
    lengths = np.full(64, 100)
    short = P.pack(lengths, P.PackParams((128, 1024), attention=100.0, fixed=0.0))[2]
    long = P.pack(lengths, P.PackParams((128, 1024), attention=1e9, fixed=500.0))[2]
    assert set(short.tolist()) == {128} and long.max() == 1024


def check(rows, lengths, p):
    """Every token in one place, nothing overlaps, every bin has the shortest length that holds it."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        bins[r.group, r.bin, r.capacity].append((r.offset, r.length))
    for i, n in lengths.items():
        at = 0
        for start, length in sorted(docs.pop(i)):
            assert start == at and 0 < length <= p.capacities[-1]
            at += length
        assert at == n
    assert not docs and len({(g, b) for g, b, _ in bins}) == len(bins)
    for (_, _, capacity), places in bins.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert capacity == min(c for c in p.capacities if c >= at)


ROWS = [(i, "w " * (i * 7 % 900)) for i in range(300)] + [(1000, "x\n" * 50_000), (1001, None), (1002, ""), (1003, " \t ")]


@pytest.mark.parametrize("group", [20_000, 40])
def test_packing_of_edges(docs, group):
    p = P.PackParams(group=group)
    got = P.pack_documents(docs(ROWS), params=p).collect()
    check(got, {i: len((t or "").split()) + 1 for i, t in ROWS}, p)
    again = P.pack_documents(docs(ROWS[::-1]).repartition(7), params=p).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_repeated_rows_null_ids_and_own_lengths(docs):
    rows = [(1, "a b")] * 5 + [(None, "c"), (None, "c d")]
    got = P.pack_documents(docs(rows)).collect()
    assert sorted(str((r.doc_id, r.length)) for r in got) == sorted(["(1, 3)"] * 5 + ["(None, 2)", "(None, 3)"])
    got = P.pack_documents(docs([(1, "abc"), (2, "")]), F.char_length("text")).collect()
    assert [(r.doc_id, r.length) for r in got] == [(1, 3)]
    assert P.pack_documents(docs([])).count() == 0


def test_many_copies_spread_over_groups(docs):
    got = P.pack_documents(docs([(i, "same text") for i in range(2000)]), params=P.PackParams(group=100))
    sizes = [r["count"] for r in got.groupBy("group").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200


def test_query_packs_all_words(spark, sf):
    rows = {r.doc_id: len(r.text.encode().split()) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed = QUERIES["op6_best_fit_packing"](spark, sf)
    check(packed.collect(), rows, P.PackParams())
    total = P.waste(packed).agg(F.sum("tokens"), F.sum("padding")).first()
    assert total[0] == sum(rows.values()) and total[1] < 0.1 * total[0]
