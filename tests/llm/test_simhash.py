import random

import numpy as np
import pytest
import xxhash

from meterlens.llm import simhash as S
from meterlens.llm.catalog import QUERIES
from meterlens.llm.components import components
from meterlens.session import cut


def brute_print(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    """Smallest id reachable, by breadth-first search over all pairs."""
    ids = list(prints)
    arr = np.array([prints[i] for i in ids], dtype=np.uint64)
    out, seen = {}, set()
    for s in sorted(ids):
        if s in seen:
            continue
        todo, group = [s], {s}
        while todo:
            x = np.uint64(prints[todo.pop()])
            near = np.bitwise_count(arr ^ x) <= 2
            new = {ids[j] for j in np.flatnonzero(near)} - group
            group |= new
            todo += new
        seen |= group
        out.update({i: min(group) for i in group})
    return out


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "Two Words", "É é A", "a\x0bb\x0cc d\x85e f"]
    texts += [" ".join(rng.choice("ab cd Ef gh ij".split()) for _ in range(n)) for n in (3, 4, 40, 9000)]
    assert [S.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("crowd", [2, 4, 16, 10_000])
def test_links_close_to_brute_force(spark, crowd):
    """Random points, dense balls and long chains: classes do not depend on how crowds are handled."""
    rng = random.Random(2)
    points = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        c = rng.getrandbits(64)
        points |= {c ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
        for _ in range(40):
            c ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            points.add(c)
    points |= {0, 1, 2**64 - 1, 2**63, 2**63 + 3}
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    root = {r.node: r.root for r in components(S.links(frame, crowd)).collect()}
    want = brute_classes({p: int(np.int64(p).view(np.uint64)) for p in signed})
    assert {p: root.get(p, p) for p in signed} == want


ROWS = [
    (4, "same words here again"), (2, "Same words\nhere again"), (9, None), (8, ""), (7, " "), (None, "alone, no id"),
    (3, "x " * 60_000), (None, "same words here again"), (5, "other text entirely"), (5, "other text entirely"),
]


def test_groups_of_edges(docs):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_groups(docs(ROWS)).collect()), key=str)
    prints = {n: brute_print(t) for n, (_, t) in enumerate(ROWS)}
    classes = brute_classes(prints)
    want = []
    for n, (i, _) in enumerate(ROWS):
        ids = [ROWS[m][0] for m in classes if classes[m] == classes[n] and ROWS[m][0] is not None]
        want.append((i, f"{prints[n]:016x}", min(ids, default=None)))
    assert got == sorted(want, key=str)


def test_one_of_each_stays(docs):
    df = docs(ROWS)
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 7, None, 3, 5], key=str)


def test_empty_table(docs):
    assert S.near_groups(docs([])).count() == 0
    assert S.keep_one_of_each(docs([])).count() == 0


@pytest.mark.parametrize("job", [S.keep_one_of_each, S.near_groups])
def test_variants_are_not_broadcast(docs, monkeypatch, job):
    """Spark sizes the variants like the few fingerprints they are exploded from, so it may not choose their join."""
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def spied(df):
        plans.append(plan(df))
        return cut(df)

    links = S.links
    monkeypatch.setattr(S, "cut", spied)
    monkeypatch.setattr(S, "links", lambda *a: plans.append(plan(made := links(*a))) or made)
    job(docs([(i, f"text {i} of many") for i in range(50)]))
    joined = [p for p in plans if "explode" in p and "Join" in p]
    assert len(joined) == 2 and not any("Broadcast" in p for p in joined)


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, sf).collect()}
    classes = brute_classes(prints)
    assert got == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}
