import random
import re

import numpy as np
import pytest

from meterlens.llm import jaccard as J
from meterlens.llm.catalog import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [f"word{i}" for i in range(3000)]


def brute_set(text, size=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80, size=5):
    """(doc_id, set size, least id of the class) by all pairs of sets."""
    sets = [brute_set(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and label[x] != label[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                label = [label[y] if k == label[x] else k for k in label]
    least = {}
    for (i, _), k, s in zip(rows, label, sets):
        if i is not None and s:
            least[k] = min(i, least.get(k, i))
    return sorted(((i, len(s), least.get(k) if s else i) for (i, _), k, s in zip(rows, label, sets)), key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(WORDS)
    return out


def corpus(rng, family=60):
    """Pairs on both sides of the limit, a family of edited copies, a chain, a passage that many unrelated texts hold."""
    texts = []
    for n in range(9):
        base = rng.choices(WORDS, k=200)
        texts += [" ".join(base), " ".join(edited(rng, base, n))]
    base = rng.choices(WORDS, k=150)
    texts += [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(family)]
    for _ in range(10):
        base = edited(rng, base, 3)
        texts.append(" ".join(base))
    passage = rng.choices(WORDS, k=60)
    for _ in range(50):
        texts.append(" ".join(rng.choices(WORDS, k=rng.randrange(5, 60)) + passage + rng.choices(WORDS, k=5)))
    for n in (5, 6, 7, 8, 9, 10, 24, 25, 26):
        short = rng.choices(WORDS, k=n)
        texts += [" ".join(short), " ".join(short[:-1]), " ".join(short[1:])]
    rng.shuffle(texts)
    return list(enumerate(texts))


EDGES = [
    (4, "same words here again now then"), (2, "Same words\nhere again now\tTHEN"), (9, None), (8, ""), (7, " \n"),
    (None, "alone, no id, five words"), (3, "x " * 60_000), (None, "same words here again now then"), (11, "one two"),
    (5, "other text entirely"), (5, "other text entirely"), (10, "One  two"), (None, None), (12, "one"),
    (13, "É é A"), (14, "é é a"), (6, "x " * 59_000),
]


@pytest.mark.parametrize("crowd, tile", [(2, 3), (32, 512)])
def test_classes_against_brute_force(docs, crowd, tile):
    """Classes depend neither on what counts as common nor on how tiles are cut."""
    rows = corpus(random.Random(crowd)) + [(1000 + i if i is not None else None, t) for i, t in EDGES]
    params = J.JaccardParams(crowd=crowd, tile=tile)
    assert rows_of(J.jaccard_classes(docs(rows), params)) == brute(rows)


def test_tiles_alone_find_every_link(docs, monkeypatch):
    """Without any round for families the tiles give the same classes."""
    monkeypatch.setattr(J, "family_roots", lambda *a: None)
    rows = corpus(random.Random(7), 40)
    assert rows_of(J.jaccard_classes(docs(rows), J.JaccardParams(crowd=4, tile=8))) == brute(rows)


@pytest.mark.parametrize("percent, size", [(50, 3)])
def test_other_limits(docs, percent, size):
    rows = corpus(random.Random(percent), 25)
    params = J.JaccardParams(shingle=size, percent=percent, crowd=6, tile=16)
    assert rows_of(J.jaccard_classes(docs(rows), params)) == brute(rows, percent, size)


def test_edges(docs):
    assert rows_of(J.jaccard_classes(docs(EDGES))) == brute(EDGES)
    assert J.jaccard_classes(docs([])).count() == 0
    assert rows_of(J.jaccard_classes(docs([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_signatures_never_hide_a_link():
    """The bound from bit counts is never below the overlap, also where many bits collide."""
    rng = np.random.default_rng(1)
    for bits in (64, 256, 4096):
        sets = [np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64)) for _ in range(3)]
        sets += [np.unique(np.concatenate((s[: 150 - k], rng.integers(0, 2**63, k, dtype=np.uint64)))) for s in sets for k in (5, 16, 40)]
        sizes, marks = np.array([len(s) for s in sets]), J.signatures(sets, bits)
        able = J.may_link(marks, sizes, marks, sizes, 80)
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                real = 100 * both >= 80 * (len(a) + len(b) - both)
                assert J.links_exactly(a, b, 80) == real
                assert able[x, y] or not real
    assert able.sum() < len(sets) ** 2


def test_a_family_does_not_meet_itself_pair_by_pair(spark, docs):
    """Rows in tiles and pairs to decide grow with the family, not with its square."""
    made = []
    for g in (100, 200, 400):
        rng = random.Random(11)
        base = rng.choices(WORDS, k=200)
        rows = [(i, " ".join(edited(rng, base, rng.randrange(5)))) for i in range(g)]
        params = J.JaccardParams()
        raw = J.cut(J.shingle_sets(docs(rows), 5))
        sets, _ = J.distinct_sets(raw)
        index = J.prefix_index(sets, params)
        rooted = J._rooted(index, J.family_roots(index, sets, params))
        made.append((index.count(), J._tile_rows(rooted, params)[0].count()))
    for (few, small), (more, large) in zip(made, made[1:]):
        assert more <= 2.5 * few and large <= 2.5 * max(small, few)


def test_a_tile_names_no_more_rows_than_sets():
    """Also in a family too small to be a crowd, whose pairs are all within the bound."""
    rng = np.random.default_rng(2)
    for g in (8, 16, 32):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets = [np.unique(np.append(base, rng.integers(0, 2**63, 5, dtype=np.uint64))) for _ in range(g)]
        marks = [bytes(m) for m in J.signatures(sets, 1024)]
        tile = {"token": 1, "band": 2, "i": 0, "j": 0, "node": range(g), "n": 205, "root": range(g)}
        made = J._tile_pairs(J.pd.DataFrame({**tile, "own": True, "role": 3, "mark": marks}), 80)
        assert len(made) == g - 1 and set(made["u"]) | set(made["v"]) == set(range(g))


@pytest.mark.parametrize("families", [True, False])
def test_clusters_in_many_blocks(docs, monkeypatch, families):
    """Clusters cut into blocks, with components on both sides or none, give the same classes."""
    monkeypatch.setattr(J, "BLOCK_SETS", 5)
    if not families:
        monkeypatch.setattr(J, "family_roots", lambda *a: None)
    rng = random.Random(9)
    base, rows = rng.choices(WORDS, k=150), corpus(rng, 30)
    for k in range(24):  # some of these link, many only nearly
        rows.append((2000 + k, " ".join(edited(rng, base, 2 + k % 4))))
    assert rows_of(J.jaccard_classes(docs(rows), J.JaccardParams(crowd=6))) == brute(rows)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_jaccard_join"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == brute(rows)
