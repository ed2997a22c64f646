import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from meterlens.llm import substring_dedup as S, wordhash
from meterlens.llm.automaton import SuffixAutomaton, spans_above
from meterlens.llm.catalog import QUERIES


def brute(rows):
    """(doc_id, n_words, n_removed, digest) by comparing all windows of all documents."""
    low = -(2**63)
    docs = [(low if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for key, _, w in docs:
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            first[window] = min(first.get(window, key), key)
    out = []
    for key, i, w in docs:
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key:
                gone[k : k + 50] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_automaton_matches_by_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        added = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 5))]
        automaton = SuffixAutomaton()
        for a in added:
            automaton.add(a)
        runs = {tuple(a[i:j]) for a in added for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        text = [rng.randrange(4) for _ in range(40)]
        want = [max((m for m in range(1, e + 1) if tuple(text[e - m : e]) in runs), default=0) for e in range(1, 41)]
        assert automaton.matches(text) == want


def test_spans_above_a_threshold():
    assert spans_above([1, 2, 3, 0, 1, 2, 3, 4], 3) == [(0, 3), (4, 8)]
    assert spans_above([], 1) == [] and spans_above([1, 2], 3) == []


def test_every_window_has_its_anchor_among_the_texts(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(S, "PIECE", 70)
    for n in (49, 50, 51, 200, 800):
        words = np.array([rng.getrandbits(64) if n != 200 else rng.randrange(3) for _ in range(n)], dtype=np.uint64)
        rolling = S.Rolling(words, S.Powers())
        where = np.arange(max(0, n - 7))
        hashes = rolling.runs(where, where + 8)
        h, p = S.anchors(words, rolling)
        assert (h == hashes[p]).all()
        for k in range(n - 49):
            least = min(range(k, k + 43), key=lambda x: (int(hashes[x]) >> 21, x))
            assert least in p
        assert (n >= 50) == (len(p) > 0)


def test_a_window_is_in_one_context_of_its_text(docs):
    """Contexts hold the windows of their anchor alone, so no window is compared twice."""
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (0, 49, 50, 51, 130, 700)]
    texts += ["la " * 300, "do re mi " * 90]
    held = dict.fromkeys(range(len(texts)), 0)
    for r in S.occurrences(S._keyed(docs(list(enumerate(texts))), "doc_id", "text")).collect():
        held[r.id] += (r["size"] - 49) * len(r.starts)
    assert held == {i: max(0, len(t.split()) - 49) for i, t in enumerate(texts)}


def test_anchors_of_many_texts_at_once(monkeypatch):
    """Texts laid end to end have the anchors that each has alone, however the words are cut into pieces."""
    rng = random.Random(15)
    texts = [np.array([rng.randrange(40) for _ in range(n)], dtype=np.uint64) for n in (0, 30, 50, 400, 49, 51, 90)]
    words, at = np.concatenate(texts), wordhash.joined([len(t) for t in texts])
    windows = wordhash.ranges(at[:-1], np.maximum(np.diff(at) - 49, 0))
    want = []
    for t, a in zip(texts, at.tolist()):
        h, p = S.anchors(t, S.Rolling(t, S.Powers()))
        want += zip(h.tolist(), (p + a).tolist())
    for piece in (70, 1 << 20):
        monkeypatch.setattr(S, "PIECE", piece)
        h, p, lo, hi = S.anchor_runs(S.Rolling(words, S.Powers()), windows)
        assert list(zip(h.tolist(), p.tolist())) == want
        held = [windows[(windows >= a) & (windows <= b)] for a, b in zip(lo, hi)]
        assert np.array_equal(np.concatenate(held), windows)


@pytest.mark.parametrize("part", [1, 300, 1 << 18])
def test_word_hashes_of_a_batch(monkeypatch, part):
    monkeypatch.setattr(wordhash, "PART", part)
    rng = random.Random(16)
    letters = "ab\0é \t\n\x0b\x0c\r\x1c\x85\u3000"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", " ", "", " ".join("x" * n for n in (64, 65, 66)), *[" ".join("q" * n for n in range(1, 140))] * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(5)
    hash_of, seen = {}, []
    for rows, hashes, bounds in wordhash.parts(batch, "text"):
        for text, a, b in zip(rows.column(0).to_pylist(), bounds, bounds[1:]):
            seen.append(text)
            words = text.encode().split()
            assert len(words) == b - a
            assert all(hash_of.setdefault(w, h) == h for w, h in zip(words, hashes[a:b].tolist()))
    assert seen == texts[5:] and len(set(hash_of.values())) == len(hash_of)


def test_runs_that_meet_an_automaton():
    """Of contexts only the runs of 50 words and more that another document's context of the anchor has."""
    fresh = iter(range(1, 10_000))
    new = lambda n: [next(fresh) for _ in range(n)]
    shared, short = new(55), new(49)
    contexts = [(1, 7, new(9) + shared), (2, 7, shared + new(4)), (2, 7, new(3) + short), (3, 7, short + new(20))]
    contexts += [(4, 8, shared), (5, 9, new(60)), (5, 9, new(60))]
    ids, anchor, words = zip(*contexts)
    ends = np.cumsum([len(w) for w in words])
    asked, kept = S.candidate_runs(np.array(sum(words, []), dtype=np.uint64), ends, np.array(ids), np.array(anchor))
    assert asked == [(64, 119)] and kept == [(9, 64)]


def corpus():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(4000)] + ["É", "x,", "日本"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 75, 120, 400)]
    hot = fresh(70)
    rows = []
    for i in range(240):
        words = fresh(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(3)
            words += p[a:] + fresh(rng.randrange(0, 40))
        if i % 3 == 0:
            words += hot + fresh(20)
        rows.append((i * 2, " ".join(words)))
    long = fresh(900)
    for i in range(60):
        edited = list(long)
        edited[rng.randrange(900)] = f"edit{i}"
        rows.append((1000 + i, "\n".join(edited)))
    rows += [(2000 + i, " ".join(long)) for i in range(30)]
    rows += [(3000, "la " * 3000), (3001, "la " * 120 + "end"), (3002, "do re mi " * 700), (3003, "re mi do " * 400)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (None, " ".join(long)), (None, "a b"), (1000, " ".join(long[:200]))]
    rows += [(5000, "long " + " ".join(fresh(30_000)) + " " + " ".join(long)), (1000, rows[240][1])]
    return rows


@pytest.mark.parametrize(
    "settings", [{}, {"crowd": 0}, {"crowd": 1_000_000, "shard": 50}, {"crowd": 3, "shard": 1, "max_filter_bytes": 1}]
)
def test_any_route_equals_brute_force(docs, settings):
    """Automata alone, window hashes alone, and both, with filters of any size, give the same spans."""
    rows = corpus()
    assert got(S.repeat_digests(docs(rows), **settings)) == brute(rows)


def test_texts_that_stay(docs):
    long = " ".join(f"a{i}" for i in range(60))
    kept = {r.doc_id: r.text for r in S.remove_repeats(docs([(2, f"x  y\n{long} z"), (1, long)])).collect()}
    assert kept == {1: long, 2: "x y z"}


def test_empty_table(docs):
    assert S.remove_repeats(docs([])).count() == 0
    assert got(S.repeat_digests(docs([(1, "short")]))) == brute([(1, "short")])


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op1_substring_dedup"](spark, sf)) == brute(rows)
