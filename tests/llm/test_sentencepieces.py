import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from meterlens.llm import sentencepieces as S
from meterlens.llm.catalog import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "▁▁x ▁", "<s></s>", "<0x41>", "<unk>", "\n\n", "tab\tx\r\n",
    "é́ ñÑß", "日本語😀👩‍👩‍👧", "\u0000 \x85", "words, and marks!!! *** $$$", "a" * 5000, "the of and " * 20_000,
    "x" * 100_000, "aaaa.\nBbbb  cc", "İΣς ﬁ",
]


@pytest.fixture(scope="module")
def both():
    return S.PieceTable(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(both):
    mine, lib = both
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCTHE .,!\n\t  ▁éß日本😀<0x41>/'"
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for text in texts:
        ids = mine.encode(text)
        assert ids == lib.encode(text), text[:60]
        assert mine.decode(ids) == lib.decode(ids)


def test_the_table_equals_plain_merging(both):
    mine, _ = both
    rng = random.Random(5)
    for _ in range(600):
        part = "".join(rng.choice("thearionsdg▁é") for _ in range(rng.randrange(1, 14)))
        assert [mine.piece[i] for i in mine._part(part)] == S.merge_pairs(part, mine.id_of, mine.rank)


def test_compatible_pairs_by_merging(both):
    mine, _ = both
    rng = random.Random(6)
    ids = [i for i, p in mine.piece.items() if i in mine.halves and p.isascii()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        merged = S.merge_pairs(mine.piece[a] + mine.piece[b], mine.id_of, mine.rank)
        assert mine.compatible(a, b) == (merged == [mine.piece[a], mine.piece[b]])


def test_any_ids_decode_as_in_the_library(both):
    mine, lib = both
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(32_000), rng.randrange(300))) for _ in range(rng.randrange(12))]
        assert mine.decode(ids) == lib.decode(ids)


def test_memos_are_bounded(both, monkeypatch):
    monkeypatch.setattr(S, "MEMO_WORDS", 5)
    monkeypatch.setattr(S, "MEMO_PARTS", 5)
    monkeypatch.setattr(S, "MEMO_PAIRS", 5)
    mine, lib = S.PieceTable(PATH), both[1]
    text = " ".join(f"thing{i}s word{i * 7}, end" for i in range(50))
    assert mine.encode(text) == lib.encode(text) and len(mine.words) <= 6


def want(rows, lib):
    out = []
    for i, t in rows:
        ids = lib.encode(t or "", add_eos=True)
        a = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((i, len(ids), a, hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edges(docs, both):
    rows = [*enumerate(TEXTS), (None, "no id"), (1, "a"), (1, "a")]
    assert sorted(map(tuple, S.piece_digests(docs(rows), PATH).collect()), key=str) == want(rows, both[1])
    assert S.piece_digests(docs([]), PATH).count() == 0
    assert S.encode(docs([]), PATH).count() == 0


def test_encode_then_decode(docs, both):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    ids = S.encode(docs(rows), PATH)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: both[1].encode(t or "", add_eos=True) for i, t in rows}
    texts = {r.doc_id: r.text for r in S.decode(ids, PATH).collect()}
    assert texts == {i: (t or "").replace("▁", " ") for i, t in rows}


def test_query_against_the_library(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_sentencepiece"](spark, sf).collect()), key=str) == want(rows, both[1])
