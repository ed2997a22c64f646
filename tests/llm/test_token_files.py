import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterlens.llm import token_files as T, wordmemo
from meterlens.llm.catalog import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "Don't we'll they'VE 'S", "end.\nÉtat é é ́x ǅ İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y",
    "tab\there\x0b\x0c\r  wide", "日本語 テスト 😀👍🏽", "a,b.c!!! $$$ x--y it's,", "x'" * 50, "wörd, naïve. café*** é,",
    "z" * 200_000, "the of and " * 20_000, "\x00\x1c\x85 a\x1db", "ﬁ ½ Ⅷ ß ẞ",
]


def test_words_give_the_ids_of_the_whole_text():
    lib, mine = Tokenizer.from_file(PATH), wordmemo.WordEncoder(PATH)
    rng = random.Random(3)
    alphabet = "abcXYZ.,!'*- \n\té́ß0９ⅧΣς|<>日"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(1500)]
    for again in range(2):
        for text, ids in zip(texts, mine.encode_batch(texts)):
            assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]


def test_new_words_need_the_model_alone(monkeypatch):
    """Runs of ASCII and Latin-1 letters, each letter at every place of a word, without the steps before the merges."""
    letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº"]
    text = " ".join(a + b + c for a, b, c in zip(letters, letters[7:] + letters[:7], letters[20:] + letters[:20]))
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    mine = wordmemo.WordEncoder(PATH)
    monkeypatch.setattr(mine, "_whole", lambda text: pytest.fail("a run of letters went through all steps"))
    assert mine.encode_batch([text])[0].tolist() == ids


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(wordmemo, "MEMO_PIECES", 10)
    mine, lib = wordmemo.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for n in range(5):
        text = " ".join(f"w{n}x{i}" for i in range(30))
        assert mine.encode_batch([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 3, 8, 13, 15, 16, 17, 31, 32])
def test_pack_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype("<u4")
        data = T.pack(ids, width)
        assert len(data) == -(-n * width // 8) and (T.unpack(data, n, width) == ids).all()
    with pytest.raises(ValueError):
        T.pack(np.array([2**width if width < 32 else 0, 2**31], dtype="<u4"), min(width, 31))


@pytest.mark.parametrize(("width", "block"), [(11, 8), (16, 64), (17, 24), (19, 1000)])
def test_file_round_trip_and_random_access(tmp_path, width, block):
    rng = np.random.default_rng(1)
    docs = [(i * 3, rng.integers(0, 2**width, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate([0, 1, 5, 700, 0, 64, 3])]
    docs.append((None, np.array([1], dtype="<u4")))
    w = T.Writer(f"file://{tmp_path}/a", width, block)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    r = T.Reader(f"file://{tmp_path}/a")
    assert [(i, ids.tolist()) for i, _, ids in r.documents()] == [(i, ids.tolist()) for i, ids in docs]
    flat = np.concatenate([ids for _, ids in docs])
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (r.range(a, b) == flat[a:b]).all()


def want(rows):
    lib, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_edges(docs):
    rows = [(10 - n, t) for n, t in enumerate(TEXTS)] + [(None, "no id")]
    got = T.token_digests(T.write_token_files(docs(rows), PATH, block_ids=512)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want(sorted(rows, key=lambda r: (r[0] is not None, r[0])))


def test_repeated_rows_and_empty_table(docs):
    got = T.token_digests(T.write_token_files(docs([(1, "a b")] * 3 + [(1, "c")]), PATH)).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3, 3] and sorted(r.start for r in got)[0] == 0
    assert T.token_digests(T.write_token_files(docs([]), PATH)).count() == 0


def test_ids_read_back(docs):
    rows = [(1, "one two"), (2, None)]
    manifest = T.write_token_files(docs(rows), PATH)
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: list(r.ids) for r in T.read_token_files(manifest).collect()}
    assert got == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}


def test_query_against_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = QUERIES["op8_token_files"](spark, sf).collect()
    assert sorted(map(tuple, got)) == want(rows)
