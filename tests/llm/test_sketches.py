import hashlib
import random
import string

import xxhash
from pyspark.sql import functions as F

from meterlens.llm import sketches as S
from meterlens.llm.catalog import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
HEAD = "alpha beta gamma delta epsilon zeta eta theta"
ROWS = [
    (1, None), (2, ""), (5, "É one Two"), (4, " \t\n"), (9, HEAD), (8, HEAD.upper()), (30, "日本 😀 x " * 40_000),
    (12, "w"), (20, " ".join(f"a{i}" for i in range(500))), (21, " ".join(f"a{i}" for i in range(250))),
]


def h64(values):
    """Spark's hash of several longs: each seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed


def brute_sketch(text):
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.translate(LOWER).encode().split()]
    if not words:
        return []
    hashes = {h64(words[i : i + 5]) for i in range(len(words) - 4)} or {h64(words)}
    kept = [h for h in hashes if h < 2**61] or [min(hashes)]
    return sorted({h >> 13 for h in kept})


def likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    return len(set(a) & set(b)) / min(len(a), len(b))


def brute(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        text = lambda s: "".join(f"{h:013x}" for h in s)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), sha, text(a), text(b), likeness(a, b), likeness(a, c)))
    return out


def test_digests_of_edges(docs):
    assert sorted(map(tuple, S.fingerprint_digests(docs(ROWS)).collect())) == brute(ROWS)
    one = [(7, "only one text of several words here")]
    assert list(map(tuple, S.fingerprint_digests(docs(one)).collect())) == brute(one)


def test_empty_table_null_and_repeated_ids(docs):
    assert S.fingerprint_digests(docs([])).count() == 0
    rows = [(None, "a b c d e f g h"), (3, "x y z"), (3, "x y z"), (3, "other words"), (4, "p q r s t u v w")]
    got = S.edited_and_next(docs(rows)).collect()
    assert len(got) == 5
    by = {r.text: r.edited for r in got}
    assert by["p q r s t u v w"] == "p q r s t u " + "a b"  # the null id counts as the smallest
    assert by["x y z"] == "x y " + "p"


def test_sketches_merge(spark):
    rng = random.Random(8)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(n)) for n in (2, 4, 7, 30, 200, 900)]
    rows = [(a, b) for a in texts for b in texts]
    frame = S.with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "sa")
    for r in S.with_sketch(frame, "b", "sb").withColumn("m", S.merged(F.col("sa"), F.col("sb"))).collect():
        both = set(map(int, r.sa)) | set(map(int, r.sb))
        below = sorted(h for h in both if h < 2**48)
        assert r.m == (below or sorted(both)[:1])


def test_containment_of_unequal_documents(docs):
    """The short half of a long document is found in it, whatever the lengths."""
    rows = [(1, " ".join(f"a{i}" for i in range(20_000))), (2, " ".join(f"a{i}" for i in range(400, 700)))]
    sketch = {r.doc_id: r.sketch for r in S.fingerprints(docs(rows)).collect()}
    assert likeness(sketch[1], sketch[2]) == 1.0 and len(sketch[1]) > 30 * len(sketch[2]) > 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_fingerprints"](spark, sf).collect())) == brute(rows)
