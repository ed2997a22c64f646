import random
import string

import pytest
import regex
from pyspark.sql import functions as F

from meterlens.llm import secret_scan as S
from meterlens.llm.catalog import QUERIES

rng = random.Random(21)
hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
mixed = lambda n: "a1" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n - 2))
SECRETS = [f'token = "{hexes(40)}"' for _ in range(60)] + [f"api_key: {mixed(32)}" for _ in range(30)]
FALSE = [f"card {rng.randrange(10**15, 10**16)} paid" for _ in range(60)]
FALSE += [f'commit "{hexes(40)}" merged' for _ in range(30)] + [f"the-ordinary-words-of-page-{i}" for i in range(30)]
PROSE = "the ordinary words of every page are about nothing in particular"


def corpus():
    rows = [(i, f"{PROSE} {x} {PROSE}") for i, x in enumerate(SECRETS)]
    return rows + [(1000 + i, f"{PROSE}\n{x}\n{PROSE}") for i, x in enumerate(FALSE)]


EDGES = [
    (1, None), (2, ""), (3, "x" * 300_000), (4, "1" * 100_000), (None, f'é😀 token = "{hexes(40)}"'), (5, '"' * 500),
    (6, f"{hexes(20)} " * 3000), (7, "a token"), (7, f'secret="{hexes(32)}" {hexes(32)}'), (8, "-----BEGIN RSA PRIVATE KEY-----"),
]


def brute_candidates(text):
    return [(m.start(), m.group()) for m in regex.finditer(S.CANDIDATE, text or "")]


def test_candidates_with_their_places(docs):
    rows = EDGES + corpus() + [(7, "a token")]
    got = S.candidates(S._rows(docs(rows), "doc_id", "text", None)).collect()
    found = sorted((r.id, r.start, r.value) for r in got)
    low = -(2**63)
    assert found == sorted((low if i is None else i, a, v) for i, t in set(rows) for a, v in brute_candidates(t))


def test_the_forest_takes_false_alarms_out(docs):
    got = S.findings(docs(corpus())).collect()
    secrets = {r.doc_id for r in got if r.is_secret}
    assert {i for i, t in corpus() if i < 1000} <= secrets
    assert not {i for i in secrets if i >= 1000}
    assert {r.doc_id for r in got} >= {1000 + i for i in range(90)}


def test_learns_from_given_findings(spark, docs):
    """Told otherwise, the forest judges otherwise."""
    rows = corpus()
    given = [(i, a, int(i >= 1000)) for i, t in rows for a, _ in brute_candidates(t)]
    labels = spark.createDataFrame(given, "doc_id long, start int, label int")
    got = S.findings(docs(rows), labels=labels).collect()
    right = [r.is_secret == (r.doc_id >= 1000) for r in got]
    assert sum(right) / len(right) > 0.95


def test_coverage_by_words_of_the_corpus(docs):
    rows = [(1, "ordinary words"), (2, "ordinary page"), (3, "x-ordinary-page-zzz-12345")]
    keyed = S._rows(docs(rows), "doc_id", "text", None)
    found = S.candidates(keyed)
    assert [r.letters for r in S.coverage(found, keyed).collect()] == [len("ordinary") + len("page")]


def test_redaction(docs):
    rows = corpus() + [(i and i + 5000, t) for i, t in EDGES]
    df = docs(rows).withColumn("n_chars", F.col("n_chars").cast("int"))
    out = S.redact(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    texts = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == len(rows)
    for i, t in corpus():
        if i < 60:
            assert texts[i].text == f'{PROSE} token = "{S.MARK}" {PROSE}'
            assert texts[i].n_chars == len(texts[i].text)
        elif i >= 1000:
            assert texts[i].text == t
    null_id = [r.text for r in out.collect() if r.doc_id is None]
    assert null_id == [f'é😀 token = "{S.MARK}"']


@pytest.mark.parametrize("rows", [[], [(1, "no candidates here")], [(1, "card 1234567890123456")]])
def test_too_little_to_learn_from(docs, rows):
    """Without both kinds of labelled findings every score is the share of secrets among them."""
    assert not [r for r in S.findings(docs(rows)).collect() if r.is_secret]
    assert sorted(map(tuple, S.redact(docs(rows)).collect())) == sorted(map(tuple, docs(rows).collect()))


def test_query_finds_the_planted_tokens(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    planted = {(r.doc_id, m.start(1)) for r in rows for m in regex.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    got = QUERIES["op7_secret_scan"](spark, sf).collect()
    assert {(r.doc_id, r.start) for r in got if r.is_secret} == planted
    assert len(got) == sum(len(brute_candidates(r.text)) for r in rows)


def test_context_reaches_over_neighbouring_candidates(docs):
    """A quoted key name is a candidate itself, and its value still sees it."""
    values = [mixed(24) for _ in range(4)]
    texts = [
        f'{{"password": "{values[0]}"}}',
        f'{{"user_name": "somebody", "api_token": "{values[1]}"}}',
        f"x['client_secret'] = '{values[2]}' # live",
    ]
    texts.append(f'{PROSE} ' + " ".join(f'"{mixed(8)}"' for _ in range(12)) + f' "{values[3]}"')
    rows = S._rows(docs(list(enumerate(texts))), "doc_id", "text", None)
    got = {(r.id, r.value): r for r in S.candidates(rows).collect()}
    assert len(got) > 15
    for (i, v), r in got.items():
        assert r.before == texts[i][max(0, r.start - S.BEFORE) : r.start]
        assert r.after == texts[i][r.start + len(v) :][: S.AFTER]
    rows = corpus() + [(5000 + i, t) for i, t in enumerate(texts[:3])]
    found = S.findings(docs(rows)).where("doc_id >= 5000 and is_secret").collect()
    assert {(r.doc_id, r.start) for r in found} == {(5000 + i, texts[i].index(values[i])) for i in range(3)}


def test_private_keys_to_their_end_line(docs):
    body = "\n".join("".join(rng.choice(string.ascii_letters + "+/") for _ in range(64)) for _ in range(20))
    whole = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    cut_off = "-----BEGIN PRIVATE KEY-----\nabc -----BEGIN CERTIFICATE-----"
    out = S.redact(docs(corpus() + [(5000, f"{PROSE}\n{whole}\n{PROSE}"), (5001, f"{PROSE} {cut_off}")]))
    texts = {r.doc_id: r.text for r in out.where("doc_id >= 5000").collect()}
    assert texts[5000] == f"{PROSE}\n{S.MARK}\n{PROSE}"
    assert texts[5001] == f"{PROSE} {S.MARK}\nabc -----BEGIN CERTIFICATE-----"


def test_a_repeated_secret_does_not_cover_itself(docs):
    """One key in several documents, some of them copies, is found in each."""
    value = "".join(rng.choice(string.ascii_letters) for _ in range(30)) + "7"
    texts = [f"{PROSE} number {i // 2} api_key: {value} {PROSE}" for i in range(8)]
    rows = corpus() + [(5000 + i, t) for i, t in enumerate(texts)]
    keyed = S._rows(docs(rows), "doc_id", "text", None)
    found = S.candidates(keyed)
    assert not S.coverage(found.where("id >= 5000"), keyed).collect()
    got = S.findings(docs(rows)).where("doc_id >= 5000").collect()
    assert len(got) == 8 and all(r.is_secret for r in got)


def test_dictionary_words_follow_the_number_of_texts(docs):
    """A run that two texts hold by chance is no word of a large corpus; copies count once."""
    rows = [(i, f"ordinary page{i}x") for i in range(20_001)] + [(30_000 + i, "zqj") for i in range(9)]
    rows += [(40_000, "also zqj"), (50_000, "ordinary-zqj-12345678")]
    keyed = S._rows(docs(rows), "doc_id", "text", None)
    assert [r.letters for r in S.coverage(S.candidates(keyed), keyed).collect()] == [len("ordinary")]


def test_rare_secrets_are_in_the_sample(docs):
    """The bounded sample is drawn for each class, so a few secrets among many numbers are learned and found."""
    rows = [(i, f"{PROSE} {x} {PROSE}") for i, x in enumerate(SECRETS[:4])]
    rows += [(1000 + i, f"{PROSE} card {10**15 + i * 7919} paid {PROSE}") for i in range(2000)]
    got = S.findings(docs(rows), params=S.ScanParams(max_labelled=40)).where("is_secret").collect()
    assert {r.doc_id for r in got} == set(range(4))


def test_one_class_falls_back_to_the_rules(docs):
    """Where the rules mark secrets only, findings that they do not mark are not taken for secrets."""
    rows = [(1, f'{PROSE} token = "{hexes(40)}"'), (2, f"{PROSE} {mixed(30)} {PROSE}")]
    assert {r.doc_id: r.score for r in S.findings(docs(rows)).collect()} == {1: 1.0, 2: 0.0}
