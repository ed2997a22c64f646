import hashlib
import random
import re
from collections import defaultdict

import pytest

from meterlens.llm import chat as C
from meterlens.llm.catalog import QUERIES
from meterlens.llm.queries_chat import TRICKY

SCHEMA = "conv_id long, turn long, role string, text string, start long, span string, key int"


@pytest.fixture(scope="module")
def chats(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def order(rows):
    low = -(2**63)
    out = defaultdict(list)
    for c, n, r, t in rows:
        out[c].append((low if n is None else n, r or "", t or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in out.items()}


def brute(rows):
    """Without the windows: what must come back whatever they are."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in order(rows).items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha(said), len(learned), sha(learned))
    return out


def got(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def made(seed, n=60):
    rng = random.Random(seed)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", C.START, C.END, "<\\s>", "<\\\\|im_end|>", "\\",
            "<", "[", "|im_end|>\n", "a b. ", "é😀", "\n", "%0A", "<|im_end|>", "$1", ""]
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, 40)):
            role = rng.choice(["user", "assistant", "assistant", "tool\nx%", "system", "<s>"]) if k else rng.choice(["system", "user"])
            rows.append((c, k, role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 10, 60, 300])))))
    return rows


EDGES = [
    (1, 0, "system", "only a system turn"), (2, 0, "system", "long " * 3000), (2, 1, "assistant", "short"),
    (3, 0, "assistant", "x " * 60_000), (3, 1, "user", None), (4, None, None, None), (4, 0, "assistant", ""),
    (None, 1, "user", "no id"), (None, 0, "assistant", "really"), (5, 1, "user", "twice"), (5, 1, "user", "twice"),
    (6, 0, "assistant", "a"), (6, 1, "system", "late system"), (6, 2, "assistant", TRICKY),
]


@pytest.mark.parametrize("params", [C.ChatParams(), C.ChatParams(64, 16, 4), C.ChatParams(10, 9, 1), C.ChatParams(300, 0)])
def test_turns_and_targets_come_back(chats, params):
    rows = made(9) + [(c if c is None else c + 1000, n, r, t) for c, n, r, t in EDGES]
    formatted = C.windows(chats(rows), params)
    assert got(C.conversation_digests(formatted)) == brute(rows)


def test_windows_keep_the_budget_and_repeat_what_they_should(chats):
    p = C.ChatParams(120, 40, 4)
    rows = [r for r in made(10) if len(r[3]) < 150]
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t)) + p.overhead
    turns = order(rows)
    seen = defaultdict(int)
    for w in sorted(C.read_turns(C.windows(chats(rows), p)).collect(), key=lambda r: (r.conv_id, r.span)):
        mine = turns[w.conv_id]
        system = mine[0][0] == "system" and len(mine) > 1
        first = seen[w.conv_id] == 0
        assert len(w.turns) >= 1 and w.over_budget == (w.n_tokens > p.budget)
        assert [(t.role, t.text) for t in w.turns] == mine[seen[w.conv_id] :][: len(w.turns)]
        past = w.n_repeated - (0 if first or not system else 1)
        assert sum(count(t) for _, t in mine[seen[w.conv_id] - past : seen[w.conv_id]]) <= p.history
        assert w.text.count(C.START) == w.n_turns
        if system:
            assert w.text.startswith(f"{C.START}system\n")
        if all(count(t) <= 10 for _, t in mine):
            assert w.n_tokens <= p.budget
        seen[w.conv_id] += len(w.turns)
    assert {c: len(t) for c, t in turns.items()} == dict(seen)


def test_history_is_repeated_and_not_learned_again(chats):
    rows = [(1, k, "assistant" if k % 2 else "user", f"w{k} " * 20) for k in range(40)]
    read = C.read_turns(C.windows(chats(rows), C.ChatParams(200, 60, 4))).collect()
    assert any(r.n_repeated for r in read)
    learned = [t for r in sorted(read, key=lambda r: r.span) for t in r.learned]
    assert learned == [t for _, _, r, t in rows if r == "assistant"]


def test_empty_table(chats):
    assert C.conversation_digests(C.windows(chats([]))).count() == 0


def test_query_reads_everything_back(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]
    assert got(QUERIES["op4_chat_windows"](spark, sf)) == brute(rows)
