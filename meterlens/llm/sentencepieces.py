"""SentencePiece BPE by a table of each prefix's last token.

For every prefix of a text there is exactly one last token that its encoding can end with. So the encoding of a text
follows from a table over its prefixes: an automaton over all pieces names the pieces that end at a position; of these
the one is right whose left neighbour, the last token of the prefix before it, is *compatible* with it: side by side
the two stay as they are. The ids are then read from the table backwards.

Two tokens are compatible if no merge ever crosses the border between them. Each piece has one way of being built from
two pieces, so the tokens that touch the border while the two pieces are built are known, and undoing the merges from
the last to the first shows whether any pair across the border would have been merged before one of its halves was
used up.

A text is cut where no piece can reach across: at pairs of neighbouring characters that stand together in no piece,
and around characters without a piece, which become bytes. The parts repeat a lot, so a worker remembers the ids of
the parts it has met, in a memo of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.worker import kept

SPACE = "▁"
#: Entries of a worker's memos: words with their marks, parts of words, pairs of tokens; and the longest key kept.
MEMO_WORDS = 400_000
MEMO_PARTS = 400_000
MEMO_PAIRS = 1_000_000
MEMO_CHARS = 64
#: Marks that often end a word.
MARKS = ",.!?;:*%&#$|"


class PieceTable:
    """Encoder and decoder equal to the library's for BPE models with byte fallback and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import ahocorasick  # needed in the workers only
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = library.get_piece_size()
        self.end_id = library.eos_id()
        self.unknown = library.unk_id()
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.control = {i for i in range(count) if library.is_control(i)}
        plain = [
            i for i in range(count)
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        ]
        self.piece = {i: library.id_to_piece(i) for i in range(count)}
        self.id_of = {self.piece[i]: i for i in plain}
        # Merges with a higher score go first: the rank counts them from 0.
        order = sorted(plain, key=lambda i: -library.get_score(i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.chars = {p for p in self.id_of if len(p) == 1} - {SPACE}
        self.neighbours = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.simple = {i: self.piece[i] for i in plain} | {i: "" for i in self.control}
        self.simple |= {self.bytes[b]: chr(b) for b in range(128)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for i in sorted(plain, key=lambda i: len(self.piece[i])):
            self._build(i)
        self.automaton = ahocorasick.Automaton()
        for i, halves in self.halves.items():
            self.automaton.add_word(self.piece[i], (len(self.piece[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _build(self, i: int) -> None:
        """Finds the halves of a piece by merging its characters; leaves out pieces that no merging makes."""
        piece = self.piece[i]
        if len(piece) == 1:
            self.halves[i] = None
            return
        now = merge_pairs(piece, self.id_of, self.rank, stop=2)
        if now is None or len(now) != 2 or now[0] + now[1] != piece:
            return
        a, b = self.id_of[now[0]], self.id_of[now[1]]
        if a not in self.halves or b not in self.halves:
            return
        for half in (a, b):
            if self.halves[half] and self.rank[half] > self.rank[i]:
                raise ValueError(f"piece {piece!r} is merged before its half {self.piece[half]!r}")
        self.halves[i] = (a, b)
        self.whole[a, b] = i

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' joint text is just these two."""
        limit = (len(self.rank), 0)  # merges at or after this (rank, side) have been undone
        while True:
            over = self.whole.get((a, b))
            # Of equal merges the leftmost goes first: left half (0), across the border (1), right half (2).
            if over is not None and (self.rank[over], 1) < limit:
                return False
            left = (self.rank[a], 0) if self.halves[a] else (-1, 0)
            right = (self.rank[b], 2) if self.halves[b] else (-1, 2)
            if left[0] < 0 and right[0] < 0:
                return True
            if left > right:
                limit, a = left, self.halves[a][1]
            else:
                limit, b = right, self.halves[b][0]

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a part whose characters all have pieces: the table of last tokens, read backwards."""
        known = self.parts.get(part)
        if known is not None:
            return known
        n = len(part)
        last, length = [0] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for at, (size, i) in self.automaton.iter(part):
            at += 1
            if length[at]:
                continue
            if size < at:
                left = last[at - size]
                fits = pairs.get(left << 20 | i)
                if fits is None:
                    if len(pairs) > MEMO_PAIRS:
                        pairs.clear()
                    fits = pairs[left << 20 | i] = self.compatible(left, i)
                if not fits:
                    continue
            last[at], length[at] = i, size
        ids = []
        while n:
            ids.append(last[n])
            n -= length[n]
        known = tuple(reversed(ids))
        if len(part) <= MEMO_CHARS:
            if len(self.parts) > MEMO_PARTS:
                self.parts.clear()
            self.parts[part] = known
        return known

    def _cut(self, word: str) -> tuple[int, ...]:
        """Ids of any text with marked spaces, cut at every border that no piece crosses."""
        ids: list[int] = []
        start = 0
        for k in range(1, len(word) + 1):
            if k < len(word) and word[k - 1 : k + 1] in self.neighbours:
                continue
            part = word[start:k]
            start = k
            if part in self.id_of or len(part) > 1:
                ids += self._part(part)
            else:
                ids += [self.bytes[b] for b in part.encode()]
        return tuple(ids)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of the text between two spaces, with the space before it."""
        core = word.rstrip(MARKS)
        if core and self.chars.issuperset(core):
            marks = word[len(core) :]
            if not marks:
                return self._part(SPACE + core)
            if core[-1] + marks[0] not in self.neighbours:
                return self._part(SPACE + core) + self._part(marks)
        return self._cut(SPACE + word)

    def encode(self, text: str) -> list[int]:
        """The ids of one text, without an end id."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            # Runs of spaces stay together with the word after them.
            ids: list[int] = []
            for word in re.findall(r" *[^ ]+| +", " " + text):
                ids += self._cut(word.replace(" ", SPACE))
            return ids
        words, ids = self.words, []
        for word in text.split(" "):
            known = words.get(word)
            if known is None:
                known = self._word(word)
                if len(word) <= MEMO_CHARS:
                    if len(words) > MEMO_WORDS:
                        words.clear()
                    words[word] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids say nothing, runs of byte ids are read as UTF-8."""
        simple = self.simple
        try:
            text = "".join([simple[i] for i in ids])
        except KeyError:
            text = None
        if text is not None and ids and ids[0] not in self.control and ids[0] not in self.byte_of:
            return text.removeprefix(SPACE).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                first = False
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i in self.control:
                continue
            if i == self.unknown:
                out.append(" ⁇ ")
            elif first:
                out.append(self.piece[i].removeprefix(SPACE))
            else:
                out.append(self.piece[i])
            first = False
        if raw:
            out.append(_utf8(raw))
        return "".join(out).replace(SPACE, " ")


def _utf8(raw: bytearray) -> str:
    """UTF-8 text; every byte that is part of no character becomes a replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def merge_pairs(text: str, id_of: dict[str, int], rank: dict[int, int], stop: int = 1) -> list[str] | None:
    """Plain BPE: merge the best pair, the leftmost of equals, until none is left or ``stop`` parts remain."""
    parts = list(text)
    if any(c not in id_of for c in parts):
        return None
    while len(parts) > stop:
        best = min(
            ((rank[id_of[parts[k] + parts[k + 1]]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in id_of),
            default=None,
        )
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def piece_table(path: str) -> PieceTable:
    """The table of a model file, built once per worker."""
    return kept(("pieces", path), lambda: PieceTable(path))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def encode(
    documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True
) -> DataFrame:
    """(doc_id, ids): one row per input row. Null and empty texts have the end id alone (or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        end = [table.end_id] if add_end else []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [table.encode(t.as_py()) + end for t in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return _texts(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        for batch in batches:
            texts = [table.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(
    documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded again from the ids.

    Encoding and decoding share one pass, so the ids, several times the text in size, never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        sha, digits = hashlib.sha256, [str(i) for i in range(len(table.piece))]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = [*table.encode(text.as_py()), table.end_id]
                rows.append(
                    (
                        len(ids),
                        sha(" ".join([digits[i] for i in ids]).encode()).hexdigest(),
                        sha(table.decode(ids).encode()).hexdigest(),
                    )
                )
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(documents, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
