"""A tokenizers-library encoder that remembers the pieces it has met.

For encoders that lower-case, drop white space and cut a text into runs of letters, single digits and runs of marks
before any merging: such a text's ids are those of its pieces, one after the other. Texts of Latin-1 letters and ASCII
are cut here, with the encoder's own pattern over single bytes, and each distinct piece is encoded by the library once
and remembered. Runs of letters are in the normalizer's form already, so they go, in the characters of the encoder's byte
table, to the library's model alone, without the steps before it. All other texts, and those with the strings of special tokens, go to the library whole.

A memo has a bounded number of entries; when it is full it becomes the older memo, whose entries are taken over as they
are met, and the one before is dropped.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from meterlens.llm.worker import kept

#: Entries of each memo of a worker.
MEMO_PIECES = 400_000
#: The settings under which a text's ids are those of its pieces, and the pattern of the pieces.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The pattern over Latin-1 bytes in lower case, where none but ASCII and letters occur.
_PIECES = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+"
_NEITHER = rb"[\x80-\xbf\xd7\xf7]"


class WordEncoder:
    """Encodes texts to arrays of ids, equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        known = json.loads(self.library.to_str())
        suffix = known["model"].get("end_of_word_suffix")
        steps = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            bool(suffix)
            and (known.get("normalizer") or {}).get("normalizers") == NORMAL
            and steps[0].get("pattern") == {"Regex": PATTERN}
            and [step["type"] for step in steps[1:]] == ["ByteLevel"]
        )
        self.word_end = np.zeros(self.vocab_size, dtype=bool)
        if self.by_piece:
            for piece, i in self.library.get_vocab(with_added_tokens=False).items():
                self.word_end[i] = piece.endswith(suffix)
        self.find, self.neither = re.compile(_PIECES).findall, re.compile(_NEITHER).search
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: set[bytes]) -> None:
        """Encodes pieces, many runs of letters in one text: the last id of each is marked as a word's end."""
        memo, runs = self.memo, []
        for piece in pieces:
            ids = self.older.get(piece)
            if ids is not None:
                memo[piece] = ids
            elif piece[0] >= 97 and piece[0] not in b"{|}~":
                runs.append(piece)
            else:
                memo[piece] = self._whole(piece.decode("latin-1")).tobytes()
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            text = b" ".join(some).decode("latin-1").translate(self.table)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, a = ids.tobytes(), 0
                for run, b in zip(some, (4 * ends).tolist()):
                    memo[run] = raw[a:b]
                    a = b
            else:
                memo.update((run, self._whole(run.decode("latin-1")).tobytes()) for run in some)

    def _cut(self, text: str) -> list[bytes] | None:
        """The pieces of a text; None if the library must see it whole."""
        if not self.by_piece or any(s in text for s in self.special):
            return None
        try:
            raw = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if self.neither(raw) else self.find(raw)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._cut(t) for t in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        self._learn(set().union(*[c for c in cut if c]).difference(self.memo))
        memo = self.memo
        return [
            self._whole(text) if pieces is None else np.frombuffer(b"".join([memo[p] for p in pieces]), dtype="<u4")
            for text, pieces in zip(texts, cut)
        ]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a file, opened once per worker."""
    return kept(("words", path), lambda: WordEncoder(path))
