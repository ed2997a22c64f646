"""64-bit hashes of the words of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text hashed at a time; a longer text is hashed alone.
PART = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
#: The low bytes of a lane of 8, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def joined(lengths: np.ndarray) -> np.ndarray:
    """Where each of some runs laid end to end begins, and where the last one ends."""
    return np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)))


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (lengths[0] numbers), then those from begin[1], and so on."""
    at = joined(lengths)
    return np.repeat(begin - at[:-1], lengths) + np.arange(at[-1])


def parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, hashes, bounds) of consecutive rows; the words of the k-th have hashes[bounds[k]:bounds[k + 1]]."""
    size = joined(pc.binary_length(batch.column(text)).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, size[at] + PART, side="right")) - 1)
        rows = batch.slice(at, stop - at)
        yield rows, *word_hashes(rows.column(text))
        at = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (no nulls), and the bounds of each text's words among them.

    Words are what stands between blanks (space, 09-0D); equal words have equal hashes.
    """
    texts = texts.cast(pa.large_binary())
    _, places, held = texts.buffers()
    at = np.frombuffer(places, dtype=np.int64)[texts.offset :][: len(texts) + 1]
    low, n = int(at[0]), int(at[-1] - at[0])
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(held, dtype=np.uint8)[low : low + n]
    at = at - low
    word = (data - np.uint8(9) > 4) & (data != 32)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = np.flatnonzero(np.diff(at))
    first[at[filled]] = word[at[filled]]
    last[at[filled + 1] - 1] = word[at[filled + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes(data, start, end - start), np.searchsorted(start, at).astype(np.int64)


def _hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of data[start:start + length], 8 bytes at a time."""
    lanes = np.concatenate((data, np.zeros(16 - len(data) % 8, dtype=np.uint8))).view("<u8")
    of, h = slice(None), mixed(length.astype(np.uint64))
    for done in range(0, LONG, 8):
        if done:
            of = np.flatnonzero(length > done)
            if not len(of):
                break
        at = start[of] + done
        shift, at = ((at & 7) << 3).astype(np.uint64), at >> 3
        # Shifted twice, since by 64 at once is not defined.
        lane = (lanes[at] >> shift) | (lanes[at + 1] << (np.uint64(63) - shift) << np.uint64(1))
        h[of] = mixed(h[of] ^ (lane & _LOW[np.minimum(length[of] - done, 8)]))
    for k in np.flatnonzero(length > LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + length[k]])
    return h
