"""Exact bulk encoding with files of the tokenizers library.

Texts are cut at borders that no pre-token reaches over, whatever stands around them: before white
space that follows something else, and between a Latin letter and an ASCII mark. Equal chunks are
found by vectorised hashes, so each distinct chunk of many texts is looked up, or encoded, once.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Distinct chunks remembered by a worker before the older half of the memo goes: bounds memory, never changes ids.
MEMO_ENTRIES = 350_000
#: Longer chunks, in bytes, are neither remembered nor told apart by the vectorised hashes.
MEMO_CHUNK = 64

#: White space other than space, tab, newline and carriage return, by any common definition.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -​    　]")
#: The apostrophe is no mark here, as it may join letters, nor the bar, which is part of special tokens.
_MARKS = b".,!?;:*$%&#)"
_SPACE, _LETTER, _MARK, _ODD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\r\n")] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(_MARKS)] = _MARK
_CLASS[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = _ODD  # bytes that an odd space begins with
#: Byte-level BPE writes a byte as the character of that code if it is printable, else as the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: What keeps the first n of eight bytes, read as a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Odd multipliers of hashes, for the words of a chunk, twice, and for two words and a length.
_MULTIPLIERS = (np.arange(1, 2 * MEMO_CHUNK // 8 + 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class BulkTokenizer:
    """Ids of whole texts; each text's equal tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: The vocabularies here either normalise and drop white space, or keep all of a text.
        self.drops_space = self.tokenizer.normalizer is not None
        #: Letters alone, after at most one space, are one pre-token, which the BPE model can take directly.
        self.plain = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.memo_entries = memo_entries
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks, each on its own: by the model where a chunk is a pre-token, else by the whole library."""
        plain, tokenize, out, rest = self.plain, self.model.tokenize, [], []
        for chunk in chunks:
            text = chunk.decode()
            if plain(text):
                if self.drops_space:
                    text = text.lstrip(" ").lower()
                    if len(text) < len(chunk) and not text.isascii():
                        text = text.encode().decode("latin-1").translate(_BYTE_LETTERS)
                else:
                    text = chunk.decode("latin-1").translate(_BYTE_LETTERS)
                out.append(np.array([t.id for t in tokenize(text)], "<u4").tobytes())
            else:
                rest.append((len(out), text))
                out.append(b"")
        for (i, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _lookup(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.memo_entries:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        found = list(map(memo.get, chunks))
        gaps = [i for i, x in enumerate(found) if x is None]
        missing = []
        for i in gaps:
            if (ids := older.get(chunks[i])) is None:
                missing.append(i)
            else:
                found[i] = memo[chunks[i]] = ids
        for a in range(0, len(missing), 8192):
            part = missing[a : a + 8192]
            for i, ids in zip(part, self._ids([chunks[i] for i in part])):
                found[i] = ids
                if len(chunks[i]) <= MEMO_CHUNK:
                    memo[chunks[i]] = ids
        return found

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start; a text's first byte is always one of these."""
        kind = _CLASS[data]
        letter = kind == _LETTER
        # The second byte of a two-byte Latin letter; 0xD7 and 0xF7 are signs.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        space = kind == _SPACE
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = (space[1:] & ~space[:-1]) | (letter[:-1] & (kind[1:] == _MARK))
        if not self.drops_space:  # borders beside rarer white space depend on more context: such a text stays whole
            odd = np.flatnonzero(kind == _ODD)
            for d in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
                a, b = int(offsets[d]), int(offsets[d + 1])
                if _ODD_SPACE.search(data[a:b].tobytes().decode()):
                    start[a + 1 : b] = False
        start[offsets[:-1]] = True
        return np.flatnonzero(start[:-1])

    @staticmethod
    def _groups(data: np.ndarray, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One chunk for each distinct content, and for each chunk which of these it equals.

        Chunks of up to 16 bytes are two words and a length, and so compared as they are; for longer ones
        these are hashes, and neighbours of equal hash are compared byte by byte. A collision at worst
        tells equal chunks apart, which costs time and changes no id.
        """
        padded = np.concatenate([data, np.zeros(MEMO_CHUNK + 8, np.uint8)])
        words = np.ndarray(len(data) + MEMO_CHUNK, "<u8", padded, strides=(1,))  # the eight bytes from each place on

        def word(k: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
            return words[at + 8 * k] & _FIRST[np.clip(n - 8 * k, 0, 8)]

        first, second, size = word(0, starts, lengths), word(1, starts, lengths), lengths.astype(np.uint64)
        long = np.flatnonzero(lengths > 16)
        if len(long):
            parts = [word(k, starts[long], lengths[long]) for k in range(MEMO_CHUNK // 8)]
            first[long], second[long] = (sum(p * m for p, m in zip(parts, _MULTIPLIERS[3 + half :: 2])) for half in (0, 1))
            for i in long[lengths[long] > MEMO_CHUNK].tolist():
                a = int(starts[i])
                first[i], second[i] = np.frombuffer(blake2b(raw[a : a + int(lengths[i])], digest_size=16).digest(), np.uint64)
        mixed = (first * _MULTIPLIERS[0]) ^ (second * _MULTIPLIERS[1]) ^ (size * _MULTIPLIERS[2])
        order = np.argsort(mixed ^ (mixed >> np.uint64(31)))
        new = np.ones(len(order), bool)
        new[1:] = False
        for key in (first, second, size):
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        check = np.flatnonzero(~new & (size[order] > 16))
        if len(check):
            a, b = order[check], order[check - 1]
            differ = np.zeros(len(check), bool)
            for k in range(MEMO_CHUNK // 8):
                differ |= word(k, starts[a], lengths[a]) != word(k, starts[b], lengths[b])
            for i in np.flatnonzero(lengths[a] > MEMO_CHUNK).tolist():
                x, y, n = int(starts[a[i]]), int(starts[b[i]]), int(lengths[a[i]])
                differ[i] = raw[x : x + n] != raw[y : y + n]
            new[check[differ]] = True
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and where each text's begin, with the end. Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = self._starts(data, offsets)
        if self.drops_space:
            data = np.where(_CLASS[data] == _SPACE, np.uint8(32), data)
        lengths = np.diff(starts, append=len(data))
        raw = data.tobytes()
        chosen, group = self._groups(data, raw, starts, lengths)
        begin, end = starts[chosen].tolist(), (starts[chosen] + lengths[chosen]).tolist()
        ids = self._lookup([raw[a:b] for a, b in zip(begin, end)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = np.cumsum(sizes) - sizes
        count = sizes[group]
        ends = np.cumsum(count)
        tokens = flat[np.repeat(at[group] - (ends - count), count) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])
        return tokens, upto[np.searchsorted(starts, offsets)]


@lru_cache(4)
def bulk_tokenizer(path: str, memo_entries: int = MEMO_ENTRIES) -> BulkTokenizer:
    """One a Python worker: later tasks find what earlier ones remembered."""
    return BulkTokenizer(path, memo_entries)
