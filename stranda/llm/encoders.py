"""Whole-text encoding with public tokenizers, with a bounded memory of words.

Texts are cut where the tokenizer's own rules always cut, so words can be encoded one by one and remembered; what isn't
remembered goes to the tokenizers library. The results are those of encoding the whole text at once. Lower-casing A to Z of ASCII texts
first changes nothing for a tokenizer that lower-cases.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stranda.llm import common

#: White space other than space, tab and line ends.
ODD = r"[\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters and digits that stay one letter or digit each when a tokenizer normalises and lower-cases them: basic Latin, Latin but for
#: U+0130, Greek, Cyrillic, and unified ideographs.
STEADY = r"A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}\x{388}-\x{38a}\x{38e}-\x{3a1}\x{3a3}-\x{3f5}\x{3f7}-\x{3ff}\x{400}-\x{481}\x{48a}-\x{52f}\x{4e00}-\x{9fa5}"
#: Pieces that are encoded in one go.
TOGETHER = 200


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole(column: pa.Array) -> pa.Array:
    """A text column as large strings of its own, nulls empty: some string kernels are wrong on slices."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.take(pa.array(np.arange(len(column))))


def split_dropping(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and where each text's words end (after a leading 0), for tokenizers that drop white space.

    Full stops and commas are words of their own in texts where letters or digits that no normalisation takes apart stand before all of them.
    """
    stops = pc.match_substring_regex(column, f"(^|[^{STEADY}])[.,]")
    split = pc.replace_substring(pc.replace_substring(column, ",", " ,"), ".", " .")
    parts = pc.ascii_split_whitespace(pc.if_else(stops, column, split))
    ends = parts.offsets.to_numpy()
    return parts.flatten(), ends - ends[0]


def split_keeping(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same with each word's leading space, for byte-level tokenizers; and which texts must be taken as a whole instead.

    A cut before a space is one that the tokenizer makes, unless another space comes before it or there is other white space; so
    is one before a full stop or comma in texts where letters or digits stand before all of them.
    """
    odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, "\0")), pc.match_substring_regex(column, ODD))
    marked = pc.replace_substring(pc.if_else(odd, pa.scalar("", pa.large_string()), column), " ", "\0 ")
    stops = pc.match_substring_regex(column, f"(^|[^{STEADY}])[.,]")
    split = pc.replace_substring(pc.replace_substring(marked, ",", "\0,"), ".", "\0.")
    parts = pc.split_pattern(pc.if_else(stops, marked, split), "\0")
    ends = parts.offsets.to_numpy()
    return parts.flatten(), ends - ends[0], np.array(odd, dtype=bool)


class Vocabulary:
    """Words by number; it starts anew when it would hold more than ``most``. ``learn`` and ``forget`` keep what goes with the words."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())

    def learn(self, new: pa.Array) -> None:
        self.words = pa.concat_arrays([self.words, new])

    def numbers(self, parts: pa.Array) -> np.ndarray:
        at = pc.index_in(parts, value_set=self.words)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False)
        missing = pc.is_null(at)
        coded = pc.dictionary_encode(parts.filter(missing))
        if len(self.words) + len(coded.dictionary) > self.most:
            self.forget()
            coded = pc.dictionary_encode(parts)
            self.learn(coded.dictionary)
            return coded.indices.to_numpy(zero_copy_only=False)
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
        out[missing.to_numpy(zero_copy_only=False)] = len(self.words) + coded.indices.to_numpy(zero_copy_only=False)
        self.learn(coded.dictionary)
        return out


class Encoder(Vocabulary):
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, drops_space: bool, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        normalizer = rules.get("normalizer") or {}
        kinds = [n["type"] for n in normalizer.get("normalizers", [normalizer]) if n]
        self.lowers = drops_space and kinds == ["NFC", "Replace", "Lowercase"]
        special = [t for t in rules["added_tokens"] if t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        self.border = (special[-1]["content"], special[-1]["id"]) if special else None
        self.drops_space = drops_space
        super().__init__(most)

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Pieces that aren't remembered: some at once, with a special token between them, which the tokenizer always cuts out first."""
        if not self.border or any(self.border[0][:2] in p for p in pieces):
            return self._each(pieces)
        mark, number = self.border
        out = []
        # Few at once: the library's encodings take far more memory than their ids.
        for i in range(0, len(pieces), 50 * TOGETHER):
            some = [mark.join(pieces[j : j + TOGETHER]) for j in range(i, min(i + 50 * TOGETHER, len(pieces)), TOGETHER)]
            for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                ids = np.array(e.ids, dtype="<u4")
                at = 4 * np.flatnonzero(ids == number)
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)], strict=True)]
        return out

    def forget(self) -> None:
        super().forget()
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int32)

    def learn(self, new: pa.Array) -> None:
        made = self._encode(new.to_pylist())
        super().learn(new)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 4)]).astype(np.int32)

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0].tobytes()

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow column; null counts as empty.

        Splitting texts and looking words up is left to Arrow; only words that aren't remembered come to Python.
        """
        column = whole(column)
        if self.drops_space:
            odd = np.zeros(len(column), bool)
            if self.lowers:
                column = pc.if_else(pc.string_is_ascii(column), pc.ascii_lower(column), column)
            words, ends = split_dropping(column)
        else:
            words, ends, odd = split_keeping(column)
        at = self.numbers(words)
        starts = self.ends[at]
        took = self.ends[at + 1] - starts
        stops = np.cumsum(took, dtype=np.int32)
        place = np.repeat(starts - (stops - took), took)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.ids[place]
        bounds = np.concatenate([[0], stops])[ends]
        out = [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.frombuffer(self._each([column[i].as_py()])[0], "<u4")
        if len(self.words) > self.most:  # a batch of so many different words isn't remembered
            self.forget()
        return out


_made: dict[tuple, Encoder] = common.held({})


def encoder(path: str, drops_space: bool, most: int = 700_000) -> Encoder:
    """One for each worker process, while its tasks use it."""
    common.asked(_made)
    key = (path, drops_space, most)
    if key not in _made:
        _made[key] = Encoder(path, drops_space, most)
    return _made[key]


def shift_tables() -> list[list[list[int]]]:
    """For each power of two, tables (4 x 256) that carry a CRC-32 over so many zero bytes, one byte of it at a time."""

    def times(matrix, vector):
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    out = []
    for k in range(3 + 40):
        if k >= 3:
            out.append([[times(step, b << 8 * i) for b in range(256)] for i in range(4)])
        step = [times(step, v) for v in step]
    return out


_shifts: list = []


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from its parts' (crc, bytes), in order."""
    if not _shifts:
        _shifts.extend(shift_tables())
    out = 0
    for crc, width in parts:
        k = 0
        while width and out:
            if width & 1:
                a, b, c, d = _shifts[k]
                out = a[out & 255] ^ b[out >> 8 & 255] ^ c[out >> 16 & 255] ^ d[out >> 24]
            width >>= 1
            k += 1
        out ^= crc
    return out
