"""Exact byte-pair encoding inside tasks, with bounded memos of short pieces.

Both vocabularies split a text before any merge, and no split unit crosses a *safe cut*: a place after a
character that isn't white space and before a space or a line feed. So a text's ids are the ids of its
pieces between safe cuts, joined. Pieces repeat, so their ids are kept in a dict of bounded size; a piece of
printable ASCII and Latin-1 letters that isn't there is split by a pattern (normalisation leaves such letters
alone) and merged by the library's own model, any other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Split units whose ids a worker keeps. It bounds memory only: a full memo is emptied and filled anew.
MEMO = 600_000

_FAST = re.compile("[ \\n]*[!-~À-ÖØ-öø-ÿ]+")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Texts whose white space isn't single spaces and line feeds, or that hold the mark \x01, for RE2.
_UNEVEN = r"[ \n][ \n]|[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]$"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SLOW = rf"[^ \n!-~{_LETTER}]"
#: How either vocabulary splits text of the fast kind: fixed values, the vocabularies' own patterns for these letters.
_BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
#: The same for RE2 and evenly spaced text.
_BYTE_UNIT = rf"('s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s)"
_WORD_UNIT = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+)"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Results of a function of short strings, MEMO of them at most."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key: str) -> bytes:
        out = self.function(key)
        if len(self) >= MEMO:
            self.clear()
        if len(key) < 64:
            self[key] = out
        return out


class Encoder:
    """ids of a text as bytes: little-endian unsigned 32-bit integers. plain: special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.split = _WORD_SPLIT if self.lower else _BYTE_SPLIT
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)))
        self.letters = [byte_letters()[b] for b in range(256)]
        self.packed = [self.pack([i]) for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.units = _Memo(self.unit)
        self.pieces = _Memo(self.piece)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> bytes:
        plain = unit if unit.isascii() and unit.isprintable() and " " not in unit else "".join([self.letters[b] for b in unit.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(plain)])

    def piece(self, piece: str) -> bytes:
        if _FAST.fullmatch(piece) and not self.added.search(piece):
            return b"".join([self.units[u] for u in self.split.findall(piece.lower() if self.lower else piece)])
        return self.whole(piece)

    def cuts(self, text: str) -> list[str]:
        """The pieces of a text between safe cuts."""
        return _CUT.split(text) if _ODD_SPACE.search(text) else _PIECE.findall(text)

    def encode(self, text: str) -> bytes:
        if self.lower:  # white space is dropped, so the bare words will do
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.pieces.__getitem__, self.cuts(text)))

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets among them; null is empty.

        The distinct pieces of the column are looked up once each."""
        texts = pc.fill_null(texts, "")
        if not self.lower:
            uneven = pc.match_substring_regex(texts, _UNEVEN)
            if pc.any(uneven).as_py():
                slow = [self.encode(t) if u else None for t, u in zip(texts.to_pylist(), uneven.to_pylist(), strict=True)]
                even, offsets = self._even(pc.if_else(uneven, "", texts))
                parts = [s if s is not None else even[offsets[i] : offsets[i + 1]].tobytes() for i, s in enumerate(slow)]
                return np.frombuffer(b"".join(parts), "<u4"), np.r_[0, np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)]
        return self._even(texts)

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n"), "\x01")
        coded = parts.flatten().dictionary_encode()
        ids = self._pieces(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(ids) + 1][np.asarray(parts.offsets) - parts.offsets[0].as_py()] // 4
        return np.frombuffer(data, "<u4") if data is not None else np.empty(0, "<u4"), at

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces: those of the fast kind are cut into units, whose distinct ones are looked up."""
        slow = pc.or_(pc.match_substring_regex(pieces, _SLOW), pc.match_substring_regex(pieces, self.added.pattern))
        fast = pc.if_else(slow, "", pieces)
        if self.lower:
            fast = pc.utf8_lower(fast)
        units = pc.split_pattern(pc.replace_substring_regex(fast, _WORD_UNIT if self.lower else _BYTE_UNIT, "\\1\x01"), "\x01")
        coded = units.flatten().dictionary_encode()
        memo = self.units
        ids = pa.array([memo[u] for u in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(ids) + 1][np.asarray(units.offsets) - units.offsets[0].as_py()]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.ascontiguousarray(at)), data])
        if pc.any(slow).as_py():
            where = pc.indices_nonzero(slow).to_pylist()
            out = pc.replace_with_mask(out, slow, pa.array([self.whole(pieces[i].as_py()) for i in where], pa.large_binary()))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each Python worker, which tasks share."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


class Decoder:
    """Text of ids, as the byte-level decoder joins it."""

    def __init__(self, path: str, plain: bool = False):
        tokenizer = encoder(path, plain).tokenizer
        back = {c: b for b, c in byte_letters().items()}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.table = pa.array([self.bytes.get(i) for i in range(1 + max(self.bytes))], pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[i]:offsets[i + 1]], for each i."""
        taken = self.table.take(pa.array(ids))
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)[: len(taken) + 1][offsets]
        whole = memoryview(data) if data is not None else b""
        return [str(whole[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]
