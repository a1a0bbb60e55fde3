"""Exact, fast token ids from the files of public tokenizers.

A byte-pair tokenizer never merges across the pieces that its pre-tokenizer cuts, so the
ids of a text are the ids of its pieces in turn. Words repeat, so each worker keeps the ids
of pieces it has met; a text with characters on which regular-expression libraries might
differ goes through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Anything outside printable ASCII, common white space and the Latin blocks.
_UNSURE = re.compile("[^\\x09\\x0a\\x0d\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u012f\\u0132-\\u024f]")
#: Pieces of the two known pre-tokenizers (fixed values of those files).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT_PIECES = 350_000
#: Letters, numbers and white space among the characters that _UNSURE lets through.
_PLAIN = {r"\p{L}": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f", r"\p{N}": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\s": "\t\n\r "}


def _plain(pattern: str) -> re.Pattern:
    """``pattern`` for texts that _UNSURE lets through, with character sets spelt out."""
    pattern = pattern.replace(r"\S", "[^" + _PLAIN[r"\s"] + "]")
    out, inside = [], False
    for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\s|\[|\])", pattern):
        inside = part == "[" or inside and part != "]"
        out.append((_PLAIN[part] if inside else f"[{_PLAIN[part]}]") if part in _PLAIN else part)
    return re.compile("".join(out))


class _PieceIds(dict):
    """Piece -> its ids, for the pieces met of late; those still in use come back from the older half."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > _KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            got = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = got
        return got


class TextEncoder:
    """``encode(text) -> bytes`` of little-endian unsigned 32-bit ids, then ``end_id``.

    As the library does by default, a text's strings of added tokens become their ids; such a text goes
    through the tokenizer whole. ``None`` counts as empty.
    """

    def __init__(self, path: str, end_id: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.unsure = re.compile("|".join([_UNSURE.pattern, *added]), re.I)
        self.lower, self.pieces = False, None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.pieces = _plain(_BYTE_LEVEL)
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            steps = pre.get("pretokenizers", [])
            if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1].get("use_regex", True):
                self.pieces, self.lower = _plain(steps[0]["pattern"]["Regex"]), True
        self.ids = _PieceIds(self.tokenizer)
        self.end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.pieces is None or self.unsure.search(text):
            whole = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.asarray(whole, "<u4").tobytes() + self.end
        if self.lower:
            text = unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.ids.__getitem__, self.pieces.findall(text))) + self.end


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None = 1) -> TextEncoder:
    """One encoder a process: later tasks of a worker find its pieces again."""
    return TextEncoder(path, end_id)
