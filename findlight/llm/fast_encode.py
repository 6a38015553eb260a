"""Whole-text encoding with the tokenizers library, each distinct word of a worker's texts encoded once."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

#: The normalizers, and the pattern that parts words, for which the short cut below is exact.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters up to here (but U+0130) lower one by one and compose with nothing among themselves; no white space but ASCII's is let through.
_LAST = 0x24F
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ɏ]*")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, _LAST + 1) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(1)
def _words() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies have for each byte: itself, or the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode(text)``: the ids as little-endian bytes of ``width`` each, equal to the library's own encode of the whole text.

    A tokenizer of the known shape never joins characters across white space or across its word pattern, so a
    text of plain letters is parted by that pattern and each distinct part is given to the library's model once;
    ``keep`` bounds the parts remembered, after which they are forgotten and met anew. Any other text, and any
    other tokenizer, goes to the library whole.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self.width = 2 if self._own.get_vocab_size() <= 1 << 16 else 4
        shape = json.loads(self._own.to_str())
        normalizer, split = shape.get("normalizer") or {}, shape.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        self._known = (
            shape["model"]["type"] == "BPE"
            and shape["model"].get("dropout") is None
            and [x["type"] for x in normalizer.get("normalizers", [])] == _NORMALIZERS
            and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and first.get("pattern") == {"Regex": _PATTERN}
            and (first.get("behavior"), first.get("invert")) == ("Removed", True)
            and not split["pretokenizers"][1]["add_prefix_space"]
            and not split["pretokenizers"][1]["use_regex"]
        )
        self._added = [x["content"] for x in shape["added_tokens"]]
        self._parts: dict[str, bytes] = {}
        self._keep = keep

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(_byte_letters())
        got = b"".join(t.id.to_bytes(self.width, "little") for t in self._own.model.tokenize(letters))
        if len(self._parts) >= self._keep:
            self._parts.clear()
        self._parts[part] = got
        return got

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self._known or not _PLAIN.fullmatch(text) or any(x in text for x in self._added):
            ids = self._own.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(self.width, "little") for i in ids)
        known, out = self._parts, []
        for part in _words().findall(text.lower()):
            got = known.get(part)
            out.append(self._part(part) if got is None else got)
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    return Encoder(path)
