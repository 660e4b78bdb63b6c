"""Token ids of whole texts with the tokenizers library, each distinct space-separated unit encoded once per cache."""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterable

import public_tokenizers
import regex

# Any white space but a single blank between two other characters keeps its neighbours in one unit.
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Units kept by one worker process; beyond that the cache starts anew, so memory stays bounded.
CACHE_UNITS = 800_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def split_units(text: str) -> list[str]:
    """Split at blanks that the byte-level pre-tokenizer always splits at, dropping the blank.

    The pre-tokenizer gives a single blank between two non-space characters to
    what follows, and never joins anything across it; so `` unit`` can be encoded
    alone. Other white space stays inside its unit.
    """
    odd = "  " in text or " \n" in text or "\n " in text or text.startswith(" ") or text.endswith(" ")
    if odd or (not text.isascii() and any(c in text for c in _OTHER_SPACE)) or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return _SAFE_BLANK.split(text)
    return text.split(" ")


def _worker_store() -> types.ModuleType:
    """One place per Python process, so that tasks of a reused worker share tokenizer and cache."""
    return sys.modules.setdefault("_labelloom_worker_store", types.ModuleType("_labelloom_worker_store"))


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, ``add_special_tokens=False``.

    With a byte-level tokenizer, texts are split into units and those into the pieces of its pre-tokenizer, and
    the library's model encodes each distinct piece. Texts that spell a special token, and all texts of
    other tokenizers, are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        step = self.tok.pre_tokenizer
        self.units = isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex and not step.add_prefix_space and self.tok.normalizer is None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.letters = _byte_letters()
        self.model = self.tok.model.tokenize
        self.after: dict[str, bytes] = {}  # units and pieces that follow a blank, without it
        self.bare: dict[str, bytes] = {}  # other pieces

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        kept = _worker_store().__dict__.setdefault("encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and letters, one piece."""
        got = self.after.get(word)
        if got is None:
            ids = self.model(self.letters[32] + word) if word.isascii() else self.model((" " + word).encode().decode("latin-1").translate(self.letters))
            got = self.after[word] = array("I", [t.id for t in ids]).tobytes()
        return got

    def _unit(self, unit: str) -> bytes:
        """Ids of the pieces of a unit; each piece is looked up first."""
        if unit[0] == " ":
            if unit[1:].isalpha():
                return self._word(unit[1:])
            if unit[-1] in ".,;:!?" and unit[1:-1].isalpha():
                end = self.bare.get(unit[-1])
                if end is None:
                    end = self.bare[unit[-1]] = self._piece(unit[-1])
                return self._word(unit[1:-1]) + end
        out = []
        for piece in self.pieces.findall(unit):
            kept, key = (self.after, piece[1:]) if piece[0] == " " and len(piece) > 1 else (self.bare, piece)
            got = kept.get(key)
            if got is None:
                got = kept[key] = self._piece(piece)
            out.append(got)
        return b"".join(out)

    def batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text is empty."""
        out: list[bytes] = []
        after = self.after
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.units or any(s in text for s in self.special):
                out.append(self._whole(text))
            else:
                if len(after) + len(self.bare) > CACHE_UNITS:
                    after.clear()
                    self.bare.clear()
                units = split_units(text)
                ids = [self._unit(units[0])]
                rest = units[1:]
                for u in set(rest).difference(after):
                    after[u] = self._unit(" " + u)
                ids += map(after.__getitem__, rest)
                out.append(b"".join(ids))
        return out
