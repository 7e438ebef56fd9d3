"""Cutting texts for byte-level BPE vocabularies, and caches of what pieces become.

A text is first cut at single spaces where the byte-level pre-tokenizer always cuts as well, so a
piece's tokens don't depend on its neighbours. Pieces repeat a lot; what a piece becomes is worked
out once in each Python worker (the caches are bounded in bytes).
"""

from __future__ import annotations

import json
import re
import unicodedata

#: A space with white space on both sides, or at the end after white space: no cut there.
_ODD = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<!\s) | (?=\S)")
#: Below this character the library's pattern is spelled out with its own character classes.
_LATIN_END = "\u0250"


def _latin_pattern() -> re.Pattern:
    """The byte-level split pattern over characters below ``_LATIN_END``."""
    chars = [chr(c) for c in range(ord(_LATIN_END))]
    pick = lambda kind: "".join(map(re.escape, (c for c in chars if unicodedata.category(c)[0] == kind)))
    letter, number, space = pick("L"), pick("N"), "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_LATIN = _latin_pattern()


def pieces(text: str) -> list[str]:
    """The text in pieces; all but the first had a space before them that belongs to their tokens."""
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level BPE vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BytePairFile:
    """A tokenizers .json file with a byte-level BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer is needed")
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or words are not handled")
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self._special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._map = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def sections(self, text: str) -> tuple[list[str], list[int]]:
        """The text between special strings, and the ids of those strings (one fewer)."""
        if self._special_re is None or not any(s in text for s in self.special):
            return [text], []
        return self._special_re.split(text), [self.special[s] for s in self._special_re.findall(text)]

    def pre_tokens(self, piece: str, space: bool) -> list[str]:
        """The piece as the library's pre-tokenizer splits it."""
        whole = f" {piece}" if space else piece
        if piece.isascii() or max(piece) < _LATIN_END:
            return [whole] if piece.isalpha() else _LATIN.findall(whole)
        return [whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)] if whole else []

    def spelled(self, pre_token: str) -> str:
        """The pre-token in the vocabulary's byte alphabet."""
        if pre_token.isascii() and pre_token.isalpha():
            return pre_token
        return pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._map)


#: Bytes that a cached piece takes beside its characters: two objects and a place in a dictionary.
ENTRY = 200


class PieceCache:
    """Piece to value, for pieces with and without a space before them. ``work`` values many at once.

    Each side holds ``bound`` bytes at most, and what one batch asks for.
    """

    def __init__(self, work, bound: int = 48 << 20):
        self.work, self.bound = work, bound
        self.known: tuple[dict, dict] = ({}, {})
        self.size = [0, 0]

    def fill(self, wanted, space: bool) -> dict:
        known = self.known[space]
        if missing := [p for p in wanted if p not in known]:
            more = sum(map(len, missing)) + ENTRY * len(missing)
            if self.size[space] + more > self.bound:
                known.clear()
                self.size[space] = 0
                missing = list(wanted)
                more = sum(map(len, missing)) + ENTRY * len(missing)
            self.size[space] += more
            known.update(zip(missing, self.work(missing, space)))
        return known
