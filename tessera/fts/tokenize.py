"""Tokenizers by their specification: unicode61, porter over a base, trigram."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 a letter or number, 2 a mark, 0 anything else."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in (*range(0x32400), *range(0xE0000, 0xE1000)):  # beyond are no letters, numbers or marks but those of private use
        out[c] = {"L": 1, "N": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0)
    return out


@dataclass
class Tokens:
    """Tokens of a slice of texts in order: the text each is in, its code, and what makes strings of codes."""

    doc: np.ndarray
    code: np.ndarray
    names: Callable[[np.ndarray], pa.Array]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


class Tokenizer:
    """``Tokenizer("porter unicode61 remove_diacritics 0")`` and the like."""

    def __init__(self, spec: str = "unicode61"):
        words = spec.split()
        self.porter = bool(words) and words[0] == "porter"
        words = words[1:] if self.porter else words
        self.base = words[0] if words else "unicode61"
        if self.base not in ("unicode61", "trigram"):
            raise ValueError(f"unknown tokenizer {self.base!r}")
        self.options = dict(zip(words[1::2], words[2::2]))
        known = {"unicode61": {"remove_diacritics"}, "trigram": {"case_sensitive"}}[self.base]
        if set(self.options) - known or not set(self.options.values()) <= {"0", "1", "2"}:
            raise ValueError(f"bad tokenizer options {self.options}")
        self.diacritics = self.options.get("remove_diacritics", "1") != "0"
        self.case = self.options.get("case_sensitive", "0") == "1"

    def prepare(self, text: Column) -> Column:
        """A text with its case folded, by built-in functions; ``cut`` makes tokens of it."""
        text = F.coalesce(text, F.lit(""))
        return text if self.base == "trigram" and self.case else F.lower(text)

    def sizes(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        if self.base == "trigram":
            return np.maximum(np.array([len(t) for t in texts], np.int64) - 2, 0)
        first, _, begin = self._words(*_points(texts))
        return np.diff(np.append(np.searchsorted(first, begin), len(first)))

    def cut(self, texts: list[str]) -> Tokens:
        """All tokens of some prepared texts, without a string for each: work and memory go by their code points."""
        points, begin = _points(texts)
        if self.base == "trigram":
            letters = np.flatnonzero(np.bincount(points))
            number, n = np.zeros(letters.max(initial=0) + 1, np.int64), len(letters)
            number[letters] = np.arange(n)
            at = number[points]
            size = np.maximum(np.diff(np.append(begin, len(points))) - 2, 0)
            start = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            code = (at[start] * n + at[start + 1]) * n + at[start + 2]
            letters = [chr(x) for x in letters]
            spell = lambda codes: pa.array([letters[c // (n * n)] + letters[c // n % n] + letters[c % n] for c in codes.tolist()], pa.string())
            return Tokens(np.repeat(np.arange(len(texts)), size), code, spell)
        first, last, _ = self._words(points, begin)
        doc = np.searchsorted(begin, first, "right") - 1
        if not len(first):
            return Tokens(doc, np.zeros(0, np.int64), lambda codes: pa.array([], pa.string()))
        width = np.ones(len(points), np.int64)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += points > limit
        byte = np.concatenate(([0], np.cumsum(width)))
        # words and the gaps between them are one string array over the bytes; every second one is a word
        edges = np.column_stack((byte[first], byte[last])).ravel().astype(np.int32)
        every = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer("".join(texts).encode()))
        coded = every.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
        words = coded.dictionary
        return Tokens(doc, coded.indices.to_numpy().astype(np.int64), lambda codes: words.take(pa.array(codes)))

    def _words(self, points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, and where texts begin. A word starts with a letter or number; marks inside belong to it where diacritics are removed."""
        kind = _kinds()[points]
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = kind > 0 if self.diacritics else kind == 1
        new = np.zeros(len(points) + 1, bool)
        new[begin] = True
        first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1]))
        last = np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:])) + 1
        if self.diacritics and len(first):
            solid = np.append(np.flatnonzero(kind == 1), len(points))
            first = solid[np.searchsorted(solid, first)]
            first, last = first[first < last], last[first < last]
        return first, last, begin

    def final(self) -> Callable[[str], str] | None:
        """What turns a token into a term, if anything: it is applied to the distinct tokens of a slice, not to every word."""
        if self.base == "trigram":
            return None
        if self.diacritics:
            return (lambda t: stem(fold(t))) if self.porter else fold
        return stem if self.porter else None

    def terms(self, text: str) -> list[str]:
        """Terms of a query string, on the driver."""
        if self.base == "trigram":
            t = text if self.case else text.lower()
            return [t[i : i + 3] for i in range(len(t) - 2)]
        found = re.findall(r"[^\W_]+", fold(text) if self.diacritics else text.lower())
        return [stem(t) for t in found] if self.porter else found
