"""Vectorised words: many texts become one array of 64-bit word hashes.

Words are runs of letters, marks and digits. Case, invisible characters, composition, width and look-alike
letters make no difference: every character goes through one table to the representative of all
characters it may not be told from, and words are hashed by a rolling polynomial over the whole chunk.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

from lexispark.llm import lookalike

SEPARATOR = "\U0010ffff"
#: Characters handled per call, unless one text alone is longer.
CHUNK = 300_000
_BREAK, _DELETE = 0, 1
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@functools.cache
def char_table() -> np.ndarray:
    """Code point -> 0 (parts words), 1 (counts as absent) or the folded code point."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for low, high in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):
        table[low:high] = np.arange(low, high)
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.get(c, c) != c:
            c = group[c]
        return c

    def merge(a: str, b: str) -> None:
        a, b = root(a), root(b)
        if a != b:
            group[max(a, b)] = min(a, b)

    plain: dict[int, str] = {}
    for i in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FFFF)):
        ch = chr(i)
        if ch in lookalike.JOINERS or lookalike.ignorable(ch):
            table[i] = _DELETE
        elif unicodedata.category(ch)[0] in "LM" or unicodedata.category(ch) == "Nd":
            lower = ch.casefold()
            plain[i] = lower[0] if lower else ch
    for member, form in lookalike.alike_classes().items():
        merge(member.casefold()[0], form.casefold()[0])
    for i, ch in plain.items():
        folded = root(ch)
        known = unicodedata.category(folded)
        table[i] = ord(folded) if known[0] in "LM" or known == "Nd" else _BREAK
    table[0xE0100:0xE01F0] = _DELETE
    return table


@functools.cache
def _compatibility() -> np.ndarray:
    """Which code points have a plain form (see lookalike.compatible_map)."""
    table = np.zeros(0x110000, dtype=bool)
    table[list(lookalike.compatible_map())] = True
    return table


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of several texts: hash and text number per word, and where each word's folded characters are."""

    __slots__ = ("hash", "doc", "chars", "start", "end")

    def __init__(self, hashes, doc, chars, start, end):
        self.hash, self.doc, self.chars, self.start, self.end = hashes, doc, chars, start, end

    def text(self, low: int, high: int) -> str:
        """The folded words low..high-1, joined by blanks."""
        parts = [self.chars[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace") for i in range(low, high)]
        return " ".join(parts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text; length is that of the words less k-1."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total = total * _BASE + self.hash[j : j + n]
        return mix(total), self.doc[:n] == self.doc[k - 1 :]


def words(texts: Sequence[str]) -> Words:
    """Words of the texts, in order. Empty texts have none."""
    joined = SEPARATOR.join(texts)
    if joined.count(SEPARATOR) != len(texts) - 1:
        joined = SEPARATOR.join(t.replace(SEPARATOR, " ") for t in texts)
    table = char_table()
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    absent = table[code] == _DELETE
    if absent.any():
        code = code[~absent]
        joined = code.tobytes().decode("utf-32-le", "replace")
    changed = False
    if _compatibility()[code].any():
        joined, changed = joined.translate(lookalike.compatible_map()), True
    if not unicodedata.is_normalized("NFC", joined):
        joined, changed = unicodedata.normalize("NFC", joined), True
    for sequence, single in lookalike.alike_sequences():
        if sequence.isalpha() or len(sequence) == 2:
            if sequence in joined:
                joined, changed = joined.replace(sequence, single), True
    if changed:
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    folded = table[code]
    inside = folded > _DELETE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = len(code) + 1
    power, inverse = _powers(1 << max(19, int(size).bit_length()))
    value = mix(folded.astype(np.uint64) + np.uint64(0x51))
    value *= power[: len(code)]
    value[~inside] = 0
    total = np.zeros(size, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    seps = np.flatnonzero(code == np.uint32(0x10FFFF))
    doc = np.searchsorted(seps, start).astype(np.int32)
    return Words(hashes, doc, folded, start, end)


def chunks(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with at most ``limit`` characters each, unless a single text is longer; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held
