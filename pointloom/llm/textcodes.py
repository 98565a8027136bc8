"""Words of many texts at once, as 64-bit codes that don't change with writing or layout.

Texts are joined and treated as one array of code points: a table folds case,
accents, full-width and look-alike letters, drops characters without width and
takes everything else that is no letter as a gap.  A word's code is a polynomial
of its letters, so the same word has the same code in any text and process.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np

# Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ɡg ıi АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЅS ЈJ УY "
    "οo αa ιi νv ρp υu κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
# Characters without width.
WIDTHLESS = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x034F, 0x200E, 0x200F)
GAP, DROP = 0, -1
_LIMIT = 0x1D800
_POWERS = np.cumprod(np.full(40, 0x9E3779B97F4A7C15, np.uint64))


class Words(NamedTuple):
    """Words of several texts in order: code, number of the text, first character and end in it, letters."""

    code: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # of text i: words bounds[i] to bounds[i + 1]


@cache
def fold_table() -> tuple[np.ndarray, dict[int, list[int]]]:
    """For each code point its folded letter (a positive number), GAP or DROP; and the letters of ligatures."""
    t = np.zeros(_LIMIT, np.int32)
    double: dict[int, list[int]] = {}
    same = {ord(p[0]): p[1] for p in LOOKALIKES.split()}
    for c in range(_LIMIT):
        if 0x3400 <= c < 0xF900:  # ideographs, syllables, surrogates and private use: themselves or nothing
            t[c] = c if c < 0xD800 else GAP
            continue
        ch = same.get(c) or chr(c)
        if c < 128:
            t[c] = ord(ch.lower()) if ch.isalpha() else GAP
            continue
        kind = unicodedata.category(ch)
        if c in WIDTHLESS or kind in ("Mn", "Me"):
            t[c] = DROP
        elif kind[0] == "L":
            plain = [x for x in unicodedata.normalize("NFKD", ch).casefold() if unicodedata.category(x)[0] == "L"] or [ch]
            t[c] = ord(plain[0])
            if len(plain) > 1:
                double[c] = [ord(x) for x in plain]
    return t, double


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of the texts (a gap after each), the place of each in the joined texts, and where texts begin."""
    joined = "\n".join(["" if t is None else t for t in texts] + [""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([0 if t is None else len(t) for t in texts], np.int64) + 1
    begins = np.cumsum(sizes) - sizes
    table, double = fold_table()
    high = raw >= _LIMIT
    v = table[np.where(high, 0, raw) if high.any() else raw]
    # a hyphen at the end of a line joins the parts of a word
    hyphen = np.flatnonzero((raw[:-2] == 45) & ((raw[1:-1] == 10) | (raw[1:-1] == 13))) if len(raw) > 2 else np.zeros(0, np.int64)
    if len(hyphen):
        after = hyphen + 2 + ((raw[hyphen + 1] == 13) & (raw[np.minimum(hyphen + 2, len(raw) - 1)] == 10))
        ok = (hyphen > 0) & (after < len(raw))
        ok &= (v[np.maximum(hyphen - 1, 0)] > 0) & (v[np.minimum(after, len(raw) - 1)] > 0) & (np.searchsorted(begins, hyphen, "right") == np.searchsorted(begins, after, "right"))
        for step in (0, 1, 2):
            at = hyphen[ok] + step
            v[at[at < after[ok]]] = DROP
    place = np.arange(len(raw))
    pairs = np.flatnonzero(np.isin(raw, list(double))) if (raw > 127).any() else np.zeros(0, np.int64)
    if len(pairs):
        times = np.ones(len(raw), np.int64)
        times[pairs] = [len(double[int(c)]) for c in raw[pairs]]
        first = np.cumsum(times) - times
        v, place = np.repeat(v, times), np.repeat(place, times)
        for p in pairs:
            for k, letter in enumerate(double[int(raw[p])]):
                v[first[p] + k] = letter
    keep = v != DROP
    if not keep.all():
        v, place = v[keep], place[keep]
    return v, place, begins


def words(texts: list[str | None]) -> Words:
    """The words of ``texts``; a null text has none."""
    v, place, begins = fold(texts)
    letter = v > 0
    starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    ends = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    if not len(starts):
        return Words(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(len(texts) + 1, np.int64))
    offset = np.zeros(len(v), np.int32)
    sizes = ends - starts
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    offset[letter] = np.minimum(inner, len(_POWERS) - 1)
    code = np.add.reduceat(v.astype(np.uint64) * _POWERS[offset], starts)
    code ^= code >> np.uint64(29)
    first = place[starts]
    text = np.searchsorted(begins, first, "right") - 1
    return Words(code, text, first - begins[text], place[ends - 1] + 1 - begins[text], np.searchsorted(text, np.arange(len(texts) + 1)))


def blocks(texts: list[str | None], most: int):
    """Slices of ``texts`` with about ``most`` characters each; one longer text is a slice of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if size and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))
