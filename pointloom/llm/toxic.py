"""Abusive, hateful and sexual passages, tagged by a linear-chain conditional random field.

Two states, in a passage or not.  A token's features are its word (in a canonical
spelling that undoes disguises), pieces of ``GRAMS`` letters of it, the kinds of
word it is (insult, second person, group, violence, ...), the kinds around it,
its neighbours' words, known word pairs, and whether it was disguised.  The
field is trained on labelled tokens: passages written from frames and word lists
and a bounded sample of documents that raters found clean.  It then reads a bounded
sample of the documents and is trained again with what it came upon: sentences it
finds in documents raters called toxic are passages, what looks like one in documents
they found clean is none, and neither is what nearly looks like one where nobody rated.
Inference is forward-backward; marginals make spans, spans make a document's score.

A document is split at white space and each different token is looked at once in
a process, so the work for a token is an array lookup; only near words that could
belong to a passage are the kinds around a token looked up.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import toxic_seeds as seeds
from pointloom.llm.runs import column, sized
from pointloom.llm.textcodes import blocks, fold_table

#: Documents found clean, and called toxic, by raters that are read for training: the bounds of the samples.
CLEAN_DOCS, TOXIC_DOCS = 500, 150
#: Tokens without evidence between two stretches that are scored separately; tokens of a passage from which on it needs
#: neither a marked word nor a mean marginal of ``SURE``.
BACKGROUND, SHORTEST, SURE = 12, 3, 0.9
#: Least score of a document that counts as a case.
FOUND = 0.5
#: Rounds of training and of training again with sentences of rated documents, weight decay.
ROUNDS, AGAIN, DECAY = 80, 40, 2e-3
#: Letters of the pieces of a word, and weights they share by a hash; tokens around one whose kinds count.
GRAMS, SLOTS, AROUND = (4, 5), 1 << 15, 5
#: A word that one in so many clean documents holds is of no kind; least marginal of a rated document's best sentence.
USUAL, LIKELY = 30, 0.7
#: Documents read for training again, and rows kept of them: the bounds; least marginal of what comes near a passage; tokens of a row.
READ_DOCS, NEAR, ROW = 20_000, 0.05, 100
UNKNOWN, SPELLED = 0, 1
SHARD = 6_000_000
#: Kinds of words; those of ``FUNCTION`` from ``PLAIN`` on are everywhere and call for no closer look by themselves.
KINDS = ("none", "N", "A", "B", "G", "V", "X", "S", "C", "out", "doom", "lust", "hate", "kin", "you", "du", "P", "me", "he", "all", "should", "be", "go")
PLAIN = KINDS.index("P")

# Signs that stand for letters.
_LEET = [str.maketrans("0134578@$!€", "oieastbasie"), str.maketrans("0134578@$!€", "oleastbasie")]
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*!]+$|!+$")
_TAG = re.compile(r"<[^<>]{0,40}>")
_RUN = re.compile(r"(.)\1{2,}")
_TWIN = re.compile(r"(.)\1+")


def folded(token: str) -> str:
    """Lower case without accents, look-alike letters and characters without width."""
    if token.isascii():
        return token.lower()
    table, double = fold_table()
    out = []
    for ch in unicodedata.normalize("NFC", token):
        c = ord(ch)
        v = int(table[c]) if c < len(table) else 0
        if c in double:
            out += map(chr, double[c])
        elif v > 0:
            out.append(chr(v))
        elif v == 0:
            out.append(ch)
    return "".join(out).lower()


def squeezed(word: str) -> str:
    return _TWIN.sub(r"\1", word)


class Speller:
    """From raw tokens to known words, disguised ones included."""

    def __init__(self, words: list[str], marked: set[str]):
        self.words = words
        self.number = {w: i + 2 for i, w in enumerate(words)}
        self.marked = sorted(w for w in marked if len(w) > 2)
        self.short = {squeezed(w): w for w in reversed(self.marked)}
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for w in self.marked:
            self.by_shape.setdefault((len(w), w[0]), []).append(w)

    def known(self, word: str) -> str | None:
        """The marked word that ``word`` is, after undoing drawn-out letters."""
        return word if word in self.number and word in self.short.values() else self.short.get(squeezed(word))

    def read(self, token: str) -> tuple[int, bool, str]:
        """Number of the word (UNKNOWN if it's none), whether it was disguised, and the plain letter if it is one."""
        raw = token
        if not token.isascii() and (w := next((u for u in seeds.UNSPACED if u in token), None)):
            return self.number[w], False, ""
        if "<" in token:
            token = _TAG.sub("", token)
        token = folded(_EDGE.sub("", token) if token[:1] in "@$*" or not token.isalnum() else token)
        if token.isalpha():
            if token in self.number:
                return self.number[token], any(c in raw for c in "​‌‍⁠﻿\xad") and token in self.short.values(), token if len(token) == 1 else ""
            if len(token) == 1:
                return UNKNOWN, False, token
            if _RUN.search(token) and (w := self.short.get(squeezed(token))):
                return self.number[w], True, ""
            return UNKNOWN, False, ""
        if "*" in token and (w := self.masked(token.strip("'\".,;:!?()[]"))):
            return self.number[w], True, ""
        for table in _LEET:
            plain = token.translate(table)
            letters = "".join(c for c in plain if c.isalpha())
            changed = sum(c.isalpha() for c in token) < len(letters)
            if len(letters) >= 3 and (w := self.short.get(squeezed(letters))) and (changed or plain != letters) and len(letters) * 2 > len(token):
                return self.number[w], True, ""
        word = re.split(r"['’\-/]", token)[-1]
        return self.number.get(token, self.number.get(word, UNKNOWN)), False, ""

    def masked(self, token: str) -> str | None:
        """The word some of whose letters are stars."""
        if not re.fullmatch(r"[a-z*]+", token) or token[0] == "*" or token.count("*") == len(token) - 1 > 2:
            return None
        shape = re.compile(token.replace("*", "."))
        return next((w for w in self.by_shape.get((len(token), token[0]), []) if shape.fullmatch(w)), None)


class _Numbers(dict):
    """token -> number with each new token read once; details lie beside."""

    def __init__(self, speller: Speller):
        self.speller = speller
        self.word: list[int] = []
        self.disguised: list[bool] = []
        self.letter: list[str] = []
        self.token: list[str] = []
        self.pieces: list[tuple[int, ...]] = []

    def __missing__(self, token: str) -> int:
        w, d, letter = self.speller.read(token)
        self.word.append(w)
        self.disguised.append(d)
        self.letter.append(letter)
        self.token.append(token)
        self.pieces.append(pieces(self.speller.words[w - 2] if w > SPELLED else plain(token)))
        self[token] = n = len(self.word) - 1
        return n


def plain(token: str) -> str:
    return folded(_EDGE.sub("", token))


def pieces(word: str) -> tuple[int, ...]:
    """Slots of the pieces of a word; none of what is no word."""
    if not 4 <= len(word) <= 24 or not word.isalpha():
        return ()
    w = f"^{word}$".encode()
    return tuple({zlib.crc32(w[i : i + n]) % SLOTS for n in GRAMS for i in range(len(w) - n + 1)})


def encode(texts: list[str | None], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one after another, whether each was disguised, numbers of the tokens, and where texts begin; an unknown word ends each."""
    flat: list[int] = []
    begins = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        flat += map(numbers.__getitem__, t.split() if t else ())
        flat.append(numbers["\n"])
        begins[i + 1] = len(flat)
    ids = np.array(flat, np.int64)
    word, disguised = np.array(numbers.word, np.int32)[ids], np.array(numbers.disguised, bool)[ids]
    single = np.array([bool(x) for x in numbers.letter], bool)[ids]
    edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):  # words spelled out letter by letter
        if b - a >= 2:
            _spelled(word, disguised, [numbers.letter[k] for k in ids[a:b]], a, b, numbers, ids)
    return word, disguised, ids, begins


def _spelled(word, disguised, letters, a, b, numbers, ids) -> None:
    speller = numbers.speller
    joined = "".join(letters)
    for first in range(len(letters) - 1):
        for last in range(len(letters), first + 1, -1):
            core, end, w = joined[first:last], a + last, None
            if len(core) >= 3:
                w = speller.short.get(squeezed(core))
            if w is None and last == len(letters) and end < len(ids):  # the rest of the word may stand in one piece
                raw = numbers.token[ids[end]]
                w = speller.short.get(squeezed(core + folded(_EDGE.sub("", raw)))) if raw.strip() else None
                end += w is not None
            if w is not None:
                word[a + first], disguised[a + first : end] = speller.number[w], True
                word[a + first + 1 : end] = SPELLED
                return


def kinds_of(clean: list[str]) -> dict[str, list[int]]:
    """Kinds of the listed words; a word of a list that many clean documents hold has none."""
    usual: dict[str, int] = {}
    for text in clean:
        for w in {plain(t) for t in text.split()}:
            usual[w] = usual.get(w, 0) + 1
    often = max(3, len(clean) / USUAL)
    out: dict[str, list[int]] = {}
    listed = [(kind, w) for lists in seeds.LISTS.values() for kind, line in lists.items() for word in line.split() for w in {folded(word), *folded(word).split("_")}]
    listed += [(kind, folded(w)) for kind, line in seeds.FUNCTION.items() for w in line.split()] + [("N", w) for w in seeds.UNSPACED]
    for kind, w in listed:
        k = KINDS.index(kind)
        if (k >= KINDS.index("you") or usual.get(w, 0) < often) and len(w) > 1 - (kind == "me") and k not in out.setdefault(w, []):
            out[w].append(k)
    return out


class Field:
    """Weights of the state "in a passage" against "not", and of going from state to state."""

    def __init__(self, words: list[str], marked: set[str], kinds: dict[str, list[int]]):
        self.words, self.marked, n = words, marked, len(words) + 2
        self.n = n
        self.own, self.prev, self.next = np.zeros(n), np.zeros(n), np.zeros(n)
        self.kind = np.zeros((n, len(KINDS)), np.float32)
        for i, w in enumerate(words):
            self.kind[i + 2, kinds.get(w, [0]) or [0]] = 1
        self.kind[:2, 0] = 1
        self.piece, self.alone, self.near = np.zeros(SLOTS), np.zeros(len(KINDS)), np.zeros((len(KINDS), len(KINDS)))
        self.pairs = np.zeros(0, np.int64)  # first * n + second, sorted
        self.first, self.second = np.zeros(0), np.zeros(0)  # weight of a pair for its first and for its second token
        self.disguise, self.step = np.zeros(2), np.array([[1.0, -2.0], [-2.0, 1.0]])

    def token_part(self, slots: list[tuple[int, ...]]) -> np.ndarray:
        """What the pieces of tokens say: the mean weight, so that long words don't say more."""
        sizes = np.array([len(s) for s in slots], np.int64)
        flat = np.fromiter((x for s in slots for x in s), np.int64, int(sizes.sum()))
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.piece[flat], len(sizes))
        return total / np.sqrt(np.maximum(1, sizes))

    def evidence(self, word: np.ndarray, disguised: np.ndarray, part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each token how much it speaks for a passage; ``part`` is what its pieces say."""
        e = (self.own + self.kind @ self.alone)[word] + part + self.disguise[disguised.astype(np.int8)]
        looked = (self.kind[:, 1:PLAIN].any(1))[word] | disguised | (e > 0.5)
        e[1:] += self.prev[word[:-1]]
        e[:-1] += self.next[word[1:]]
        if len(self.pairs):
            at = np.flatnonzero((word[:-1] > SPELLED) & (word[1:] > SPELLED))
            code = word[at].astype(np.int64) * self.n + word[at + 1]
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[k] == code
            at, k = at[hit], k[hit]
            e[at] += self.first[k]
            e[at + 1] += self.second[k]
        edge = np.flatnonzero(np.diff(np.r_[False, around(looked, AROUND), False].astype(np.int8)))
        ends = np.unique(np.r_[edge[::2], edge[1::2], bounds])  # stretches near a word of a kind, cut where texts end
        a, b = ends[:-1], ends[1:]
        keep = around(looked, AROUND)[np.minimum(a, len(word) - 1)] if len(word) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        at = 0
        for i in range(1, len(a) + 1):  # some hundred thousand tokens at a time
            if i == len(a) or b[i - 1] - a[at] > 200_000:
                place = np.concatenate([np.arange(x, y) for x, y in zip(a[at:i], b[at:i])])
                own = self.kind[word[place]]
                e[place] += self.told(own, seen(own, np.repeat(np.arange(i - at), b[at:i] - a[at:i])))
                at = i
        return e

    def strong(self) -> np.ndarray:
        """Numbers of the marked words."""
        return np.array([i + 2 for i, w in enumerate(self.words) if w in self.marked], np.int64)

    def told(self, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        return ((own @ self.near.astype(np.float32)) * others).sum(1)


def around(mask: np.ndarray, width: int) -> np.ndarray:
    """Where ``mask`` holds within ``width`` places."""
    total = np.r_[0, np.cumsum(mask)]
    at = np.arange(len(mask))
    return total[np.minimum(at + width + 1, len(mask))] > total[np.maximum(at - width, 0)]


def seen(own: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """For each token which kinds other tokens of its stretch within ``AROUND`` places have."""
    total = np.zeros((len(own) + 1, own.shape[1]), np.float32)
    np.cumsum(own, 0, out=total[1:], dtype=np.float32)
    at = np.arange(len(own))
    lo = np.maximum(at - AROUND, np.searchsorted(stretch, stretch, "left"))
    hi = np.minimum(at + AROUND + 1, np.searchsorted(stretch, stretch, "right"))
    out = (total[hi] - total[lo] - own > 0.5).astype(np.float32)
    out[:, 0] = 0
    return out


def posterior(e: np.ndarray, mask: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of evidence (masked at their ends): marginals, expected steps, log normaliser.

    Both passes keep the two states' weights scaled to a sum of one; passages
    begin anywhere, documents seldom with one.
    """
    rows, length = e.shape
    e = np.clip(e.T, -60, 60)
    on = mask.T
    w1 = 1 / (1 + np.exp(-e))
    w0 = 1 - w1
    w0 = np.where(e > 30, np.exp(-e), w0)
    z = (np.logaddexp(0, e) * on).sum(0)
    (t00, t01), (t10, t11) = np.exp(step)
    f = np.zeros((length, rows))  # share of the second state
    first0, first1 = w0[0], w1[0] * np.exp(-2.0)
    total = first0 + first1
    z += np.log(total)
    f[0] = first1 / total
    for t in range(1, length):
        a1 = f[t - 1]
        a0 = 1 - a1
        n0, n1 = (a0 * t00 + a1 * t10) * w0[t], (a0 * t01 + a1 * t11) * w1[t]
        total = n0 + n1
        z += np.where(on[t], np.log(total), 0)
        f[t] = np.where(on[t], n1 / total, a1)
    g = np.full((length, rows), 0.5)
    for t in range(length - 2, -1, -1):
        x1 = g[t + 1] * w1[t + 1]
        x0 = (1 - g[t + 1]) * w0[t + 1]
        n0, n1 = t00 * x0 + t01 * x1, t10 * x0 + t11 * x1
        g[t] = np.where(on[t + 1], n1 / (n0 + n1), 0.5)
    both = f * g
    p = both / (both + (1 - f) * (1 - g))
    x1, x0 = g[1:] * w1[1:], (1 - g[1:]) * w0[1:]
    a1, a0 = f[:-1], 1 - f[:-1]
    joint = [[a0 * t00 * x0, a0 * t01 * x1], [a1 * t10 * x0, a1 * t11 * x1]]
    scale = on[1:] / (joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1])
    pair = np.array([[(x * scale).sum() for x in row] for row in joint])
    return p.T * mask, pair, z


# ---------------------------------------------------------------- training


def _filled(line: str, lists: dict[str, list[str]], draw) -> str:
    """A frame with its slots filled and one of the words of each choice."""
    out = []
    for token in line.split():
        for slot in re.findall(r"\{(\w)\}", token):
            token = token.replace("{" + slot + "}", lists[slot][int(draw(len(lists[slot])))].replace("_", " "), 1)
        if "|" in token:
            options = token.split("|")
            token = options[int(draw(len(options)))]
        out.append(token)
    return " ".join(out)


def labelled() -> list[list[tuple[str, int]]]:
    """Tokens of written passages and neutral sentences with their labels; a frame with slots is filled several times."""
    rng = np.random.default_rng(7)
    out = []
    for block, times, label in ((seeds.ABUSE, 14, 1), (seeds.GROUPS, 14, 1), (seeds.SEXUAL, 14, 1), (seeds.NEUTRAL, 14, 0)):
        for lang, lines in block.items():
            lists = {k: v.split() for k, v in seeds.LISTS[lang].items()}
            for line in lines.strip().splitlines():
                before, _, passage = line.rpartition("::")
                for _ in range(times):
                    row = [(t, 0) for t in before.split()] + [(t, label) for t in _filled(passage, lists, rng.integers).split()]
                    out.append(row)
                    if label and rng.random() < 0.15:  # of a longer passage
                        other = lines.strip().splitlines()[int(rng.integers(lines.strip().count("\n") + 1))].rpartition("::")[2]
                        out[-1] = row + [(t, 1) for t in _filled(other, lists, rng.integers).split()]
    for line in seeds.OTHER.strip().splitlines():
        out += [[(t, 1) for t in line.split()]] * 7
    out += [[(w, 1)] for w in seeds.UNSPACED] * 4
    return out


def train(clean: list[str], rated: list[str] | tuple[str, ...] = ()) -> Field:
    """A field from the written passages, clean texts and texts called toxic, the same for the same texts."""
    key = zlib.crc32("\0".join([*clean, "\1", *rated]).encode("utf-8", "surrogatepass")), len(clean), len(rated)
    if key not in _TRAINED:
        kinds = kinds_of(clean)
        rows = labelled()
        field = _fit(rows, clean, kinds, None, ROUNDS)
        found = sentences(field, list(rated))
        _TRAINED.clear()
        _TRAINED[key] = _fit(rows + [r for r in found for _ in range(3)], clean, kinds, field, AGAIN) if found else field
    return _TRAINED[key]


_TRAINED: dict[tuple[int, int, int], Field] = {}


def sentences(field: Field, texts: list[str]) -> list[list[tuple[str, int]]]:
    """The sentence with the greatest mean marginal of each text, if that is at least ``LIKELY``, with the words around it."""
    out = []
    numbers = _Numbers(Speller(field.words, field.marked))
    for text in texts:
        word, disguised, ids, begins = encode([text], numbers)
        part = field.token_part(numbers.pieces)[ids]
        p = passages(field.evidence(word, disguised, part, begins), begins, field.step)
        _, a, b, mean = found_spans(p, begins, np.isin(word, field.strong()))
        if not len(mean) or mean.max() < LIKELY:
            continue
        k = int(mean.argmax())
        out.append(drawn_out(text.split(), int(a[k]), int(b[k])))
    return out


def drawn_out(tokens: list[str], a: int, b: int) -> list[tuple[str, int]]:
    """The passage from token ``a`` to ``b``, drawn out by up to six tokens to the ends of its sentence, with the words around it."""
    lo, hi = a, b
    while lo and a - lo < 6 and not re.search(r"[.!?:;]\W*$", tokens[lo - 1]):
        lo -= 1
    while hi < len(tokens) and hi - b < 6 and not re.search(r"[.!?:;]\W*$", tokens[hi - 1]):
        hi += 1
    first = max(0, lo - 8)
    return [(t, int(lo <= i < hi)) for i, t in enumerate(tokens[first : hi + 8], first)]


def train_again(field: Field, clean: list[str], rows: list[list[tuple[str, int]]]) -> Field:
    """The field of ``train(clean)`` trained on with labelled rows, the same for the same texts and rows."""
    if not rows:
        return field
    key = zlib.crc32("\0".join(clean).encode("utf-8", "surrogatepass")), zlib.crc32(repr(rows).encode("utf-8", "surrogatepass")), -len(rows)
    if key not in _TRAINED:
        _TRAINED[key] = _fit(labelled() + rows, clean, kinds_of(clean), field, AGAIN)
    return _TRAINED[key]


def _fit(rows: list[list[tuple[str, int]]], clean: list[str], kinds: dict[str, list[int]], start: Field | None, rounds: int) -> Field:
    words = sorted({plain(t) for r in rows for t, _ in r} | set(kinds) | set(seeds.UNSPACED) - {""})
    insults = {w for w in kinds if len(w) > 3 and set(kinds[w]) & {1, 2, 6, 8}} | {w for w in kinds if len(w) > 3 and 7 in kinds[w] and w[:3] in ("fuc", "suc", "fic")} | set(seeds.UNSPACED)
    field = Field(words, insults, kinds)
    speller = Speller(words, insults)
    numbers = _Numbers(speller)
    if start is not None:  # go on from weights found before
        old = {w: i + 2 for i, w in enumerate(start.words)}
        for i, w in enumerate(words):
            if w in old:
                for name in ("own", "prev", "next"):
                    getattr(field, name)[i + 2] = getattr(start, name)[old[w]]
        field.piece[:], field.alone[:], field.near[:], field.disguise[:], field.step[:] = start.piece, start.alone, start.near, start.disguise, start.step
    rng = np.random.default_rng(11)
    filler = [t.split() for t in clean if t] or [["of", "the"]]
    marks = np.array(sorted(speller.number[w] for w in insults))
    texts, labels = [], []
    for r in rows:
        text = filler[int(rng.integers(len(filler)))]
        at = int(rng.integers(len(text)))
        before, after = text[max(0, at - int(rng.integers(1, 9))) : at], text[at : at + int(rng.integers(1, 9))]
        own = " ".join(t for t, _ in r).split()
        if len(texts) % 6 == 1 and len(own) > 3:  # a sixth of the sentences has words nobody knows
            own = [t if rng.random() > 0.15 else "qx" for t in own]
        texts.append(" ".join([*before, *own, *after]))
        labels.append(np.array([0] * len(before) + [y for t, y in r for _ in t.split()] + [0] * (len(after) + 1)))
    w, d, i, begins = encode([*texts, *clean], numbers)
    sets: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        if k < len(rows):
            off = d[a:b] | (np.isin(w[a:b], marks) & (labels[k] > 0)) if k % 6 == 5 else d[a:b]  # a sixth of the passages is disguised
            sets.append((w[a:b], off, labels[k], i[a:b]))
        else:
            sets += [(w[x : min(x + 40, b)], d[x : min(x + 40, b)], np.zeros(min(x + 40, b) - x, np.int64), i[x : min(x + 40, b)]) for x in range(a, b, 40)]
    told = field.kind[:, 1:PLAIN].any(1)
    # of stretches without any word of a kind one in five is kept
    sets = [s for k, s in enumerate(sets) if k < len(rows) or told[s[0]].any() or k % 5 == 0]
    word, dis, lab, ids = (np.concatenate([s[i] for s in sets]) for i in range(4))
    stretch = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    size = np.bincount(stretch, minlength=len(sets))
    begin = np.cumsum(size) - size
    inner = np.flatnonzero(stretch[1:] == stretch[:-1])  # tokens with one after them
    own = field.kind[word]
    others = seen(own, stretch)
    n = field.n
    codes = word[inner].astype(np.int64) * n + word[inner + 1]
    both = (word[inner] > SPELLED) & (word[inner + 1] > SPELLED)
    field.pairs = np.unique(codes[both & ((lab[inner] > 0) & (lab[inner + 1] > 0))])
    field.first, field.second = np.zeros(len(field.pairs)), np.zeros(len(field.pairs))
    pk = np.minimum(np.searchsorted(field.pairs, codes), max(0, len(field.pairs) - 1))
    has = both & (field.pairs[pk] == codes) if len(field.pairs) else np.zeros(len(inner), bool)
    pk, pi = pk[has], inner[has]
    sizes = np.array([len(s) for s in numbers.pieces], np.int64)
    flat = np.fromiter((x for s in numbers.pieces for x in s), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(sizes)), sizes)
    share = 1 / np.sqrt(np.maximum(1, sizes))
    truth = np.zeros((2, 2))
    np.add.at(truth, (lab[inner], lab[inner + 1]), 1)
    batches = []  # sequences of like length together, padded
    order = np.argsort(size, kind="stable")
    for part in np.array_split(order, 6):
        width = int(size[part].max(initial=0))
        mask = np.arange(width) < size[part][:, None]
        batches.append((begin[part][:, None] + np.arange(width), mask))
    params = [field.own, field.prev, field.next, field.first, field.second, field.disguise, field.step, field.piece, field.alone, field.near]
    squares = [np.full_like(p, 1e-6) for p in params]
    # words and pairs decay faster than kinds and pieces, which hold for words never seen as well
    decays = [DECAY / 3] * 5 + [DECAY / 10] * 2 + [DECAY / 20, DECAY / 10, DECAY / 10]
    for r in range(rounds):
        e = (field.own + field.kind @ field.alone)[word] + field.disguise[dis.astype(np.int8)] + field.token_part(numbers.pieces)[ids] + field.told(own, others)
        e[inner + 1] += field.prev[word[inner]]
        e[inner] += field.next[word[inner + 1]]
        e += np.bincount(pi, field.first[pk], len(e)) + np.bincount(pi + 1, field.second[pk], len(e))
        p, pair = np.zeros(len(e)), np.zeros((2, 2))
        for place, mask in batches:
            q, x, _ = posterior(np.where(mask, e[np.minimum(place, len(e) - 1)], 0), mask, field.step)
            p[place[mask]] = q[mask]
            pair += x
        g = lab - p
        by_token = np.bincount(ids, g, len(sizes)) * share
        grads = [
            np.bincount(word, g, n), np.bincount(word[inner], g[inner + 1], n), np.bincount(word[inner + 1], g[inner], n),
            np.bincount(pk, g[pi], len(field.pairs)), np.bincount(pk, g[pi + 1], len(field.pairs)),
            np.bincount(dis.astype(np.int8), g, 2), truth - pair, np.bincount(flat, by_token[of], SLOTS),
            g.astype(np.float32) @ own, own.T @ (g.astype(np.float32)[:, None] * others),
        ]
        for q, s, d, decay in zip(params, squares, grads, decays):
            d = d / len(sets) - decay * q
            s *= 0.95
            s += 0.05 * d * d
            q += (0.08 * (1 - r / rounds) + 0.004) * d / (np.sqrt(s) + 1e-5)
    return field


# ---------------------------------------------------------------- scoring


def _votes(labels: DataFrame) -> DataFrame:
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("t"))


def rated_samples(docs: DataFrame, labels: DataFrame, clean: int = CLEAN_DOCS, toxic: int = TOXIC_DOCS) -> tuple[list[str], list[str]]:
    """Texts of at most ``clean`` documents that no rater called toxic and at most ``toxic`` that more than half did, chosen by a hash of the id."""
    votes = _votes(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = votes.where("t = 0").orderBy(*order).limit(clean).unionByName(votes.where("t > 0.5").orderBy(*order).limit(toxic))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").collect()  # at most clean + toxic rows
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows if not r["t"]], [r["text"] for r in rows if r["t"]]


def read_again(docs: DataFrame, labels: DataFrame, field: Field, most: int = READ_DOCS) -> list[list[tuple[str, int]]]:
    """Labelled rows from at most ``most`` documents, rated ones first, the others by a hash of the id; at most ``most`` rows.

    Of a document that more than half of its raters called toxic: the surest
    sentence the field finds, as a passage.  Of one that none called toxic: all
    with marginals of ``NEAR``, as no passage.  Of one without a rating: what has
    such marginals but none of 0.5, as no passage.
    """
    votes = _votes(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    others = docs.select("doc_id").where("doc_id is not null").orderBy(*order).limit(most).join(votes, "doc_id", "left_anti")
    ids = votes.where("t = 0 or t > 0.5").unionByName(others.select("doc_id", F.lit(None).cast("double").alias("t")))
    ids = ids.orderBy(F.col("t").isNull(), *order).limit(most)

    def run(batches):
        speller = Speller(field.words, field.marked)
        numbers = _Numbers(speller)
        for t in sized(batches, 1):
            docs_, texts, marks = column(t, "doc_id").to_pylist(), column(t, "text").to_pylist(), column(t, "t").to_pylist()
            for s in blocks(texts, SHARD):
                if len(numbers) > 500_000:
                    numbers = _Numbers(speller)
                rows = [(docs_[s.start + i], a, r) for i, a, r in _rows(texts[s], marks[s], field, numbers)]
                cut = [(d, a + x, r[x : x + ROW]) for d, a, r in rows for x in range(0, len(r), ROW)]
                tokens, on = [[w for w, _ in r] for _, _, r in cut], [[y for _, y in r] for _, _, r in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _, _ in cut], pa.int64()), pa.array([a for _, a, _ in cut], pa.int32()), pa.array(tokens, pa.list_(pa.string())), pa.array(on, pa.list_(pa.int32()))],
                    ["doc_id", "first", "tokens", "label"],
                )

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long"), "text", "t")
    rows = rows.mapInArrow(run, "doc_id long, first int, tokens array<string>, label array<int>").orderBy(*order, "first").limit(most).collect()
    return [list(zip(r["tokens"], r["label"])) for r in rows]


def _rows(texts: list[str], marks: list[float | None], field: Field, numbers: _Numbers) -> list[tuple[int, int, list[tuple[str, int]]]]:
    """Text, number of its first token and labelled tokens for each row to train with again."""
    word, disguised, ids, begins = encode(texts, numbers)
    p = passages(field.evidence(word, disguised, field.token_part(numbers.pieces)[ids], begins), begins, field.step)
    out = []
    surest: dict[int, tuple[float, int, int]] = {}
    for i, a, b, mean in zip(*(x.tolist() for x in found_spans(p, begins, np.isin(word, field.strong())))):
        if marks[i] and mean > surest.get(i, (0, 0, 0))[0]:
            surest[i] = mean, a, b
    out += [(i, a, drawn_out(texts[i].split(), a, b)) for i, (_, a, b) in surest.items()]
    on = p >= NEAR
    on[begins[1:] - 1] = False
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    for a, b, i in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(begins, edge[::2], "right") - 1).tolist()):
        if marks[i] == 0 or marks[i] is None and p[a:b].max() < 0.5:
            first = max(0, a - int(begins[i]) - 8)
            out.append((i, first, [(w, 0) for w in texts[i].split()[first : b - int(begins[i]) + 8]]))
    return out


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """The field for these documents and what raters said of them."""
    clean, _ = rated_samples(docs, labels, toxic=0)
    field = train(clean)
    return train_again(field, clean, read_again(docs, labels, field))


def passages(e: np.ndarray, bounds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginal of each token; stretches with nothing to tell for ``BACKGROUND`` tokens are 0.

    A token tells nothing if staying in a passage over it loses against staying
    outside; as many of them in a row as that cut a passage off for certain.
    """
    out = np.zeros(len(e))
    tells = e + step[1, 1] - step[0, 0] > -0.5
    tells[bounds[1:] - 1] = False
    at = np.flatnonzero(tells)
    if not len(at):
        return out
    text = np.searchsorted(bounds, at, "right")
    new = np.r_[True, (np.diff(at) > BACKGROUND) | (np.diff(text) > 0)]
    a = np.maximum(at[new] - BACKGROUND, bounds[text[new] - 1])
    last = np.flatnonzero(np.r_[new[1:], True])
    b = np.minimum(at[last] + BACKGROUND + 1, bounds[text[last]])
    a[1:] = np.maximum(a[1:], np.where(text[new][1:] == text[new][:-1], b[:-1], a[1:]))
    size = b - a
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        width = size[order[i]] * 2 + 8
        n = min(max(1, int(np.searchsorted(size[order], width, "right")) - i), max(1, 2_000_000 // width))
        rows = order[i : i + n]
        width = int(size[rows].max())
        place = a[rows][:, None] + np.arange(width)
        mask = np.arange(width) < size[rows][:, None]
        p, _, _ = posterior(np.where(mask, e[np.minimum(place, len(e) - 1)], 0), mask, step)
        out[place[mask]] = p[mask]
        i += n
    return out


def found_spans(p: np.ndarray, begins: np.ndarray, marked: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, ...]:
    """Passages: text, first token in it, end token, mean marginal.

    Runs of fewer than ``SHORTEST`` tokens need a ``marked`` one (a bool for each
    token) or a mean of ``SURE``.
    """
    on = p >= least
    on[begins[1:] - 1] = False
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    sums, strong = np.r_[0, np.cumsum(p)], np.r_[0, np.cumsum(marked)]
    mean = (sums[b] - sums[a]) / np.maximum(1, b - a)
    keep = (b - a >= SHORTEST) | (mean >= SURE) | (strong[b] > strong[a])
    a, b, mean = a[keep], b[keep], mean[keep]
    text = np.searchsorted(begins, a, "right") - 1
    return text, a - begins[text], b - begins[text], mean


def toxicity(docs: DataFrame, field: Field, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, score, starts, ends`` for every document: its score and the character offsets of its passages.

    The score is the greatest mean marginal of its passages, else half its
    greatest marginal; a passage is a run of tokens with marginals of 0.5 or more
    (a run of fewer than ``SHORTEST`` also holds a word marked as an insult or has a
    mean of ``SURE``), so documents with a passage have 0.5 or more.  Null
    and empty texts score 0.  Texts are read whole.
    """
    kind = dict(docs.dtypes)[doc]

    def run(batches):
        speller = Speller(field.words, field.marked)
        numbers = _Numbers(speller)
        insults, part = field.strong(), np.zeros(0)
        for t in sized(batches, 1):
            ids, texts = column(t, doc), column(t, text).to_pylist()
            for s in blocks(texts, SHARD):
                if len(numbers) > 500_000:
                    numbers, part = _Numbers(speller), np.zeros(0)
                word, disguised, ids_, begins = encode(texts[s], numbers)
                part = np.r_[part, field.token_part(numbers.pieces[len(part) :])]
                p = passages(field.evidence(word, disguised, part[ids_], begins), begins, field.step)
                score = np.maximum.reduceat(p, begins[:-1]) * 0.499
                k, a, b, mean = found_spans(p, begins, np.isin(word, insults))
                np.maximum.at(score, k, mean)
                starts, ends = [[] for _ in range(len(begins) - 1)], [[] for _ in range(len(begins) - 1)]
                for i, x, y in zip(k.tolist(), a.tolist(), b.tolist()):
                    places = [m.span() for m in re.finditer(r"\S+", texts[s][i])] if not starts[i] else places  # noqa: F821
                    starts[i].append(places[x][0])
                    ends[i].append(places[y - 1][1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.start, s.stop - s.start), pa.array(score), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                    [doc, "score", "starts", "ends"],
                )

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, score double, starts array<int>, ends array<int>")
