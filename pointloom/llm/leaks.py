"""Evaluation passages inside documents: FM-index per shard, located pairs of words, exact alignment.

A shard of documents becomes the sequence of its telling words - those among the
rarer ones of some passage - under an FM-index; all other words vanish, so that
words put in, left out or changed leave their neighbours next to each other.
Every two telling words up to ``SKIP`` apart in a passage are searched backward
and all their places are located.  Several such pairs of one passage close
together in one document call for an alignment of passage and text, which alone
decides; aligned pieces give the spans to remove.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.fmindex import FMIndex
from pointloom.llm.runs import column, expand, sized
from pointloom.llm.textcodes import blocks, words

#: Share of a passage's words, the rarest in the shard, that are telling; telling words two of which up to so many apart are searched as a pair.
TELLING, SKIP = 0.6, 4
#: Different pairs of a passage that must occur near each other before it is aligned.
SEEDS = 2
#: Words of text up to which pieces of a passage count as near each other.
NEAR = 120
#: Matching words that make a piece, and what a word in only one of both costs within it.
PIECE, COST = 3, 0.25
#: Characters of a shard, and passages looked for at once in its index.
SHARD, ITEMS = 6_000_000, 4_000

_OUT = "item_id long, doc_id long, matched int, n_words int, starts array<int>, ends array<int>"


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", share: float = 0.5) -> DataFrame:
    """``item_id, doc_id, matched, n_words, starts, ends``: documents that hold at least ``share`` of a passage's words.

    Words count in their order, in pieces of at least ``PIECE`` of them that lie
    within ``NEAR`` words of each other; case, accents, look-alike letters,
    punctuation, digits, hyphenation and layout don't matter, and scattered words
    may be missing, foreign or changed.  ``starts`` and ``ends`` are the merged
    character spans of the pieces of all places in the document that hold that
    share, ``matched`` is the most of one place.  Null or empty texts and
    passages and null ids match nothing; passages of fewer than ``PIECE`` words
    can't be found.  A document or item given twice comes out twice.  Documents
    are read and indexed once, whatever the number of passages; the passages, a
    test set, reach the driver and every task as one broadcast.
    """
    rows = [(r[0], r[1]) for r in items.where(f"{item} is not null and {passage} is not null").select(item, passage).collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        p = Passages(sent.value)
        for t in sized(batches, 1):
            ids, texts = column(t, doc), column(t, text).to_pylist()
            for s in blocks(texts, SHARD):
                found = shard(texts[s], p, share)
                if found:
                    k, d, matched, n, starts, ends = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p.ids[i] for i in k], pa.int64()), ids.slice(s.start).take(pa.array(d)).cast(pa.int64()), pa.array(matched, pa.int32()), pa.array(n, pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                        ["item_id", "doc_id", "matched", "n_words", "starts", "ends"],
                    )

    return docs.where(f"{doc} is not null and {text} is not null").select(doc, text).mapInArrow(run, _OUT)


class Passages:
    """Passages as symbols from 1, one after another: ``flat``, of passage ``owner``; its first is ``begin``."""

    def __init__(self, rows: list[tuple[int, str]]):
        w = words([p for _, p in rows])
        self.ids = [i for i, _ in rows]
        self.vocabulary, symbol = np.unique(w.code, return_inverse=True)
        self.flat = symbol.astype(np.int64) + 1
        self.length = np.diff(w.bounds)
        self.begin = w.bounds[:-1]
        self.owner = np.repeat(np.arange(len(rows)), self.length)
        self.masks: dict[int, dict[int, int]] = {}

    def symbols(self, k: int) -> np.ndarray:
        return self.flat[self.begin[k] : self.begin[k] + self.length[k]]

    def mask(self, k: int) -> dict[int, int]:
        """For each symbol of passage k the bits of its places."""
        if k not in self.masks:
            m: dict[int, int] = {}
            for at, s in enumerate(self.symbols(k).tolist()):
                m[s] = m.get(s, 0) | 1 << at
            self.masks[k] = m
        return self.masks[k]

    def telling(self, count: np.ndarray) -> np.ndarray:
        """For each symbol whether it is among the ``TELLING`` rarest words of a passage, by how often symbols occur."""
        order = np.lexsort((self.flat, count[self.flat], self.owner))
        rank = np.arange(len(order)) - self.begin[self.owner]  # sorted by owner first, so places are the passages' own
        out = np.zeros(len(self.vocabulary) + 1, bool)
        out[self.flat[order[rank < np.ceil(TELLING * self.length)[self.owner]]]] = True
        return out

    def pairs(self, telling: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of telling words of passages ``some``; where each one's uses start, and passage and place of each use."""
        at = np.flatnonzero(telling[self.flat] & (self.owner >= some.start) & (self.owner < some.stop))
        first, second = [], []
        for d in range(1, SKIP + 1):
            ok = np.flatnonzero(self.owner[at[:-d]] == self.owner[at[d:]]) if len(at) > d else np.zeros(0, np.int64)
            first.append(at[ok])
            second.append(at[ok + d])
        gap = np.repeat(np.arange(1, SKIP + 1), [len(x) for x in first])
        first, second = np.concatenate(first), np.concatenate(second)
        code, use = np.unique(self.flat[first] * (len(telling) + 1) + self.flat[second], return_inverse=True)
        order = np.argsort(use, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(use, minlength=len(code)))].astype(np.int64)
        pair = np.stack([code // (len(telling) + 1), code % (len(telling) + 1)], 1)
        return pair, starts, self.owner[first[order]], first[order] * (SKIP + 1) + gap[order]


def candidates(symbol: np.ndarray, bounds: np.ndarray, p: Passages) -> list[tuple[int, int, int, int]]:
    """Windows of words to align: passage, document, first and end word."""
    if not len(p.flat) or not len(symbol):
        return []
    telling = p.telling(np.bincount(symbol, minlength=len(p.vocabulary) + 1))
    keep = telling[symbol]
    inner = bounds[1:-1]
    kept = np.flatnonzero(keep)
    # a 0 between documents
    at = np.searchsorted(kept, inner)
    fm = FMIndex(np.insert(symbol[kept], at, 0), len(p.vocabulary))
    word = np.insert(kept, at, -1)
    out = []
    for lo in range(0, len(p.ids), ITEMS):
        pair, starts, item, place_of = p.pairs(telling, slice(lo, lo + ITEMS))
        if not len(pair):
            continue
        which, place = fm.locate(*fm.search(pair))
        hit, use = expand(starts[which], starts[which + 1])
        k, kind, pos = item[use], place_of[use], word[place[hit]]
        d = np.searchsorted(bounds, pos, "right") - 1
        o = np.lexsort((pos, k, d))
        k, kind, pos, d = k[o], kind[o], pos[o], d[o]
        if not len(k):
            continue
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (pos[1:] - pos[:-1] > NEAR + p.length[k[1:]])]
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        kinds = np.bincount(np.unique(np.stack([group, kind], 1), axis=0)[:, 0], minlength=len(first)) if len(first) < len(k) else np.ones(len(first), np.int64)
        last = np.r_[first[1:], len(pos)] - 1
        ok = np.flatnonzero(kinds >= SEEDS)
        first, last = first[ok], last[ok]
        a = np.maximum(pos[first] - p.length[k[first]], bounds[d[first]])
        b = np.minimum(pos[last] + p.length[k[first]] + PIECE, bounds[d[first] + 1])
        out += zip(k[first].tolist(), d[first].tolist(), a.tolist(), b.tolist())
    return out


def shard(texts: list[str], p: Passages, share: float) -> list[tuple]:
    w = words(texts)
    if not len(w.code) or not len(p.vocabulary):
        return []
    at = np.minimum(np.searchsorted(p.vocabulary, w.code), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == w.code, at + 1, 0)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    spans: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for k, d, lo, hi in candidates(symbol, w.bounds, p):
        n = int(p.length[k])
        for matched, places in occurrences(p.symbols(k), p.mask(k), symbol[lo:hi], share * n):
            best[k, d] = (max(matched, best.get((k, d), (0,))[0]), n)
            spans.setdefault((k, d), set()).update((int(w.start[lo + a]), int(w.end[lo + b - 1])) for a, b in places)
    return [(*key, *v, *merged(spans[key])) for key, v in best.items()]


def occurrences(passage: np.ndarray, mask: dict[int, int], text: np.ndarray, least: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every place of a text that holds at least ``least`` words of the passage: how many, first and end words of its pieces.

    What lies before the last piece of an alignment and what lies after its first
    one are aligned again, as the passage may stand there once more.
    """
    out, rest, seen = [], [(0, len(text))], set()
    while rest:
        lo, hi = part = rest.pop()
        s = text[lo:hi]
        if part in seen or np.count_nonzero(s) < max(least, PIECE) or common(s[s > 0].tolist(), mask, len(passage)) < least:
            continue
        seen.add(part)
        pieces = near(align(passage, s))
        matched = sum(m for m, *_ in pieces)
        if pieces and matched >= least:
            places = sorted((lo + a, lo + b) for _, a, b in pieces)
            out.append((matched, places))
            rest += [(lo, places[-1][0]), (places[0][1], hi)]
    return out


def near(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The largest piece and those before and after it with gaps of at most ``NEAR`` words between them."""
    if not pieces:
        return []
    lo = hi = max(range(len(pieces)), key=lambda i: pieces[i][0])
    while lo and pieces[lo][1] - pieces[lo - 1][2] <= NEAR:
        lo -= 1
    while hi + 1 < len(pieces) and pieces[hi + 1][1] - pieces[hi][2] <= NEAR:
        hi += 1
    return pieces[lo : hi + 1]


def merged(spans: set[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans in order, overlapping ones made one."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def common(text: list[int], mask: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for s in text:
        m = mask.get(s)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def align(passage: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Pieces of the passage in the text, in order: matching words, first and end word of the text.

    The best local alignment is a piece; what comes before it in both is then
    aligned, and what comes after it.
    """
    if len(passage) < PIECE or len(text) < PIECE:
        return []
    n, m = len(passage), len(text)
    h = np.zeros((n + 1, m + 1))
    ramp = COST * np.arange(m + 1)
    for i in range(n):
        row = np.maximum(h[i] - COST, 0)
        np.maximum(row[1:], h[i, :-1] + np.where(text == passage[i], 1.0, -COST), out=row[1:])
        h[i + 1] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    if h[i, j] < 1:
        return []
    end_i, end_j, matched = i, j, 0
    while i and j and h[i, j] > 1e-9:
        same = passage[i - 1] == text[j - 1]
        if abs(h[i, j] - (h[i - 1, j - 1] + (1.0 if same else -COST))) < 1e-9:
            matched += bool(same)
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - COST)) < 1e-9:
            i -= 1
        else:
            j -= 1
    if matched < PIECE:
        return []
    return [*align(passage[:i], text[:j]), (matched, int(j), int(end_j)), *((x, a + int(end_j), b + int(end_j)) for x, a, b in align(passage[end_i:], text[end_j:]))]
