"""Problem 7: evaluation texts leaking into training text.

Each piece of the corpus is a shard with its own suffix array over words:
the suffixes are sorted by their first ``least`` words, every suffix of the
evaluation items is binary-searched in it, and each hit is extended to the
longest common run of words.  Only suffixes whose first ``least`` words all
occur in the items are sorted; no other can match, so nothing is lost.

Words are runs of letters or digits in consistent form without regard to case:
each character is replaced by the representative of its case and look-alike
variants.  Null and empty texts match nothing; an item of fewer than ``least``
words can match nothing.  Rows of one item_id are one item, a repeated document row
is searched again.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .lookalikes import tables

#: Bytes of evaluation items that go to all executors at once; more are searched in blocks of about that size.
BLOCK_BYTES = 32 << 20
#: Hits that are looked at together.
HITS = 2_000_000
DROP = 0xFFFFFFFF


@functools.cache
def _folds() -> tuple[np.ndarray, dict[int, str]]:
    """(representative of each code point of the basic plane, 0 for what is no part of a word; characters that become several)."""
    skel, read = tables()
    parent = list(range(0x10000))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    several: dict[int, str] = {}
    wordy = np.zeros(0x10001, bool)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        wordy[cp] = cat[0] == "L" or cat[0] == "N"
        for to in (ch.lower(), ch.upper(), read.get(cp, ch), skel.get(cp, ch)):
            if len(to) == 1 and ord(to) < 0x10000:
                a, b = find(cp), find(ord(to))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if len(read.get(cp, ch)) > 1:
            several[cp] = read[cp]
    fold = np.zeros(0x10001, np.uint32)
    for cp in range(0x10000):
        if wordy[cp]:
            fold[cp] = find(cp) + 1
        elif read.get(cp, "x") == "" or 0x300 <= cp < 0x370:
            fold[cp] = DROP
    several |= {cp: to for cp, to in read.items() if cp >= 0x10000 and to}
    return fold, several


def _fold_above(a: np.ndarray, f: np.ndarray) -> None:
    """Sets the codes ``f`` of the characters of ``a`` above the basic plane: each letter or digit its own, in one case."""
    big = np.flatnonzero(a >= 0x10000)
    if not len(big):
        return
    read = tables()[1]
    chars, which = np.unique(a[big], return_inverse=True)
    codes = np.zeros(len(chars), np.uint32)
    for i, cp in enumerate(chars.tolist()):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            codes[i] = ord(ch.lower()) + 1
        elif read.get(cp) == "" or unicodedata.category(ch) == "Mn":
            codes[i] = DROP
    f[big] = codes[which]


@functools.cache
def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, index of the first word of each text and the end)."""
    fold, several = _folds()
    joined = "".join((t or "").replace("\x00", " ") + "\x00" for t in texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(a) and (a >= 0x80).any():
        odd = [c for c in np.unique(a[a >= 0x80]).tolist() if c in several]
        if odd:
            for c in odd:
                joined = joined.replace(chr(c), several[c])
            a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = fold[np.minimum(a, 0x10000)]
    _fold_above(a, f)
    keep = f != DROP
    a, f = a[keep], f[keep]
    in_word = f > 0
    ws = np.flatnonzero(in_word & ~np.concatenate(([False], in_word[:-1])))
    at = np.flatnonzero(in_word)
    if not len(ws):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    wid = np.searchsorted(ws, at, side="right") - 1
    h = np.add.reduceat(f[at].astype(np.uint64) * _weights()[(at - ws[wid]) & 127], np.searchsorted(at, ws))
    return h, np.concatenate(([0], np.searchsorted(ws, np.flatnonzero(a == 0))))


class Items:
    """The evaluation items as word numbers, 1-based; 0 stands for every other word and for the end of a text."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int):
        h, first = word_hashes(texts)
        self.vocabulary = np.unique(h)
        self.least = least
        parts = [np.concatenate((np.searchsorted(self.vocabulary, h[a:b]).astype(np.int32) + 1, [0] * least)) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.words = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.owner = np.repeat(np.arange(len(parts)), lengths)
        self.ids = list(ids)
        self.first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(parts) else lengths
        self.keys, self.at = suffixes(self.words, least)

    def number(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == h, k + 1, 0).astype(np.int32)


def suffixes(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first ``depth`` words of every suffix without a 0 among them as sortable bytes, its position), sorted."""
    n = len(words) - depth + 1
    if n <= 0:
        return np.zeros(0, f"S{4 * depth}"), np.zeros(0, np.int64)
    gap = np.concatenate(([0], np.cumsum(words == 0)))
    at = np.flatnonzero(gap[depth:] == gap[:-depth])
    keys = np.ascontiguousarray(np.stack([words[at + k] for k in range(depth)], 1).astype(">i4")).view(f"S{4 * depth}").ravel() if len(at) else np.zeros(0, f"S{4 * depth}")
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def matches(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words, word position in the text, in the item): the longest match of each item in each text."""
    h, first = word_hashes(texts)
    k = items.least
    # a 0 between texts keeps a match within one
    lengths = np.diff(first)
    shift = np.repeat(np.arange(len(texts)), lengths)
    words = np.zeros(len(h) + len(texts), np.int32)
    words[np.arange(len(h)) + shift] = items.number(h)
    starts = first[:-1] + np.arange(len(texts))
    keys, at = suffixes(words, k)
    if not len(keys) or not len(items.keys):
        return []
    lo, hi = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    n = hi - lo
    # hits of many suffixes at a time, a bounded number of them: repetitive texts hit often
    hit = np.flatnonzero(n)
    upto = np.cumsum(n[hit])
    heads: list[tuple[np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(hit):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, side="right")))
        some = hit[a:b]
        m = n[some]
        pos = at[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[some], m)]
        ipos = np.repeat(items.at[some], m)
        # a match that goes on to the left is part of a longer one
        head = (pos == 0) | (ipos == 0) | (words[pos - 1] != items.words[ipos - 1]) | (words[pos - 1] == 0)
        heads.append((pos[head], ipos[head]))
        a = b
    if not heads:
        return []
    pos, ipos = (np.concatenate(x) for x in zip(*heads, strict=True))
    text_of = np.searchsorted(starts, pos, side="right") - 1
    # all matches grow together, word by word
    length = np.full(len(pos), k)
    live = np.arange(len(pos))
    while len(live):
        p, q = pos[live] + length[live], ipos[live] + length[live]
        inside = (p < len(words)) & (q < len(items.words))
        live, p, q = live[inside], p[inside], q[inside]
        live = live[(words[p] == items.words[q]) & (words[p] != 0)]
        length[live] += 1
    # the longest of each text and item, the first of equal ones
    owner = items.owner[ipos]
    order = np.lexsort((pos, -length, owner, text_of))
    keep = np.ones(len(order), bool)
    keep[1:] = (text_of[order][1:] != text_of[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x in order[keep].tolist():
        t, o, m = int(text_of[x]), int(owner[x]), int(length[x])
        if m > best.get((t, items.ids[o]), (0, 0, 0))[0]:
            best[t, items.ids[o]] = (m, int(pos[x] - starts[t]), int(ipos[x] - items.first[o]))
    return [(t, i, *v) for (t, i), v in best.items()]


def leaked(documents: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, item_id, matched_words, doc_word, item_word: the longest match of each item in each document.

    The corpus is scanned once and not shuffled.  The items go to every executor;
    where they are larger than BLOCK_BYTES, in blocks of about that size with a
    scan each.
    """
    rows = items.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = [_leaked(documents, rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), least) for k in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)


def _leaked(documents: DataFrame, items: DataFrame, least: int) -> DataFrame:
    rows = sorted(items.collect(), key=lambda r: (r.item_id is not None, r.item_id))
    shared = documents.sparkSession.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], least))
    names = ("doc_id", "item_id", "matched_words", "doc_word", "item_word")

    def run(c: dict[str, list]) -> dict[str, list]:
        found = matches(shared.value, c["text"])
        return dict(zip(names, ([c["doc_id"][f[0]] for f in found], *([f[k] for f in found] for k in range(1, 5))), strict=True))

    return map_texts(documents.select("doc_id", "text"), ["text"], run, "doc_id long, item_id long, matched_words int, doc_word int, item_word int")


def without_leaks(documents: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """The documents that share no passage with any item."""
    return documents.join(leaked(documents, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
