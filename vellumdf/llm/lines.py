"""Text statistics and line kinds: prose, list, table or junk.

Every line of a text is an observation of a hidden Markov model with seven
states that belong to four kinds.  A line is described by fifteen binned statistics (shares of letters,
digits and symbols, vowels, commas, word length, repetition, first and last
character ...); the emission is the product of their probabilities.  The
parameters are counts over a bounded sample of lines labelled by
``weak_labels`` and lie in ``models/lines.json`` (see ``train``).

All statistics are computed for a whole batch of texts at once over one array
of code points.  Null and empty texts have no lines, zero shares and the kind
``prose`` (nothing that is not running text).
"""

from __future__ import annotations

import functools
import json
import unicodedata
from pathlib import Path

import numpy as np

from .chains import viterbi
from .lookalikes import tables

KINDS = ("prose", "list", "table", "junk")
#: Hidden states and the kind each belongs to: lists of entries and of words, noise, repetition and random letters differ too much for one state.
STATES = ("prose", "entries", "words", "table", "noise", "repeated", "letters")
KIND_OF = np.array([0, 1, 1, 2, 3, 3, 3])
MODEL = Path(__file__).parent / "models" / "lines.json"
#: Periods up to here are compared at every lag; longer ones, of any length, are found by long_periods.
MAX_LAG = 16
#: Share of a whole long period that must agree with the one before where words differ.
AGREEMENT = 0.7

# character classes
BREAK, BLANK, VOWEL, CONSONANT, UNCASED, DIGIT, STOP, COMMA, SOFT, SYMBOL, UPPER_V, UPPER_C, CLOSER, CELL = range(14)
N_CLASS = 16

# Vowels of the cased alphabets, without their marks.
VOWELS = frozenset("aeiouyæøœıаеёиоуыэюяіїєαεηιουωаеоіу")
STOPS = ".!?…。！？।॥؟‽;．｡"
COMMAS = ",;"
SOFTS = "'’‘-–—‐‑:،、，;؛（）()「『《«“„‚‹¿¡​‌‍⁠﻿\xad·"
CLOSERS = "\"”»›’')」』》）]*_"
BULLETS = "-*•▪‣◦●■–·▸►+"
MARKUP = "<{[|#=`"


@functools.cache
def _classes() -> np.ndarray:
    lut = np.full(0x10001, SYMBOL, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)[:1] or ch
        cat = unicodedata.category(base)
        if ch in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  \x00":
            k = BREAK
        elif ch.isspace():
            k = CELL if ch == "\t" else BLANK
        elif cat[0] == "N":
            k = DIGIT
        elif cat[0] == "L" or cat[0] == "M":
            low = base.lower()
            if low != base.upper() and cat[0] == "L":
                v = low[:1] in VOWELS
                k = (UPPER_V if v else UPPER_C) if base != low else (VOWEL if v else CONSONANT)
            else:
                k = UNCASED
        elif ch == ",":
            k = COMMA
        elif ch in STOPS:
            k = STOP
        elif ch in "\"”»›」』":
            k = CLOSER
        elif ch in SOFTS:
            k = SOFT
        elif ch == "|":
            k = CELL
        else:
            k = SYMBOL
        lut[cp] = k
    lut[0x10000] = UNCASED
    for cp in range(0x300, 0x370):
        lut[cp] = UNCASED  # marks on a letter
    return lut


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """(plain form of each code point, its small look-alike): full-width and other styled forms are folded, 0xFFFF marks what prints nothing."""
    plain = np.arange(0x10001, dtype=np.uint32)
    for cp, to in tables()[1].items():
        if cp < 0x10000 and len(to) <= 1 and (not to or to.isalnum()):
            plain[cp] = ord(to) if to and ord(to) < 0x10000 else 0xFFFF if not to else cp
    plain[[0x2010, 0x2011]] = ord("-")
    small = plain.copy()
    look = tables()[0]
    for cp in range(0x10000):
        ch = chr(int(plain[cp]))
        if len(low := (look.get(ord(ch), ch) or ch).lower()) == 1 and ord(low) < 0x10000:
            small[cp] = ord(low)
    return plain, small


def code_points(texts: list[str | None]) -> np.ndarray:
    """All texts behind each other, each closed by a zero."""
    joined = "".join(((t or "").replace("\x00", " ")) + "\x00" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def long_periods(h: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """How many of its two neighbours a period before and behind equal each word (0 to 2), in stretches repeated with a period over MAX_LAG.

    h: hashes of the words, unit: the text of each, ascending.  For m = 4, 8, 16 ... the distance of each m words to
    their previous place in the same text is taken; where it stays the same for a whole period, the stretch repeats.
    Only what occurs twice with m words is looked at with 2 m, so that all periods are covered in a few short sorts.
    A second pass takes the most frequent distance of each text and allows for single words that differ.
    """
    n = len(h)
    behind, before = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    gram, at, m, base = h * np.uint64(0x9E3779B97F4A7C15), np.arange(n), 1, 0xD6E8FEB86659FD93
    voted = np.zeros(0, int), np.zeros(0, int)
    while True:
        at = at[(at + 2 * m <= n) & (unit[at] == unit[np.minimum(at + 2 * m, n) - 1])]
        if not len(at):
            break
        gram = gram[: n - 2 * m + 1] * np.uint64(base) + gram[m : n - m + 1]
        base, m = base * base % 2**64, 2 * m
        if m < 4:
            continue
        key = gram[at] ^ (unit[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        i, d = at[order[1:][same]], (at[order[1:]] - at[order[:-1]])[same]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = at[twice]
        i, d = i[d > MAX_LAG], d[d > MAX_LAG]
        o = np.argsort(i)
        i, d = i[o], d[o]
        if m == 4:
            voted = i, d
        if len(i):
            head = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(d) != 0) | (np.diff(unit[i]) != 0))))
            tail = np.concatenate((head[1:], [len(i)])) - 1
            whole = i[tail] - i[head] + m >= d[head]
            lo, hi, p = i[head][whole], i[tail][whole] + m, d[head][whole]
            for marks, a, b in ((behind, lo, hi), (before, lo - p, hi - p)):
                np.add.at(marks, a, 1)
                np.add.at(marks, b, -1)
    back, ahead = np.cumsum(behind)[:n] > 0, np.cumsum(before)[:n] > 0
    i, d = voted
    if len(i):
        pair, votes = np.unique(np.stack((unit[i], d), 1), axis=0, return_counts=True)
        o = np.lexsort((votes, pair[:, 0]))
        best = pair[o][np.concatenate((np.diff(pair[o, 0]) != 0, [True]))]
        for (_, p), s, e in zip(best, np.searchsorted(unit, best[:, 0]), np.searchsorted(unit, best[:, 0], side="right"), strict=True):
            if e - s >= 2 * p:
                eq = h[s + p : e] == h[s : e - p]
                total = np.concatenate(([0], np.cumsum(eq)))
                good = np.flatnonzero(total[p:] - total[:-p] >= AGREEMENT * p)
                inside = np.zeros(len(eq) + 1, np.int64)
                np.add.at(inside, good, 1)
                np.add.at(inside, good + p, -1)
                eq &= np.cumsum(inside)[:-1] > 0
                back[s + p : e] |= eq
                ahead[s : e - p] |= eq
    return back.astype(np.int64) + ahead


class Lines:
    """The non-blank lines of a batch of texts with their statistics."""

    def __init__(self, texts: list[str | None]):
        plain, small = _folds()
        a = code_points(texts)
        folded = plain[np.minimum(a, 0x10000)]
        a = np.where(a < 0x10000, folded, a)[folded != 0xFFFF]
        cls = _classes()[np.minimum(a, 0x10000)]
        # a point or comma between two figures is part of the number, dots in a row are a leader
        dots = np.flatnonzero((a == 46) | (a == 44))
        dots = dots[(dots > 0) & (dots < len(a) - 1)]
        cls[dots[(cls[dots - 1] == DIGIT) & (cls[dots + 1] == DIGIT)]] = SOFT
        dots = dots[a[dots] == 46]
        dots = dots[(dots > 1) & (dots < len(a) - 2)]
        run = (a[dots - 1] == 46) & (a[dots + 1] == 46)
        cls[dots[run & ((a[dots - 2] == 46) | (a[dots + 2] == 46))]] = SYMBOL
        # an ideographic or supplementary character above the table counts as a letter, a pictograph as a symbol
        big = a >= 0x10000
        if big.any():
            cls[big & (a >= 0x1F000) & (a < 0x20000)] = SYMBOL
        brk = cls == BREAK
        line_of = np.cumsum(brk) - brk
        n_lines = int(line_of[-1]) + 1 if len(a) else 0
        zero = np.flatnonzero(a == 0)
        ends = np.flatnonzero(brk)
        starts = np.concatenate(([0], ends[:-1] + 1)) if n_lines else ends
        unit_of_line = np.searchsorted(zero, ends)
        counts = np.bincount(line_of * N_CLASS + cls, minlength=n_lines * N_CLASS).reshape(-1, N_CLASS)
        solid = np.flatnonzero((cls != BREAK) & (cls != BLANK) & (cls != CELL) | (a == 124))
        sl = line_of[solid]
        first = np.full(n_lines, -1)
        last = np.full(n_lines, -1)
        first[sl[::-1]] = solid[::-1]
        last[sl] = solid
        open_end = solid[~_marks(CLOSERS)[np.minimum(a[solid], 0x10000)]]
        inner = last.copy()
        inner[line_of[open_end]] = open_end
        real = first >= 0
        # words
        wordy = (cls >= VOWEL) & (cls <= DIGIT) | (cls == UPPER_V) | (cls == UPPER_C)
        new = wordy.copy()
        new[1:] &= ~wordy[:-1]
        ws = np.flatnonzero(new)
        if len(ws):
            at = np.flatnonzero(wordy)
            wid = np.cumsum(new)[at] - 1
            h = np.add.reduceat(np.where(a[at] < 0x10000, small[np.minimum(a[at], 0x10000)], a[at]).astype(np.uint64) * _weights()[(at - ws[wid]) & 63], np.cumsum(wordy)[ws] - 1)
        else:
            h = np.zeros(0, np.uint64)
        wl = line_of[ws]
        wu = unit_of_line[wl] if len(ws) else wl
        words = np.bincount(wl, minlength=n_lines)
        n_units = len(texts)
        rep_unit = np.zeros((MAX_LAG + 1, n_units))
        rep_line = np.zeros((MAX_LAG + 1, n_lines))
        for k in range(1, MAX_LAG + 1):
            if len(h) <= k:
                break
            eq = np.flatnonzero((h[k:] == h[:-k]) & (wu[k:] == wu[:-k]))
            rep_unit[k] = np.bincount(wu[eq + k], minlength=n_units)
            np.add.at(rep_line[k], wl[eq + k], 1)
            np.add.at(rep_line[k], wl[eq], 1)
        lag = rep_unit.argmax(0)
        unit_words = np.bincount(wu, minlength=n_units)
        # a stretch repeated with one period: words equal to the word a period before or behind
        periodic = np.where(unit_words >= 8, rep_unit.max(0) / np.maximum(unit_words - lag, 1), 0)
        own = rep_line[lag[unit_of_line], np.arange(n_lines)] / np.maximum(2 * words, 1) if n_lines else np.zeros(0)
        own = np.maximum(own, np.bincount(wl, weights=long_periods(h, wu), minlength=n_lines) / np.maximum(2 * words, 1))
        self.repetition = np.where(words >= 1, np.maximum(own, np.where(words < 4, periodic[unit_of_line], 0)), 0.0)[real]
        self.n_units = n_units
        self.word_hash, self.word_unit = h, wu
        self.unit = unit_of_line[real]
        self.start, self.end = starts[real], ends[real]
        self.counts = counts[real]
        self.words = words[real]
        self.first, self.last, self.inner = a[first[real]], a[last[real]], a[inner[real]]
        # lines that only one line break parts from the line before
        self.next_line = np.zeros(len(self.unit), bool)
        gap = self.start[1:] - self.end[:-1]
        windows = (a[self.end[:-1]] == 13) & (a[np.minimum(self.end[:-1] + 1, max(len(a) - 1, 0))] == 10)
        self.next_line[1:] = (self.unit[1:] == self.unit[:-1]) & ((gap == 1) | (gap == 2) & windows)
        self.unit_start = np.concatenate(([0], zero[:-1] + 1)) if len(zero) else zero
        self.unit_chars = zero - self.unit_start

    # -- features ---------------------------------------------------------
    def stats(self) -> dict[str, np.ndarray]:
        c = self.counts.astype(np.float64)
        cased = c[:, VOWEL] + c[:, CONSONANT] + c[:, UPPER_V] + c[:, UPPER_C]
        upper = c[:, UPPER_V] + c[:, UPPER_C]
        letters = cased + c[:, UNCASED]
        solid = np.maximum(c[:, VOWEL:].sum(1), 1)
        one = np.maximum
        return {
            "letters": letters / solid,
            "digits": c[:, DIGIT] / solid,
            "symbols": (c[:, SYMBOL] + c[:, CELL]) / solid,
            "vowels": np.where(cased >= 10, (c[:, VOWEL] + c[:, UPPER_V]) / one(cased, 1), -1.0),
            "commas": c[:, COMMA] / one(letters, 1),
            "wordlen": np.where(cased >= c[:, UNCASED], (letters + c[:, DIGIT]) / one(self.words, 1), -1.0),
            "solidlen": np.where(cased >= c[:, UNCASED], solid / one(c[:, BLANK] + c[:, CELL] + 1, 1), -1.0),
            "repetition": self.repetition,
            "upper": np.where(cased >= 6, upper / one(cased, 1), -1.0),
            "stops": c[:, STOP] / solid,
            "cells": c[:, CELL],
            "gaps": (c[:, BLANK] + c[:, CELL]) / one(self.words, 1),
            "soft": (c[:, COMMA] + c[:, SOFT]) / solid,
            "length": solid,
        }

    def last_kind(self) -> np.ndarray:
        ch = self.inner
        k = np.full(len(ch), 4)
        cls = _classes()[np.minimum(ch, 0x10000)]
        k[np.isin(cls, (VOWEL, CONSONANT, UNCASED, UPPER_V, UPPER_C))] = 1
        k[cls == DIGIT] = 2
        k[np.isin(cls, (COMMA, SOFT))] = 3
        k[cls == STOP] = 0
        return k

    def first_kind(self) -> np.ndarray:
        ch = self.first
        cls = _classes()[np.minimum(ch, 0x10000)]
        k = np.full(len(ch), 6)
        k[np.isin(cls, (VOWEL, CONSONANT, UNCASED))] = 0
        k[np.isin(cls, (UPPER_V, UPPER_C))] = 1
        k[cls == DIGIT] = 2
        k[np.isin(cls, (SOFT, CLOSER, STOP))] = 3
        k[_marks(BULLETS)[np.minimum(ch, 0x10000)]] = 4
        k[_marks(MARKUP)[np.minimum(ch, 0x10000)]] = 5
        return k

    def bins(self) -> np.ndarray:
        s = self.stats()
        cols = [np.searchsorted(edges, s[name], side="right") for name, edges in EDGES.items()]
        first, last = self.first_kind(), self.last_kind()
        # flowing text: single blanks between several words, few figures and signs, no entry from number to number
        flow = (s["letters"] > 0.6) & (s["digits"] < 0.33) & (s["symbols"] < 0.06) & (s["commas"] < 0.075) & (s["repetition"] < 0.65)
        flow &= ((s["vowels"] < 0) | (s["vowels"] > 0.2)) & (s["gaps"] < 1.5) & ~((first == 2) & (last == 2)) & ((s["length"] > 22) | (last == 0)) & (first < 4)
        return np.stack([*cols, last, first, flow.astype(int)], 1) if len(self.unit) else np.zeros((0, len(SIZES)), int)


EDGES: dict[str, np.ndarray] = {
    "letters": np.array([0.3, 0.5, 0.65, 0.75, 0.85, 0.93]),
    "digits": np.array([1e-9, 0.03, 0.08, 0.15, 0.3, 0.6]),
    "symbols": np.array([1e-9, 0.02, 0.05, 0.12, 0.3]),
    "vowels": np.array([-0.5, 0.1, 0.18, 0.25, 0.32, 0.6]),
    "commas": np.array([1e-9, 0.02, 0.035, 0.055, 0.09]),
    "wordlen": np.array([-0.5, 2.0, 3.5, 7.0, 9.0, 14.0]),
    "solidlen": np.array([-0.5, 3.0, 8.5, 12.0, 20.0, 40.0]),
    "repetition": np.array([0.3, 0.55, 0.7, 0.85]),
    "upper": np.array([-0.5, 0.02, 0.15, 0.3, 0.9]),
    "stops": np.array([1e-9, 0.01, 0.03, 0.1]),
    "cells": np.array([0.5, 1.5]),
    "length": np.array([12.0, 30.0, 70.0, 160.0]),
}
SIZES = [len(e) + 1 for e in EDGES.values()] + [5, 7, 2]


@functools.cache
def _marks(chars: str) -> np.ndarray:
    """Table of the basic plane: is it one of these characters."""
    t = np.zeros(0x10001, bool)
    t[[ord(c) for c in chars]] = True
    return t


@functools.cache
def _weights() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def weak_labels(lines: Lines) -> np.ndarray:
    """State of each line by plain thresholds: the training labels, never used for results."""
    s, last, first = lines.stats(), lines.last_kind(), lines.first_kind()
    kind = np.zeros(len(lines.unit), int)
    wordlist = (s["commas"] > 0.06) & (s["length"] > 20) & (last != 0) & (s["digits"] < 0.03)
    index = (last == 2) & (s["digits"] > 0.12) & ((s["soft"] > 0.02) & (s["letters"] < 0.55) | (first == 2) & (s["stops"] == 0))
    bullet = np.isin(first, (4, 6)) & (last != 0) & (s["letters"] > 0.5) & (s["length"] < 70)
    toc = (first == 2) & (last == 2) & (s["length"] < 90) & (s["stops"] == 0) & ((s["gaps"] > 1.5) | (s["symbols"] > 0.1) | (s["length"] < 30))
    kind[index | bullet | toc] = 1
    kind[wordlist] = 2
    kind[(last != 0) & (s["digits"] > 0.3) & (s["symbols"] < 0.3) & (s["length"] > 4) | (s["cells"] >= 2)] = 3
    markup = (first == 5) & (s["symbols"] > 0.12)
    noise = (s["letters"] < 0.45) & (s["digits"] < 0.3) & (s["symbols"] > 0.25)
    consonants = (s["vowels"] >= 0) & (s["vowels"] < 0.14)
    blob = (s["solidlen"] > 40) & (s["upper"] > 0.25) & (s["upper"] < 0.8)
    kind[markup | noise | blob] = 4
    kind[consonants & ~markup & (s["letters"] > 0.6)] = 6
    kind[s["repetition"] > 0.7] = 5
    return kind


def train(texts: list[str], smooth: float = 0.5) -> dict:
    """Counts of a labelled sample of texts as log probabilities."""
    lines = Lines(texts)
    kind, bins = weak_labels(lines), lines.bins()
    emit = []
    for j, n in enumerate(SIZES):
        t = np.full((len(STATES), n), smooth)
        np.add.at(t, (kind, bins[:, j]), 1)
        e = np.log(t / t.sum(1, keepdims=True))
        if j < len(EDGES) and list(EDGES.values())[j][0] < 0:
            # the first bin means that the script has no such statistic: no evidence for any state
            t = t[:, 1:]
            e = np.hstack((np.zeros((len(STATES), 1)), np.log(t / t.sum(1, keepdims=True))))
        emit.append(e.round(4).tolist())
    same = lines.unit[1:] == lines.unit[:-1]
    trans = np.full((len(STATES), len(STATES)), 1.0)
    np.add.at(trans, (kind[:-1][same], kind[1:][same]), 1)
    init = np.bincount(kind[np.concatenate(([True], ~same))], minlength=len(STATES)) + 1.0
    return {"emit": emit, "trans": np.log(trans / trans.sum(1, keepdims=True)).round(4).tolist(), "init": np.log(init / init.sum()).round(4).tolist(), "lines": len(kind)}


@functools.cache
def _model() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    m = json.loads(MODEL.read_text())
    return [np.array(e) for e in m["emit"]], np.array(m["trans"]), np.array(m["init"])


def decode(lines: Lines) -> np.ndarray:
    """Kind of each line: the most likely state sequence of each text."""
    emit, trans, init = _model()
    bins = lines.bins()
    score = np.zeros((len(bins), len(STATES)))
    for j, e in enumerate(emit):
        score += e[:, bins[:, j]].T
    starts = np.searchsorted(lines.unit, np.arange(lines.n_units))
    lengths = np.searchsorted(lines.unit, np.arange(lines.n_units), side="right") - starts
    kind = KIND_OF[viterbi(score, starts, lengths, trans, init)]
    kind[(kind == 1) & wrapped(lines, kind == 0)] = 0
    return kind


def wrapped(lines: Lines, prose: np.ndarray) -> np.ndarray:
    """Lines with several words a comma that share a sentence with a line of prose across a hard line break.

    The commas of a sentence can fall into one of its lines, which looks like a list of words by itself.
    """
    cls = _classes()[np.minimum(lines.first, 0x10000)]
    last = lines.last_kind()
    runs_on = np.zeros(len(prose), bool)  # from the line before
    runs_on[1:] = lines.next_line[1:] & np.isin(cls[1:], (VOWEL, CONSONANT)) & ((last[:-1] == 1) | (lines.last[:-1] == 44))
    beside = np.zeros(len(prose), bool)
    beside[1:] |= runs_on[1:] & prose[:-1]
    beside[:-1] |= runs_on[1:] & prose[1:]
    return beside & (lines.words >= 3 * lines.counts[:, COMMA])


def kind_chars(texts: list[str | None]) -> tuple[np.ndarray, Lines, np.ndarray]:
    """([texts, kinds] characters of the lines of each kind, the lines, their kinds)."""
    lines = Lines(texts)
    kind = decode(lines)
    chars = np.bincount(lines.unit * 4 + kind, weights=lines.end - lines.start, minlength=lines.n_units * 4).reshape(-1, 4)
    return chars, lines, kind


def not_prose(texts: list[str | None]) -> np.ndarray:
    """True where more than half of the characters are no running text."""
    chars, _, _ = kind_chars(texts)
    return chars[:, 1:].sum(1) * 2 > chars.sum(1)
