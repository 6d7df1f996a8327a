"""Sentence boundaries of text without any punctuation, in scripts that put no blanks between words.

Every character is tagged *begins a sentence* or *inside* by a linear-chain model:
hashed n-grams of the characters around it give the emission scores, Viterbi
decoding the best path.  The model is an averaged perceptron trained on punctuated
texts whose punctuation and blanks were stripped: the labels are the places where
a sentence ended before.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from .chains import viterbi

#: Letters of scripts without blanks between words, and the share of the visible characters from which a text is of that kind; the first that fits counts.
SCRIPTS = {"kana": (re.compile("[぀-ヿ]"), 0.2), "han": (re.compile("[㐀-鿿]"), 0.5), "thai": (re.compile("[฀-໿က-႟ក-៿]"), 0.5)}
#: Characters before and behind a place (from, to) that make up a feature.
WINDOWS = ((-1, 0), (0, 1), (-2, 0), (-1, 1), (0, 2), (-3, 0), (-2, 1), (-1, 2), (0, 3), (-4, 0), (0, 4), (-2, 2))
BITS = 15


def script_of(text: str) -> str | None:
    """The kind of script most visible characters are of."""
    solid = sum(not c.isspace() for c in text)
    return next((k for k, (rx, share) in SCRIPTS.items() if len(rx.findall(text)) > share * solid), None)


def is_bare(text: str) -> bool:
    """Without any punctuation, symbol or inner blank."""
    return not any(c.isspace() or unicodedata.category(c)[0] in "PS" for c in text)


def strip(text: str, sentences: list[tuple[int, int]]) -> tuple[str, np.ndarray]:
    """(the text without punctuation and blanks, 1 where a sentence begins behind another)."""
    first = {a for a, _ in sentences[1:]}
    out, gold, begins = [], [], False
    for i, c in enumerate(text):
        begins |= i in first
        if c.isspace() or unicodedata.category(c)[0] in "PSC":
            continue
        out.append(c)
        gold.append(int(begins and len(out) > 1))
        begins = False
    return "".join(out), np.array(gold, np.int8)


def features(text: str) -> np.ndarray:
    """[characters, windows] numbers of the n-grams around the place before each character."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pad = np.concatenate((np.zeros(4, np.uint64), a, np.zeros(4, np.uint64)))
    cols = []
    for w, (lo, hi) in enumerate(WINDOWS):
        h = np.full(len(a), w + 1, np.uint64)
        for k in range(lo, hi):
            h = (h ^ pad[4 + k : 4 + k + len(a)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        cols.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.stack(cols, 1)


def decode(model: tuple[np.ndarray, np.ndarray], text: str) -> np.ndarray:
    """1 for every character that begins a sentence behind another."""
    weights, trans = model
    emit = np.zeros((len(text), 2))
    emit[:, 1] = weights[features(text)].sum(1)
    emit[0, 1] = -np.inf
    return viterbi(emit, np.array([0]), np.array([len(text)]), trans, np.zeros(2))


def f1(model: tuple[np.ndarray, np.ndarray], chains: list[tuple[str, np.ndarray]]) -> float:
    """Of the boundaries of texts the model has not seen."""
    hit = given = wanted = 0
    for text, gold in chains:
        got = decode(model, text)
        hit += int((got & gold).sum())
        given += int(got.sum())
        wanted += int(gold.sum())
    return 2 * hit / max(1, given + wanted)


def train(chains: list[tuple[str, np.ndarray]], epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    weights, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    total, trans_total, steps = np.zeros(1 << BITS), np.zeros((2, 2)), 0
    rng = np.random.default_rng(seed)
    feats = [features(t) for t, _ in chains]
    for _ in range(epochs):
        for i in rng.permutation(len(chains)):
            gold, f = chains[i][1], feats[i]
            emit = np.zeros((len(gold), 2))
            emit[:, 1] = weights[f].sum(1)
            emit[np.arange(len(gold)), 1 - gold] += 1.0  # a margin
            emit[0, 1] = -np.inf
            got = viterbi(emit, np.array([0]), np.array([len(gold)]), trans, np.zeros(2))
            for sign, tags in ((1.0, gold), (-1.0, got)):
                np.add.at(weights, f[tags > 0].ravel(), sign)
                np.add.at(trans, (tags[:-1], tags[1:]), 0.002 * sign)
            steps += 1
            if steps % 20 == 0:
                total += weights
                trans_total += trans
    n = max(1, steps // 20)
    return (total / n).round(2), (trans_total / n).round(3)
