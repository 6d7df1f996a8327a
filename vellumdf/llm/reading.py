"""Problem 2: the reading level of each section.

Length, vocabulary, syntax and cohesion of the running text - consistent form,
without list, table and junk paragraphs - are the features of gradient-boosted
regression trees that predict the reading grade (words per sentence plus the
percentage of long words), calibrated and cross-validated by source (book).  The
two parts of that grade are no features: the trees see quantiles and spread of
the sentence lengths, moments of the word lengths, and the rest.  The calibrated
prediction alone sets the level; the grade counted in the text stands beside it
in ``reading_levels`` and decides nothing.  The model lies in
``models/reading.json`` (see ``train``).

Graded is every section that is mostly running text, written in Latin or Cyrillic
letters, with at least 100 words.  Others, null and empty ones have no grade.
"""

from __future__ import annotations

import functools
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from . import boosting
from .batches import map_texts
from .lines import CONSONANT, UNCASED, UPPER_C, UPPER_V, VOWEL, Lines, _classes, _folds, _weights, code_points, decode
from .lookalikes import reading_forms
from .sentences import spans

MODEL = Path(__file__).parent / "models" / "reading.json"
EASY, HARD, LEAST_WORDS, LONG = 30.0, 50.0, 100, 6
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
FEATURES = (
    "sentence_length_p10", "sentence_length_p25", "sentence_length_p50", "sentence_length_p75", "sentence_length_p90", "sentence_length_sd",
    "letters_per_word", "letters_per_word_sd", "short_word_share", "very_long_word_share", "type_ratio", "once_share",
    "commas_per_sentence", "clauses_per_sentence", "quotes_per_sentence", "overlap", "log_words",
)


def _is_letter(cls: np.ndarray) -> np.ndarray:
    return (cls == VOWEL) | (cls == CONSONANT) | (cls == UNCASED) | (cls == UPPER_V) | (cls == UPPER_C)


class Words:
    """Words of a batch: runs of letters joined by ’ ' or -, with their letters and text."""

    def __init__(self, texts: list[str]):
        a = code_points(texts)
        cls = _classes()[np.minimum(a, 0x10000)]
        letter = _is_letter(cls)
        inner = np.zeros(len(a), bool)
        if len(a) > 2:
            b = a[1:-1]
            inner[1:-1] = letter[:-2] & letter[2:] & ((b == 0x2019) | (b == 0x27) | (b == 0x2D))
        wordy = letter | inner
        new = wordy.copy()
        new[1:] &= ~wordy[:-1]
        ws = np.flatnonzero(new)
        at = np.flatnonzero(letter)
        wid = np.cumsum(new)[at] - 1
        self.start = ws
        self.letters = np.bincount(wid, minlength=len(ws))
        small = _folds()[1]
        h = small[np.minimum(a[at], 0x10000)].astype(np.uint64) * _weights()[(at - ws[wid]) & 63] if len(at) else np.zeros(0, np.uint64)
        self.hash = np.add.reduceat(h, np.cumsum(letter)[ws] - 1) if len(ws) else np.zeros(0, np.uint64)
        zero = np.flatnonzero(a == 0)
        self.text = np.searchsorted(zero, ws)
        self.first = np.concatenate(([0], zero[:-1] + 1)) if len(zero) else zero
        latin = letter & ((a < 0x250) | (a >= 0x1E00) & (a < 0x1F00))
        cyrillic = letter & (a >= 0x400) & (a < 0x530)
        text_of = np.repeat(np.arange(len(texts)), zero - self.first + 1)
        per = lambda m: np.bincount(text_of[m], minlength=len(texts))
        self.script = (per(latin) + per(cyrillic)) / np.maximum(per(letter), 1)
        self.count = np.bincount(self.text, minlength=len(texts))
        self.commas = per((a == 0x2C) | (a == 0x3B) | (a == 0x3A))
        self.clauses = per((a == 0x3B) | (a == 0x3A) | (a == 0x28) | (a == 0x2013) | (a == 0x2014) | (a == 0x2026))
        self.quotes = per((a == 0x22) | (a >= 0x201C) & (a <= 0x201E) | (a == 0xAB) | (a == 0xBB))


def running_text(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(the texts without their list, table and junk paragraphs, whether a text is mostly no running text)."""
    lines = Lines(texts)
    kind = decode(lines)
    size = lines.end - lines.start
    bad = np.bincount(lines.unit, weights=size * (kind > 0), minlength=lines.n_units)
    all_ = np.bincount(lines.unit, weights=size, minlength=lines.n_units)
    # lines that follow each other without a blank line are one paragraph
    new = np.ones(len(size), bool)
    new[1:] = (lines.unit[1:] != lines.unit[:-1]) | (lines.start[1:] > lines.end[:-1] + 1)
    para = np.cumsum(new) - 1
    n = int(para[-1]) + 1 if len(para) else 0
    keep = np.bincount(para, weights=size * (kind > 0), minlength=n) * 2 <= np.bincount(para, weights=size, minlength=n)
    begin = lines.start[new]
    end = lines.end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(size) - 1]))] if n else begin
    unit = lines.unit[new]
    parts: list[list[str]] = [[] for _ in texts]
    for u, a, b, k in zip(unit.tolist(), (begin - lines.unit_start[unit]).tolist(), (end - lines.unit_start[unit]).tolist(), keep.tolist(), strict=True):
        if k:
            parts[u].append((texts[u] or "")[a:b])
    return ["\n\n".join(p) for p in parts], bad * 2 > all_


def measure(stored: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([texts, FEATURES], the counted grade, whether the text is graded)."""
    forms = reading_forms(stored)
    text, no_prose = running_text(forms)
    whole, w = Words([f or "" for f in forms]), Words(text)
    n = len(text)
    cuts = spans(text)
    n_sent = np.array([len(c) for c in cuts])
    starts = np.array([w.first[i] + a for i, c in enumerate(cuts) for a, _ in c], np.int64)
    sent_text = np.repeat(np.arange(n), n_sent)
    sent = np.searchsorted(starts, w.start, side="right") - 1
    per_sent = np.bincount(np.maximum(sent, 0), minlength=max(len(starts), 1))[: len(starts)].astype(float)
    one = np.maximum
    words = w.count.astype(float)
    cols: dict[str, np.ndarray] = {}
    per_text = words / one(n_sent, 1)
    sq = np.bincount(sent_text, weights=per_sent**2, minlength=n) / one(n_sent, 1)
    cols["sentence_length_sd"] = np.sqrt(one(sq - per_text**2, 0))
    order = np.lexsort((per_sent, sent_text))
    first = np.concatenate(([0], np.cumsum(n_sent)[:-1])) if n else n_sent
    has = n_sent > 0
    ranked = per_sent[order]
    for q in QUANTILES:
        place = (n_sent - 1).clip(min=0) * q
        low, part = place.astype(int), place - place.astype(int)
        v = np.zeros(n)
        at = lambda k: ranked[(first + k.clip(max=one(n_sent - 1, 0)))[has]]
        v[has] = at(low) * (1 - part[has]) + at(low + 1) * part[has]
        cols[f"sentence_length_p{round(100 * q)}"] = v
    per = lambda v: np.bincount(w.text, weights=v, minlength=n)
    long_share = 100 * per(w.letters > LONG) / one(words, 1)
    mean = cols["letters_per_word"] = per(w.letters) / one(words, 1)
    cols["letters_per_word_sd"] = np.sqrt(one(per(w.letters.astype(float) ** 2) / one(words, 1) - mean**2, 0))
    cols["short_word_share"] = 100 * per(w.letters <= 3) / one(words, 1)
    cols["very_long_word_share"] = 100 * per(w.letters > 10) / one(words, 1)
    # vocabulary: distinct words of each text and words that occur once in it
    _, kind, times = np.unique(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    where = np.zeros(len(times), np.int64)
    where[kind] = w.text
    cols["type_ratio"] = np.bincount(where, minlength=n) / one(np.sqrt(words), 1)
    cols["once_share"] = np.bincount(where[times == 1], minlength=n) / one(words, 1)
    cols["commas_per_sentence"] = w.commas / one(n_sent, 1)
    cols["clauses_per_sentence"] = w.clauses / one(n_sent, 1)
    cols["quotes_per_sentence"] = w.quotes / one(n_sent, 1)
    # cohesion: words of more than three letters that the next sentence repeats
    big = (w.letters > 3) & (sent >= 0)
    width = len(starts) + 1
    key = np.unique(kind[big].astype(np.int64) * width + sent[big])
    again = key[1:][np.diff(key) == 1]
    cols["overlap"] = np.bincount(sent_text[again % width], minlength=n) / one(n_sent, 1)
    cols["log_words"] = np.log1p(words)
    f = np.stack([cols[x] for x in FEATURES], 1)
    graded = ~no_prose & (whole.script > 0.5) & (whole.count >= LEAST_WORDS) & (words > 0) & (n_sent > 0)
    return f, per_text + long_share, graded


def level_of(grade: float) -> str:
    return "easy" if grade < EASY else "medium" if grade < HARD else "hard"


def train(texts: list[str], sources: list[str], folds: int = 5) -> dict:
    """Model, calibration (line from prediction to grade, fitted on held-out books) and the errors of cross-validation by source."""
    f, y, ok = measure(texts)
    f, y = f[ok], y[ok]
    src = np.array(sources)[ok]
    fold_of = {s: i % folds for i, s in enumerate(sorted(set(src.tolist())))}
    fold = np.array([fold_of[s] for s in src])
    held = np.zeros(len(y))
    for k in range(folds):
        held[fold == k] = boosting.predict(boosting.fit(f[fold != k], y[fold != k]), f[fold == k])
    slope, offset = np.polyfit(held, y, 1)
    calibrated = slope * held + offset
    error = np.abs(calibrated - y)
    model = boosting.fit(f, y)
    for t in model["trees"]:
        t["threshold"] = [round(v, 5) for v in t["threshold"]]
        t["value"] = [round(v, 6) for v in t["value"]]
    right = np.array([level_of(a) == level_of(b) for a, b in zip(calibrated, y, strict=True)])
    by_source = [float(right[src == s].mean()) for s in fold_of]
    return {
        "model": model, "slope": float(slope), "offset": float(offset), "mean_error": float(error.mean()), "error_p99": float(np.quantile(error, 0.99)),
        "level_agreement": float(right.mean()), "least_agreement_of_a_source": min(by_source), "texts": int(len(y)), "sources": len(fold_of),
    }


@functools.cache
def _model() -> dict:
    m = json.loads(MODEL.read_text())
    return m | {"stacked": boosting.stacked(m["model"])}


def grades(stored: list[str | None]) -> list[tuple[float, float, str] | None]:
    """(predicted grade, counted grade, level) of each graded text."""
    m = _model()
    f, counted, ok = measure(stored)
    predicted = np.zeros(len(f))
    predicted[ok] = m["slope"] * boosting.predict_stacked(m["stacked"], f[ok]) + m["offset"]
    return [(float(p), float(c), level_of(p)) if o else None for p, c, o in zip(predicted, counted, ok, strict=True)]


def reading_levels(sections: DataFrame) -> DataFrame:
    """section_id, book_id, predicted_grade, counted_grade, reading_level of every graded section."""

    def run(c: dict[str, list]) -> dict[str, list]:
        rows = [(i, b, *g) for i, b, g in zip(c["section_id"], c["book_id"], grades(c["content"]), strict=True) if g]
        return {n: [r[k] for r in rows] for k, n in enumerate(("section_id", "book_id", "predicted_grade", "counted_grade", "reading_level"))}

    return map_texts(sections.select("section_id", "book_id", "content"), ["content"], run, "section_id long, book_id string, predicted_grade double, counted_grade double, reading_level string")
