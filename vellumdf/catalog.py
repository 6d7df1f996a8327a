"""The metrics: group, languages, least number of words."""

from __future__ import annotations

from typing import NamedTuple

ALL, DE_EN = ("de", "en", "und"), ("de", "en")


class Metric(NamedTuple):
    id: str
    group: str
    languages: tuple[str, ...] = ALL
    min_words: int = 100


# The metrics in order, with their groups, languages and least number of words.
METRICS = [
    Metric("lix", "readability"),
    Metric("rix", "readability"),
    Metric("fleschDe", "readability", ("de",)),
    Metric("fleschEn", "readability", ("en",)),
    Metric("fkGrade", "readability", ("en",)),
    Metric("wiener", "readability", ("de",)),
    Metric("wordLength", "readability"),
    Metric("longWords", "readability"),
    Metric("mattr", "vocabulary"),
    Metric("hdd", "vocabulary", ALL, 42),
    Metric("mtld", "vocabulary"),
    Metric("entropy", "vocabulary"),
    Metric("simpson", "vocabulary"),
    Metric("yule", "vocabulary"),
    Metric("hapax", "vocabulary"),
    Metric("topWords", "vocabulary", DE_EN),
    Metric("sentenceMean", "rhythm"),
    Metric("sentenceCV", "rhythm"),
    Metric("sentenceP90", "rhythm"),
    Metric("longSentences", "rhythm"),
    Metric("shortSentences", "rhythm"),
    Metric("rhythmChange", "rhythm"),
    Metric("rhythmLag", "rhythm"),
    Metric("paragraphMean", "rhythm"),
    Metric("paragraphCV", "rhythm"),
    Metric("trigramRepeat", "repetition"),
    Metric("sentenceRepeat", "repetition"),
    Metric("startRepeat", "repetition"),
    Metric("nearRepeat", "repetition", DE_EN),
    Metric("paragraphRepeat", "repetition"),
    Metric("cohesion", "cohesion", DE_EN),
    Metric("shifts", "cohesion", DE_EN),
    Metric("connectors", "cohesion", DE_EN),
    Metric("firstPerson", "cohesion", DE_EN),
    Metric("dialogue", "style"),
    Metric("questions", "style"),
    Metric("exclamations", "style"),
    Metric("commas", "style"),
    Metric("commaChains", "style"),
    Metric("dashes", "style"),
    Metric("parentheses", "style"),
    Metric("ellipses", "style"),
    Metric("fillers", "style", DE_EN),
    Metric("hedges", "style", DE_EN),
    Metric("intensifiers", "style", DE_EN),
    Metric("nominal", "style", DE_EN),
    Metric("adverbs", "style", DE_EN),
    Metric("passive", "style", DE_EN),
    Metric("negations", "style", DE_EN),
    Metric("sensory", "style", DE_EN),
    Metric("cognition", "style", DE_EN),
]
GROUPS = tuple(dict.fromkeys(m.group for m in METRICS))
#: Why a value is missing: for all metrics, and for single ones.
REASONS = {"disabled": "group disabled", "language": "not available for the language", "short": "too few words", "rhythmLag": "at least 10 sentences of varying length needed", "paragraphCV": "at least 3 paragraphs needed", "cohesion": "adjacent paragraphs of at least 12 words needed", "shifts": "adjacent paragraphs of at least 12 words needed", "mtld": "no finite factor", "other": "too few text units"}
