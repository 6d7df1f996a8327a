"""Words, sentences and paragraphs as native column expressions.

Letter classes are spelt out as Unicode properties, which mean the same in Java
and in SQL engines with RE2; Java's own word class is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ABBREVIATIONS

L = r"\p{L}\p{Nl}\p{No}"
#: A word: letters (no decimal figures) joined by ’ ' or -.
WORD = rf"[{L}]+(?:[’'\-][{L}]+)*"
#: A word of the import counts: figures too.
IMPORT_WORD = r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*"
#: Blanks of every kind.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOPS = r'[.!?…]+["”’“»«]*'
BLANK_LINE = r"\n[ \t]*\n"
PARAGRAPH_BREAK = rf"\n{WS}*\n"
QUOTED = r'„[^“]*“|“[^”]*”|«[^»]*»|»[^«]*«|"[^"]*"'
DASH = r"[—–]"
ELLIPSIS = r"…|\.{3,}"
SCENE = r"^\s*(?:\*\s*\*\s*\*|\*{3,}|#{1,3}|[-–—]{3,}|⁂)\s*$"


def plain(word: Column) -> Column:
    """Small letters, straight apostrophe."""
    return F.regexp_replace(F.lower(word), "’", "'")


def words(text: Column) -> Column:
    """All words in order, plain."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), plain)


def word_count(text: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


#: Stands behind the end of a sentence or paragraph, and for the point of an abbreviation; texts do not hold them.
END, POINT = "\u0002", "\u0001"


def marked_sentences(text: Column) -> Column:
    """The text with END behind every sentence and POINT for points that end none: as long as the text but for the marks.

    A stop ends a sentence before a blank or the end, a blank line does too; a
    lone point behind an abbreviation or a single letter does not.
    """
    guarded = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?iu)(?<![{L}])({'|'.join(ABBREVIATIONS)}|[{L}])\.(?={WS}|\z)", f"$1{POINT}")
    return F.regexp_replace(F.regexp_replace(guarded, rf"({STOPS})(?={WS}|\z)", f"$1{END}"), f"({BLANK_LINE})", f"$1{END}")


def sentences(text: Column) -> Column:
    """Sentence texts in order; those without a word are left out."""
    return F.filter(F.split(F.regexp_replace(marked_sentences(text), POINT, "."), END), lambda s: s.rlike(WORD))


def paragraphs(text: Column) -> Column:
    """Paragraph texts in order; those without a word are left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_BREAK), lambda p: p.rlike(WORD))


def letters(word: Column) -> Column:
    return F.length(F.regexp_replace(word, r"[^\p{L}]", ""))


def syllables(word: Column, lang: Column) -> Column:
    """Estimate: German vowels and diphthongs; otherwise vowel groups without a silent final e."""
    german = F.greatest(F.lit(1), F.regexp_count(word, F.lit("au|äu|eu|ei|ai|ie|[aeiouyäöü]")))
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = word.endswith("e") & ~word.rlike("[^aeiouy]le$") & (groups > 1)
    return F.when(lang == "de", german).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def normalize_breaks(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, at most one blank line, trimmed.  Composition (NFC) is ``functions.unicode.nfc``."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+(?=\n)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), rf"^{WS}+", ""), rf"{WS}+\z", "")
