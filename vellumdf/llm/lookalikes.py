"""Consistent form of text: the confusables skeleton and the reading form.

Two forms are built from the same parts:

``skeleton``
    decompose, replace every character by the prototype from the look-alike
    table, decompose again, drop invisible characters, fold every run of
    blanks to one space and trim.  Values are equal in this form exactly when
    a reader cannot tell them apart; case, accents, quotation-mark shape and
    dash length stay distinct.

    The table is that of Unicode's confusables, read from the ICU library that is
    part of every Spark distribution, where it maps a letter of another script to
    one Latin letter; Cyrillic and Greek, in which whole texts are written, have a
    shorter table of their own that keeps their words apart.

``reading_forms``
    the same repairs without the cross-script step and composed again, with
    line breaks kept, for counting words and letters.

Null stays null, the empty string stays empty.
"""

from __future__ import annotations

import functools
import glob
import os
import re
import struct
import sys
import unicodedata
import zipfile

import numpy as np

# Letters of other scripts whose printed shape is that of a Latin
# letter.  Pairs of (look-alikes, Latin prototypes), position by position.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝүѵӏ", "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwyvl")
GREEK_CYRILLIC = ("ΓΠΦ", "ГПФ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΥϹϳονιαρυϲγ", "ABEZHIKMNOPTYXYCjoviapucy")
OTHER = ("ɑɡ‐‑‧∙⋅", "ag--···")

# Characters that print nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿︎️"

#: Compatibility forms that a reader takes for the plain letters.  Superscripts,
#: subscripts, fractions, circled and squared forms print differently and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")

BLANK = re.compile(r"\s+")


def _looks_same(ch: str) -> bool:
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not kind.startswith("<") or kind not in SAME_LOOK:
        return False
    # a spacing accent (´ ¨ ¸) decomposes to blank + mark: not the same look
    return not (kind == "<compat>" and rest.startswith("0020 "))


def _expand(ch: str) -> str:
    """Full decomposition through canonical steps and the same-look compatibility steps only."""
    d = unicodedata.decomposition(ch)
    if not d:
        return unicodedata.normalize("NFD", ch)
    if d.startswith("<"):
        if not _looks_same(ch):
            return ch
        d = d.partition(" ")[2]
    return "".join(_expand(chr(int(x, 16))) for x in d.split())


#: Scripts (first words of character names) of which Unicode's table is taken: those whose letters are shaped like Latin ones and in which none of the corpus is written.
CONFUSABLE_SCRIPTS = ("ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "DESERET", "OSAGE", "ELBASAN", "WARANG", "LYCIAN", "CARIAN", "OLD", "TIFINAGH", "CANADIAN", "MIAO")
ICU = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def _icu_jar() -> str:
    import pyspark

    for home in filter(None, (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__))):
        if found := sorted(glob.glob(os.path.join(home, "jars", "icu4j-[0-9]*.jar"))):
            return found[-1]
    raise FileNotFoundError("no icu4j jar in the Spark distribution: the look-alike table cannot be read")


@functools.cache
def confusables() -> dict[str, str]:
    """Unicode's prototype of every character that has one, from ICU's binary table: sorted keys (code point, length), values (a character or a place in the strings), strings."""
    with zipfile.ZipFile(_icu_jar()) as z:
        raw = z.read(ICU)
    raw = raw[struct.unpack(">H", raw[:2])[0] :]
    _, _, _, at_keys, n_keys, at_values, n_values, at_strings, n_strings = struct.unpack(">9I", raw[:36])
    strings = raw[at_strings : at_strings + 2 * n_strings]
    out = {}
    for key, value in zip(struct.unpack_from(f">{n_keys}I", raw, at_keys), struct.unpack_from(f">{n_values}H", raw, at_values), strict=True):
        n = (key >> 24) + 1
        out[chr(key & 0x1FFFFF)] = chr(value) if n == 1 else strings[2 * value : 2 * (value + n)].decode("utf-16-be")
    return out


@functools.cache
def foreign_letters() -> dict[str, str]:
    """Letters of CONFUSABLE_SCRIPTS and small capitals that look like one Latin letter; of two letters of a script with the same prototype the first, so that words of one script stay apart."""
    out: dict[str, str] = {}
    taken: set[tuple[str, str]] = set()
    for ch, to in confusables().items():
        script = unicodedata.name(ch, "").partition(" ")[0]
        small_capital = script == "LATIN" and "SMALL CAPITAL" in unicodedata.name(ch)
        if len(to) != 1 or not to.isascii() or not to.isalpha() or unicodedata.category(ch)[0] != "L" or not (script in CONFUSABLE_SCRIPTS or small_capital):
            continue
        if to == "l" and not ch.islower():  # the table has one prototype for I and l
            to = "I"
        if (script, to) not in taken:
            taken.add((script, to))
            out[ch] = to
    return out


@functools.cache
def tables() -> tuple[dict, dict]:
    """(skeleton, reading) translation tables: code point to string."""
    skel: dict[int, str] = {}
    read: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d.startswith("<") and _looks_same(ch):
            e = _expand(ch)
            if e != ch:
                skel[cp] = e
                read[cp] = e
        elif d and len(d.split()) == 1 and unicodedata.category(ch)[0] in "LPS":  # singletons such as the Kelvin sign
            read[cp] = unicodedata.normalize("NFC", ch)
    skel |= {ord(ch): to for ch, to in foreign_letters().items()}
    for twins, proto in (CYRILLIC, GREEK, GREEK_CYRILLIC, OTHER):
        for a, b in zip(twins, proto, strict=True):
            skel[ord(a)] = b
    read[0x2010] = read[0x2011] = "-"  # hyphens of the same length join words as the common one does
    for ch in INVISIBLE:
        skel[ord(ch)] = ""
        read[ord(ch)] = ""
    return skel, read


DROP, MANY = 0xFFFFFFFF, 0xFFFFFFFE


@functools.cache
def _array(which: int) -> np.ndarray:
    """A table over the basic plane (0: skeleton, 1: reading); characters that become several are marked MANY."""
    one = np.arange(0x10001, dtype=np.uint32)
    one[0x10000] = MANY
    for cp, to in tables()[which].items():
        if cp < 0x10000:
            one[cp] = DROP if not to else ord(to) if len(to) == 1 else MANY
    return one


def _prototypes(text: str, which: int = 0) -> str:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = _array(which)[np.minimum(a, 0x10000)]
    several = b == MANY
    if several.any():
        table = tables()[which]
        for cp in np.unique(a[several]).tolist():
            if cp in table:
                text = text.replace(chr(cp), table[cp])
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        b = _array(which)[np.minimum(a, 0x10000)]
        b = np.where(b == MANY, a, b)
    return b[b != DROP].tobytes().decode("utf-32-le", "surrogatepass")


def skeleton(text: str | None) -> str | None:
    if text is None:
        return None
    if text.isascii():
        return BLANK.sub(" ", text).strip()
    step = _prototypes if len(text) > 200 else lambda x: x.translate(tables()[0])
    once = step(unicodedata.normalize("NFD", text))
    return BLANK.sub(" ", unicodedata.normalize("NFD", step(once))).strip()


def skeletons(texts: list[str | None]) -> list[str | None]:
    """Skeletons of many texts, all at once over one string."""
    joined = "\x00".join((t or "").replace("\x00", "\ufffd") for t in texts)
    if not joined.isascii():
        # a prototype has no prototype of its own but where several characters took the place of one
        once = _prototypes(unicodedata.normalize("NFD", joined))
        joined = unicodedata.normalize("NFD", _prototypes(once))
    return [None if t is None else BLANK.sub(" ", s).strip() for t, s in zip(texts, joined.split("\x00"), strict=True)] if texts else []


def reading_forms(texts: list[str | None]) -> list[str | None]:
    """Repaired for reading and counting: plain letters, composed, nothing invisible; line breaks and foreign letters stay."""
    joined = "\x00".join((t or "").replace("\x00", "\ufffd") for t in texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", _prototypes(joined, 1))
    return [None if t is None else s for t, s in zip(texts, joined.split("\x00"), strict=True)] if texts else []
