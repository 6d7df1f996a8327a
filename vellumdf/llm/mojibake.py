"""Text decoded with a wrong encoding: find the garbled spans, restore them.

Only matched spans are replaced, so correct text in the same record stays as
it is.

* One Aho-Corasick automaton holds the garbled sequences of all pairs of
  encodings, computed from the code pages (``sequences``): of UTF-8 read under the
  pages of READ_AS every lead byte with its first continuation byte; of one-byte
  pages read as others every two letters of the script (WRITTEN_SCRIPTS, REREAD)
  or an accented letter with its neighbour (LATIN_PAIRS); of two-byte pages
  (WRITTEN_DOUBLE) the kana, the commonest Chinese and all Korean characters.
* Only stretches that hold a hit of the automaton are decoded back.  A stretch is
  accepted when what comes out is text of ordinary word shapes and what is stored is
  not; a word of one or two letters, too short to judge, follows the garbled word
  beside it.  Stretches that touch another letter are part of its word and are
  no Cyrillic, Greek, Arabic, Hebrew or Thai.
* Texts damaged several times are repaired again until nothing is left.
* Not covered: UTF-8 read as a two-byte page.
* Characters lost for good (U+FFFD, also in its own garbled forms) are reported
  and left in place.

Null and empty texts have no garbled span and come back unchanged.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np

from .lookalikes import CYRILLIC

#: One-byte code pages under which UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1254", "cp1253", "koi8-r", "cp866", "iso8859-2", "cp1257", "cp1256")
#: Code pages under which a text in another one-byte page may have been read, and the pages it may have been written in.
READ_SIGNS = ("cp1252", "mac_roman", "latin-1", "cp437", "cp850", "cp1250")
WRITTEN_CYRILLIC = ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5")
WRITTEN_GREEK = ("cp1253", "iso8859-7")
WRITTEN_ARABIC = ("cp1256", "iso8859-6")
WRITTEN_HEBREW = ("cp1255",)
WRITTEN_THAI = ("cp874",)
WRITTEN_LATIN = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250")
WRITTEN_DOUBLE = ("shift_jis", "gbk", "euc_jp", "euc_kr", "big5")
READ_LATIN = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "latin-1")

# Letters with marks of the western and central alphabets.
ACCENTED = "äöüßéèêëàâçîïôûùœæñáíóúãõåøýþðąćęłńśźżÄÖÜÉÈÊËÀÂÇÎÏÔÛÙŒÆÑÁÍÓÚÃÕÅØÝÞÐĄĆĘŁŃŚŹŻ"
COMMON_ACCENTED = "äöüßéèêëàâçîïôûùœñáíóúãõÄÖÜÉÈÀÇÑÁÍÓÚ"
#: Signs that stand between words, restored when a letter-less span decodes to them.
PRINT_SIGNS = "“”„‘’‚«»–—…£€°§©® ¿¡•™·"

LOST = "�"
#: Characters of the longest sequence.
LONGEST = 2
TWINS = frozenset(CYRILLIC[0])


@functools.cache
def _table(codec: str) -> list[str | None]:
    """Character of every byte; bytes a Windows code page leaves open read as C1 controls."""
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b) if codec.startswith("cp125") else None)
    return out


@functools.cache
def _bytes_of(codec: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_table(codec)) if c is not None and b >= 0x80}


def _encode(s: str, codec: str) -> bytes | None:
    m = _bytes_of(codec)
    out = bytearray()
    for c in s:
        if c < "\x80":
            out.append(ord(c))
        else:
            b = m.get(c)
            if b is None:
                return None
            out.append(b)
    return bytes(out)


def _is_text(ch: str) -> bool:
    """A character that a correct text of the supported scripts may hold."""
    o = ord(ch)
    if o < 0xA0:
        return False
    if o < 0x180:
        return o != 0xAD
    cat = unicodedata.category(ch)
    if cat in ("Cn", "Co", "Cs", "Cc"):
        return False
    return ch in "șțȘȚƒˆ˜" or 0x300 <= o < 0x30D or 0x386 <= o < 0x3CF or 0x400 <= o < 0x460 or 0x490 <= o < 0x492 or 0x5D0 <= o < 0x700 or 0x900 <= o < 0xE80 or 0x1E00 <= o < 0x2070 or 0x20A0 <= o < 0x20C0 or 0x2100 <= o < 0x2200 or 0x2500 <= o < 0x2600 or 0x3000 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xFB00 <= o < 0xFB07 or 0xFF00 <= o < 0xFFF0 or ch in "​‌‍⁠﻿" or o == 0xFFFD or 0x1F300 <= o < 0x1FA00


def _utf8_sequences() -> Iterator[tuple[str, str, str]]:
    for codec in READ_AS:
        t = _table(codec)
        # under the DOS page only the lead bytes that print as frame characters are no letters of a plain text
        for lead in range(0xC2, 0xE0 if codec == "cp866" else 0xF5):
            for cont in range(0x80, 0xC0):
                if lead == 0xE0 and cont < 0xA0 or t[lead] is None or t[cont] is None or codec == "koi8-r" and t[cont].isalpha():
                    continue
                if lead < 0xE0 and not (_is_text(c := bytes([lead, cont]).decode()) or c == "\xad"):
                    continue
                yield t[lead] + t[cont], codec, "utf-8"


def _garbled(read: str, written: str, letters: str) -> dict[str, str]:
    """How each letter that both pages know prints under the wrong one."""
    out = {}
    for c in letters:
        try:
            g = _table(read)[c.encode(written)[0]]
        except UnicodeEncodeError:
            continue
        if g is not None and g >= "\x80":
            out[c] = g
    return out


def _script_sequences() -> Iterator[tuple[str, str, str]]:
    """Every two letters of a script: both small, or the first a capital, or both capitals."""
    for (read, written), script in SCRIPTS:
        g = _garbled(read, written, script.letters)
        small = [x for c, x in g.items() if not c.isupper()]
        for c, x in g.items():
            for y in small if script.cased and c.islower() else g.values():
                yield x + y, read, written


def _reread_sequences() -> Iterator[tuple[str, str, str]]:
    """Two Cyrillic letters under another Cyrillic page, where that shows: signs and letters no Russian word holds, capitals behind small letters."""
    for read, written in REREAD:
        g = _garbled(read, written, RUSSIAN)
        for a in g:
            for b in g:
                if a.islower() and b.isupper():
                    continue
                key = g[a] + g[b]
                if UNRUSSIAN.search(key) or key[0].islower() and key[1].isupper():
                    yield key, read, written


def _latin_sequences() -> Iterator[tuple[str, str, str]]:
    """An accented letter that prints as something no Latin word holds, with the letter before or behind it."""
    for read, written in LATIN_PAIRS:
        letters, signs = _garbled(read, written, COMMON_ACCENTED), _garbled(read, written, PRINT_SIGNS)
        marks = {q for q in signs.values() if not q.isalpha()}
        odd_marks = {q for q in marks if _odd_inside(q)}
        for g in {*letters.values(), *signs.values()}:
            if _odd_inside(g):
                for c in string.ascii_letters + "-’'":
                    yield c + g, read, written
                    yield g + c, read, written
            # behind a garbled quotation mark
            for q in marks if _odd_inside(g) else odd_marks:
                yield q + g, read, written


def _double_sequences() -> Iterator[tuple[str, str, str]]:
    kana = "".join(map(chr, range(0x3041, 0x30FB)))
    hangul = "".join(map(chr, range(0xAC00, 0xD7A4)))
    for read in READ_DOUBLE:
        t = _table(read)
        for written in WRITTEN_DOUBLE:
            for c in hangul if written == "euc_kr" else kana + "".join(COMMON_HAN):
                try:
                    raw = c.encode(written)
                except UnicodeEncodeError:
                    continue
                if len(raw) == 2 and all(t[x] is not None for x in raw):
                    yield t[raw[0]] + t[raw[1]], read, written


def sequences() -> dict[str, set[tuple[str, str]]]:
    """Every garbled sequence with the (read, written) pairs of encodings that give it."""
    out: dict[str, set[tuple[str, str]]] = {}
    for key, read, written in itertools.chain(_utf8_sequences(), _script_sequences(), _reread_sequences(), _latin_sequences(), _double_sequences()):
        if not key.isascii():
            out.setdefault(key, set()).add((read, written))
    return out


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """All garbled sequences, each with its length, the code pages that read UTF-8 so and the other pairs."""
    a = ahocorasick.Automaton()
    shared: dict[tuple, tuple] = {}  # many sequences have the same pairs
    for key, pairs in sequences().items():
        utf8 = tuple(c for c in READ_AS if (c, "utf-8") in pairs)
        value = (len(key), utf8, frozenset(p for p in pairs if p[1] != "utf-8"))
        a.add_word(key, shared.setdefault(value, value))
    a.make_automaton()
    return a


#: Start, end, pages that read UTF-8 so, other (read, written) pairs.
Hit = tuple[int, int, tuple[str, ...], frozenset]


@functools.cache
def _heads() -> np.ndarray:
    """Which two neighbouring characters (hashed to 22 bits) begin a sequence: a cheap test before the automaton runs."""
    keys = np.array([(ord(k[0]), ord(k[1])) for k in automaton()], np.uint32)
    out = np.zeros(1 << 22, bool)
    out[(keys[:, 0] * np.uint32(40503) + keys[:, 1]) & 0x3FFFFF] = True
    return out


def matched(text: str) -> list[Hit]:
    """Hits of the automaton, which runs only where two characters begin a sequence."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_heads()[(a[:-1] * np.uint32(40503) + a[1:]) & 0x3FFFFF])
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) > 16) + 1
    hits: list[Hit] = []
    find = automaton()
    for i, j in zip(at[np.concatenate(([0], edge))].tolist(), at[np.concatenate((edge - 1, [len(at) - 1]))].tolist(), strict=True):
        hits += [(stop - n + 1, stop + 1, utf8, pairs) for stop, (n, utf8, pairs) in find.iter(text, i, min(j + LONGEST, len(text)))]
    return hits


def _pairs_in(runs: list[re.Match], hits: list[Hit]) -> list[set]:
    """The pairs whose sequences lie within each run."""
    out: list[set] = []
    k = 0
    for m in runs:
        while k < len(hits) and hits[k][0] < m.start():
            k += 1
        own: set = set()
        i = k
        while i < len(hits) and hits[i][0] < m.end():
            if hits[i][1] <= m.end():
                own |= hits[i][3]
            i += 1
        out.append(own)
    return out


@functools.cache
def _rest_pattern(codec: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(_bytes_of(codec))) + "]+")


def _letters(s: str) -> bool:
    return all(unicodedata.category(c)[0] in "LM" for c in s)


def _frame(c: str) -> bool:
    return "─" <= c < "■"


def _case_breaks(before: str, s: str) -> int:
    """Capitals right after small letters, and letters that few texts use."""
    n, last = 0, before
    for c in s:
        n += last.islower() and c.isupper()
        n += c.isalpha() and c < "ʰ" and c not in COMMON_ACCENTED
        last = c
    return n


def _utf8_at(text: str, at: int, codec: str, sure: bool = False) -> tuple[int, str, int] | None:
    """Longest stretch from ``at`` that is UTF-8 read under the code page: (end, restored, doubt).

    ``sure``: the text has plain evidence of that code page elsewhere, so that two letters which stand alone count too.
    """
    # a growing stretch: most end after a few characters, and a long one must not be decoded from every hit
    room, good = 32, ""
    while m := _rest_pattern(codec).match(text, at, at + room):
        raw = _encode(m.group(), codec)
        try:
            good = raw.decode("utf-8")
            stop = len(raw)
        except UnicodeDecodeError as e:
            good = raw[: e.start].decode("utf-8")
            stop = e.start
        if stop < len(raw) - 3 or len(raw) < room:
            break
        room *= 4
    k = 0
    while k < len(good) and (_is_text(good[k]) or good[k] == "\xad" or "\x80" <= good[k] < "\xa0"):
        k += 1
    good = good[:k]
    n = len(good.encode("utf-8"))
    if not n:
        return None
    before, after = text[at - 1 : at], text[at + n : at + n + 1]
    stored = re.sub("[\x80-\x9f\xad]", "", text[at : at + n])
    inside = before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
    if n == 2 and stored > "Ͱ" and _letters(stored) and not (inside and good in COMMON_ACCENTED) and not (good in "£€¥" and after.isdigit()) and not (sure and not before.isalpha() and not after.isalpha()):
        return None  # letters of one alphabet side by side are no evidence alone
    if codec in ("cp1256", "koi8-r") and len(good) == 1 and not sure:
        return None  # an Arabic letter before a comma, a Cyrillic one before the frame of a table
    if codec == "koi8-r" and not any(map(_frame, stored)):
        return None  # Cyrillic letters with blanks that do not break
    if codec in ("cp1257", "iso8859-2", "cp1256") and inside and any(c.isalpha() and c > "Ͱ" for c in good):
        return None  # a letter of another script within a Latin word
    if len(good) == 1 and n > 2 and stored > "Ͱ" and _letters(stored) and good not in PRINT_SIGNS:
        return None  # three look-alike letters in a row, put in on purpose
    if any(map(_frame, stored)) and not all(c in COMMON_ACCENTED or c in PRINT_SIGNS or c.isalpha() and "Ά" <= c < "݀" or "฀" <= c < "຀" or _is_cjk(c) for c in good):
        return None  # a frame drawn with line characters
    return at + n, good, _case_breaks(before, good)


def _word_shape(w: str) -> bool:
    """Lower case, capitalised or all capitals, as words of cased scripts are written."""
    return w.islower() or w[:1].isupper() and (not w[1:] or w[1:].islower()) or w.isupper()


CYRILLIC_WORD = re.compile("[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*$")
GREEK_WORD = re.compile("[Ά-ώ]+$")
# The letters most Russian and Greek words are made of.
FREQUENT_CYRILLIC = frozenset("оеаинтсрвлкмдпуяы")
FREQUENT_GREEK = frozenset("αοιετσνηυρπκμλ")
AROUND = "«»“”„‘’—–-…№·. \xa0\u202f\u2009\xad"
RUN = re.compile(r"[^\x00-\x7f\s]+")
CHUNK = re.compile(r"\S*[^\x00-\x7f\s]\S*")
WORD = re.compile(r"[^\s.,;:!?()\[\]{}<>\"/|=+*#]*[^\x00-\x7f\s][^\s.,;:!?()\[\]{}<>\"/|=+*#]*")
#: Characters that a letter of another script turns into under the pages of READ_SIGNS.
SIGN_CHARS = "\x80-\xffŒœŠšŸŽžƒˆ˜ıˇ˘˙˚˛˝–—‘-„†-•…‰‹›⁄€™Ω∂∆∏∑−√∞∫≈≠≤≥◊\uf8ffﬁﬂĂ-ž─-▟ΓΘΣΦαδεπστφⁿ₧⌐⌠⌡∙∩≡■"
ANY_SIGNS = re.compile(f"[{SIGN_CHARS}]+")
READ_DOUBLE = ("cp1252", "latin-1", "mac_roman")
LATIN_PAIRS = tuple((r, w) for r in READ_LATIN for w in WRITTEN_LATIN if r != w and not {r, w} <= {"cp1252", "latin-1", "cp1250"})


def _decode(s: str, read: str, written: str) -> str | None:
    raw = _encode(s, read)
    if raw is None:
        return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def _is_utf8(run: str) -> bool:
    """UTF-8 under one of the sign pages, up to a cut last character."""
    for read in (*READ_SIGNS, "iso8859-15"):
        raw = _encode(run, read)
        if raw is not None:
            try:
                got = raw.decode("utf-8")
                if all(map(_is_text, got)) and (len(got) > 1 or got in COMMON_ACCENTED or got in PRINT_SIGNS):
                    return True
            except UnicodeDecodeError as e:
                if len(raw) > 6 and e.start >= len(raw) - 3:
                    return True
    return False


def _is_foreign(run: str) -> bool:
    """Mostly accented letters and signs that stand for letters: no frame, no row of punctuation, no plain Greek word."""
    return sum(c.isalpha() and c < "Ͱ" or c not in AROUND and not _frame(c) and not c.isalpha() for c in run) * 2 > len(run) and len(set(run)) > 1


class Script(NamedTuple):
    """A script of one-byte pages: its words, letters, commonest letters, and whether it has capitals."""

    word: re.Pattern
    letters: str
    frequent: frozenset[str]
    cased: bool


# The letters of the scripts, and those most of their words are made of.
RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
GREEK_LETTERS = "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ"
ARABIC_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
HEBREW_LETTERS = "אבגדהוזחטיךכלםמןנסעףפץצקרשת"
CYRILLIC_SCRIPT = Script(CYRILLIC_WORD, RUSSIAN, FREQUENT_CYRILLIC, True)
GREEK_SCRIPT = Script(GREEK_WORD, GREEK_LETTERS, FREQUENT_GREEK, True)
ARABIC_SCRIPT = Script(re.compile("[ء-غـ-ْ]+$"), ARABIC_LETTERS, frozenset("اليمونرتبةعدسفهك"), False)
HEBREW_SCRIPT = Script(re.compile("[א-ת]+$"), HEBREW_LETTERS, frozenset("יוהלאתרמבשנ"), False)
THAI_SCRIPT = Script(re.compile("[ก-ฺเ-๎]+$"), "".join(map(chr, [*range(0xE01, 0xE3B), *range(0xE40, 0xE4F)])), frozenset("านรอกเงมยลวดทตสะปบค่้ีัิ"), False)
WRITTEN_SCRIPTS = ((WRITTEN_CYRILLIC, CYRILLIC_SCRIPT), (WRITTEN_GREEK, GREEK_SCRIPT), (WRITTEN_ARABIC, ARABIC_SCRIPT), (WRITTEN_HEBREW, HEBREW_SCRIPT), (WRITTEN_THAI, THAI_SCRIPT))
SCRIPTS = tuple(((r, w), script) for pages, script in WRITTEN_SCRIPTS for r in READ_SIGNS for w in pages)


def _rank(got: str | None, script: Script) -> float:
    """How much a decoded run is a word of the script: its letters times the share of frequent ones beyond chance."""
    core = got.strip(AROUND) if got else ""
    if len(core) < 3 or not script.word.match(core) or script.cased and not _word_shape(core.replace("ς", "σ")):
        return 0.0
    low = core.lower().translate(UNACCENT)
    return max(0.0, sum(c in script.frequent for c in low) / len(low) - 0.4) * len(low) * (0.6 if core.isupper() else 1.0)


UNACCENT = str.maketrans("άέήίόύώϊϋΐΰё", "αεηιουωιυιυе")


def _beside(text: str, runs: list[re.Match], sure: list[bool], maybe: list[bool]) -> list[bool]:
    """``sure`` runs and those that may be garbled and have no letter between them and one that counts already."""
    out = list(sure)
    apart = [any(map(str.isalpha, text[a.end() : b.start()])) for a, b in itertools.pairwise(runs)]
    for order, step in ((range(1, len(runs)), -1), (range(len(runs) - 2, -1, -1), 1)):
        for i in order:
            if maybe[i] and not out[i] and out[i + step] and not apart[min(i, i + step)]:
                out[i] = True
    return out


def _within_word(text: str, m: re.Match) -> bool:
    """A letter that is no part of the stretch touches it."""
    return text[max(0, m.start() - 1) : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha()


def _script_spans(text: str, hits: list[Hit]) -> list[tuple[int, int, str]]:
    """Words of other scripts in one-byte pages: the pair that explains most runs of the text is tried on all runs with its sequences."""
    runs = list(ANY_SIGNS.finditer(text))
    own = _pairs_in(runs, hits)
    telling = [(m, p) for m, p in zip(runs, own, strict=True) if p and len(m.group()) >= 3 and _is_foreign(m.group()) and not _is_utf8(m.group())]
    # letters of a page without capitals lie among its signs: a row of signs alone is none of its words
    votes = [sum(_rank(_decode(m.group(), *pair), script) for m, p in telling if pair in p and (script.cased or any(map(str.isalpha, m.group())))) for pair, script in SCRIPTS]
    best = max(range(len(votes)), key=votes.__getitem__)
    if votes[best] <= 0.75:
        return []
    pair, script = SCRIPTS[best]
    decoded = [_decode(m.group(), *pair) for m in runs]
    cores = [got.strip(AROUND) if got else "" for got in decoded]
    fits = [bool(core and script.word.match(core) and not _within_word(text, m)) for core, m in zip(cores, runs, strict=True)]
    sure = [f and pair in p and len(core) > 2 for f, p, core in zip(fits, own, cores, strict=True)]
    maybe = [f and (len(core) > 1 or script.cased and _word_shape(core)) for f, core in zip(fits, cores, strict=True)]
    return [(m.start(), m.end(), got) for m, got, ok in zip(runs, decoded, _beside(text, runs, sure, maybe), strict=True) if ok]


def _is_cjk(c: str) -> bool:
    return "぀" <= c < "㄀" or "一" <= c < "龦" or "가" <= c < "힤" or "　" <= c < "〿" or "＀" <= c < "￯"


# The commonest characters of Chinese text.
COMMON_HAN = frozenset("的了是在我有不这這个個那们們到和地人来來说說里裡着著把了只又上")


def _double_spans(text: str, hits: list[Hit]) -> list[tuple[int, int, str]]:
    """Chinese, Japanese and Korean text of two-byte pages."""
    spans = []
    chunks = list(CHUNK.finditer(text))
    for m, own in zip(chunks, _pairs_in(chunks, hits), strict=True):
        chunk = m.group()
        if not own or sum(c >= "\x80" for c in chunk) < 6 or any(_is_cjk(c) for c in chunk) or any(map(_is_utf8, RUN.findall(chunk))):
            continue
        best: tuple[float, str] | None = None
        for read in READ_DOUBLE:
            raw = _encode(chunk, read)
            if raw is None:
                continue
            for written in WRITTEN_DOUBLE:
                if (read, written) not in own:
                    continue
                got = raw.decode(written, "replace")
                n = len(got)
                telling = sum("぀" <= c < "㄀" or c in COMMON_HAN or "가" <= c < "힤" for c in got)
                if sum(map(_is_cjk, got)) >= 0.8 * n and telling >= 0.15 * n and got.count(LOST) <= 0.1 * n:
                    r = telling / n - got.count(LOST) / n
                    if best is None or r > best[0]:
                        best = (r, got)
        if best:
            spans.append((m.start(), m.end(), best[1]))
    return spans


def _odd_inside(c: str) -> bool:
    """Never a letter of a Latin word: signs, controls, and foreign letters that look like no Latin one."""
    if "Ѐ" <= c < "԰":
        return c not in TWINS
    return c not in ACCENTED and c not in "‐‑’‘–—…“”„«»·®™©°º№¿¡\xa0\xad​‌‍⁠\ufeff" and (unicodedata.category(c)[0] in "SCP" or c in "ŸƒŠŽšžıˆ˜ªÌÒÕﬂﬁ" or c in "ⁿφαδεπστΓΣΘΦΩ")


def _latin_word(w: str, read: str, written: str) -> str | None:
    """A Latin word with a sign or foreign letter inside that is an accented letter under another code page."""
    if read == "cp1251" and any(c in TWINS for c in w):
        return None  # look-alike letters put in on purpose
    got = _decode(w, read, written)
    if got is None or got == w:
        return None
    changed = [(a, b) for a, b in zip(w, got, strict=True) if a != b]
    if not any(_odd_inside(a) for a, _ in changed) or not any(b in COMMON_ACCENTED for _, b in changed):
        return None
    if not all(b in COMMON_ACCENTED or b in PRINT_SIGNS for _, b in changed):
        return None
    parts = re.findall(r"[^\W\d_]+", got)
    return got if parts and all(_word_shape(x.replace("ß", "s")) for x in parts) else None


#: Quotation marks of the Macintosh page read as Windows letters: they touch punctuation instead of a word.
STRAY_QUOTE = re.compile(r"(?<=[.!?,])[ÒÓÔÕ](?=[\s,.;:]|$)|(?<![^\W\d_])[ãÒÔ](?=[A-ZÄÖÜ][a-zäöüß])")


def _stray_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().encode("cp1252").decode("mac_roman")) for m in STRAY_QUOTE.finditer(text)]


def _latin_spans(text: str, hits: list[Hit]) -> list[tuple[int, int, str]]:
    words = list(WORD.finditer(text))
    odd, own = [], []
    for m, p in zip(words, _pairs_in(words, hits), strict=True):
        if p and any(c >= "\x80" and _odd_inside(c) for c in m.group()) and any(c.isascii() and c.isalpha() for c in m.group()):
            odd.append(m)
            own.append(p)
    if not odd:
        return []
    letters = sum(c < "\x80" for c in text if c.isalpha()) * 2
    pairs = [p for p in LATIN_PAIRS if not (p[0] == "cp1251" and sum("Ѐ" <= c < "԰" for c in text) > letters / 4 or p[0] == "cp437" and sum("Ͱ" <= c < "Ѐ" for c in text) > letters / 4)]
    fixed = {p: [_latin_word(m.group(), *p) if p in has else None for m, has in zip(odd, own, strict=True)] for p in pairs}
    order = sorted(fixed, key=lambda p: -sum(g is not None for g in fixed[p]))
    spans = []
    for k, m in enumerate(odd):
        got = next((fixed[p][k] for p in order if fixed[p][k] is not None), None)
        if got is not None:
            spans.append((m.start(), m.end(), got))
    return spans


#: Characters of the Cyrillic code pages that Russian words do not hold, look-alikes left out.
UNRUSSIAN = re.compile("[ЂЃ‚ѓ‡€‰ЉЊЌЋЏђљњќћџЎўҐґ¤¦§©Є¬®Ї°±µ¶№єї]")
HIGH_1251 = re.compile("[" + re.escape("".join(_bytes_of("cp1251"))) + "]+")
REREAD = (
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"),
    ("koi8-r", "cp866"), ("koi8-r", "mac_cyrillic"), ("mac_cyrillic", "koi8-r"), ("mac_cyrillic", "cp866"),
)


def _plain_word(w: str) -> bool:
    return w.isalpha() and _word_shape(w)


def _is_utf8_of(run: str, read: str) -> bool:
    raw = _encode(run, read)
    try:
        return raw is not None and len(raw) > 1 and all(map(_is_text, raw.decode("utf-8")))
    except UnicodeDecodeError:
        return False


def _reread_spans(text: str, hits: list[Hit]) -> list[tuple[int, int, str]]:
    """Cyrillic of one code page read under another: the pair that explains most words with its sequences."""
    runs = list(HIGH_1251.finditer(text))
    own = _pairs_in(runs, hits)
    good = [not _within_word(text, m) and not _is_utf8_of(m.group(), "cp1251") for m in runs]
    telling = [(m, p) for m, p, g in zip(runs, own, good, strict=True) if g and p and len(m.group()) > 2 and any(map(str.isalpha, m.group())) and not _plain_word(m.group())]
    votes = {pair: sum(_rank(_decode(m.group(), *pair), CYRILLIC_SCRIPT) for m, p in telling if pair in p) for pair in REREAD}
    best = max(votes, key=votes.get)
    if votes[best] <= 0.75:
        return []
    decoded = [_decode(m.group(), *best) for m in runs]
    cores = [got.strip(AROUND) if got else "" for got in decoded]
    fits = [bool(g and (len(core) == 1 or len(set(core)) > 1) and CYRILLIC_WORD.match(core) and _word_shape(core)) for g, core in zip(good, cores, strict=True)]
    sure = [f and best in p and not _plain_word(m.group()) for f, p, m in zip(fits, own, runs, strict=True)]
    # a word that prints as one of plain letters follows the garbled words beside it
    usual = lambda w: sum(c in FREQUENT_CYRILLIC for c in w.lower()) / max(1, len(w))
    maybe = [f and (not m.group().islower() or usual(core) > usual(m.group())) for f, core, m in zip(fits, cores, runs, strict=True)]
    return [(m.start(), m.end(), got) for m, got, ok in zip(runs, decoded, _beside(text, runs, sure, maybe), strict=True) if ok]


def _spans_utf8(text: str, found_hits: list[Hit]) -> list[tuple[int, int, str]]:
    """The code page that explains most of the text's hits goes first; a hit it cannot explain falls to the next."""
    hits = [(at, codecs) for at, _, codecs, _ in found_hits if codecs]
    if not hits:
        return []
    votes = dict.fromkeys(READ_AS, 0)
    upto = dict.fromkeys(READ_AS, 0)
    found: dict[tuple[int, str], tuple[int, str, int]] = {}
    for at, codecs in hits:
        for codec in codecs:
            if at >= upto[codec] and (got := _utf8_at(text, at, codec)):
                found[at, codec] = got
                upto[codec] = got[0]
                votes[codec] += 2 * (got[0] - at) - 3 * got[2]
    order = sorted(READ_AS, key=lambda c: -votes[c])
    spans: list[tuple[int, int, str]] = []
    end = 0
    for at, codecs in hits:
        if at < end:
            continue
        for codec in order:
            if codec in codecs and (got := found.get((at, codec)) or _utf8_at(text, at, codec, votes[codec] > 8)):
                spans.append((at, got[0], got[1]))
                end = got[0]
                break
    return spans


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, s in spans:
        out += (text[at:a], s)
        at = b
    out.append(text[at:])
    return "".join(out)


def repair(text: str | None) -> tuple[str | None, int, int]:
    """(restored text, garbled spans, characters lost for good)."""
    if not text or text.isascii():
        return text, 0, 0
    found = 0
    hits: list[Hit] | None = None
    seen = {text}

    def step(finder: Callable, needed: Callable[[Hit], bool]) -> bool:
        nonlocal text, found, hits
        if hits is None:
            hits = matched(text)
        if not any(map(needed, hits)):
            return False
        spans = finder(text, hits)
        if not spans:
            return False
        new = _apply(text, spans)
        if new in seen:
            return False
        found += len(spans)
        text, hits = new, None
        seen.add(new)
        return True

    others = lambda h: bool(h[3])
    while step(_script_spans, others):
        pass
    step(_double_spans, others)
    while step(_reread_spans, others):
        pass
    while step(_spans_utf8, lambda h: bool(h[2])):
        pass
    step(_latin_spans, others)
    if STRAY_QUOTE.search(text):
        spans = _stray_spans(text)
        found, text = found + len(spans), _apply(text, spans)
    return text, found, text.count(LOST)
