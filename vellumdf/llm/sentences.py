"""Sentence boundaries in many languages and scripts.

The characters of a text are tagged *boundary* or *inside* by a linear-chain
model.  All characters but the few behind which a sentence can end - stops with
their closing marks, closing quotes, blank lines, and the blanks of scripts
without stops - are *inside* with certainty, so the chain runs over these
candidates only, which is the same best path.  A candidate is described by the
kind of stop, the word before it, closing marks, attribution of speech and what
follows; weights and transitions were learned by an averaged structured
perceptron (``train``) and lie in ``models/sentences.json``.

Text of a script without blanks between words (Chinese, Japanese, Thai, ...) that has
no punctuation at all and is longer than the sentences of the training texts goes to a
second chain over all its characters (``bare``), trained on text whose punctuation
was stripped.

Offsets are 0-based code points, end exclusive, without blanks around; every
visible character lies in exactly one sentence.  Null, empty and blank texts
have no sentences.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from pathlib import Path

import numpy as np

from . import bare
from .chains import viterbi
from .lookalikes import skeleton

MODEL = Path(__file__).parent / "models" / "sentences.json"
#: Texts with a sentence of this length are not taken into the training of text without punctuation.
LONGEST_SENTENCE = 200

# Abbreviations that stand before a name, number or explanation and end no sentence.
LEADING = frozenset(
    "dr mr mrs ms prof st mt rev gen col capt hon hr fr frl mm mme mlle me mgr sra srta dna ing lic no nr nos p pp s vs bzw vgl cf ca approx resp zzgl abs art ex ej ee bd bds fig hg hrsg kap cap chap vol ed eds env pag pags num tel n.o pág págs núm núms tél éd éds "
    "см стр тр ок им проф акад гл рис ул пр кн напр тов κ κα δρ βλ σελ αρ डॉ प्रो श्री सं د أ ص".split()
)
# Abbreviations that may end a sentence.
TRAILING = frozenset("etc co inc ltd corp bros usw ff uu jun sen u.a u.s u.s.a km kg cm mm. др пр. гг вв км кг χλμ κλπ كم".split())
CLOCK = frozenset(("p.m", "a.m", "a.c", "d.c", "b.c", "т.п", "т.д", "μ.μ", "π.μ", "ad"))
# Words before a German ordinal number.
ARTICLES = frozenset("der die das den dem des am im vom zum zur beim bis seit ab jeder jedem jeden ihr sein".split())
# Verbs of saying.
SAY = (
    "said|asked|replied|cried|whispered|answered|shouted|murmured|wrote|added|exclaimed|called|muttered|remarked|sighed|"
    "sagte|fragte|rief|flüsterte|antwortete|meinte|murmelte|schrieb|erwiderte|entgegnete|"
    "dit|demanda|cria|murmura|répondit|écrivit|ajouta|dijo|preguntó|gritó|respondió|susurró|murmuró|exclamó|escribió|"
    "сказал|сказала|спросил|спросила|крикнул|крикнула|ответил|ответила|шепнул|шепнула|прошептал|прошептала|написал|написала|είπε|ρώτησε|φώναξε|απάντησε|ψιθύρισε"
)
#: Characters that print nothing.
HIDDEN = "\u200b-\u200f\u2060-\u2064\ufeff\xad"
UNSEEN = re.compile(f"[{HIDDEN}]+")
#: A word, also with marks of its own behind its letters, and what ends an attribution behind its verb.
WORD = re.compile(rf"\s*([^\W\d_][\w’'\u0300-\u036f{HIDDEN}-]*)")
BETWEEN = re.compile(r"\.?\s+")
CLOSED = re.compile(r"\s*[.,:;]")
# Small words inside names.
PARTICLES = frozenset("von vom van der den de del de’ la le las los da das do dos di du des af av zu zum zur y e of the el al bin ibn".split())
#: The rest of a clause of a script without blanks.
CLAUSE = re.compile(r"[^。！？…，、\s]*.?", re.S)
SPOKEN_CJK = re.compile("(?:と|って)|[^。！？…，、\\s]{0,8}(?:(?<!小)[说說]|问|問|喊|叫|答|道|言っ|聞い|尋ね|叫ん|答え)|[^。！？…，、\\s]*(?:(?<!小)[说說]|问|問|喊|叫|答|(?<!知)道|(?:言っ|聞い|尋ね|叫ん|答え)[てただ]*)[。！？…，、]|(?:이?라고|하고|고) ")

STOPS = ".!?…。！？．｡।॥؟\u037e"
ALWAYS_CLOSE = frozenset("”’」』)]】》〉›\u2019")
MAYBE_CLOSE = frozenset("“\"«»'‘")
CLOSED_QUOTE = frozenset("”’」』》“\"«»'‘›")
OPENERS = frozenset("“\"„«»‚‘'(「『《[¿¡—–-")
FULL_STOPS = frozenset("。！？．｡।॥؟")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")

CANDIDATE = re.compile("[.!?…。！？．｡।॥؟]+|[」』]|\n[^\\S\n]*\n\\s*|(?<=[^\\W\\d_])[»«”“\"](?=\\s+[„“«»\"])")
CANDIDATE_GREEK = re.compile("[.!?…;\u037e]+|\n[^\\S\n]*\n\\s*|(?<=[^\\W\\d_])[»«”“\"](?=\\s+[„“«»\"])")
BLANKS = re.compile(r"\s+")
TOKEN = re.compile(r"[^\s“”\"„»«(‘'—–\[]*$")
OF = re.compile(r"\s+OF\s")
THAI = re.compile("[\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f]")
GREEK = re.compile("[\u0386-\u03ce]")


def _token(text: str, end: int) -> tuple[str, int]:
    """Word that ends at ``end`` in plain small letters, and its start."""
    room = 24
    while True:
        lo = max(0, end - room)
        m = TOKEN.search(text, lo, end)
        if m.start() > lo or not lo:
            break
        room *= 4  # a longer word
    w = m.group()
    return (w if w.isascii() else skeleton(w)), m.start()


def _solid_end(text: str, at: int) -> int:
    """Where the text before ``at`` ends without its blanks."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def learn_abbreviations(texts: list[str], least: int = 3, share: float = 0.2) -> list[str]:
    """Words of several letters whose point is followed by a small letter ``least`` times and in a ``share`` of all its places: abbreviations, whether they are listed or not."""
    seen: dict[str, int] = {}
    small: dict[str, int] = {}
    for t in texts:
        for m in re.finditer(r"\.(?=\s)", t):
            w = _token(t, m.start())[0].lower()
            follow, _ = _following(t, m.end())
            if len(w) > 1 and w.replace(".", "").isalpha() and follow != "E":
                seen[w] = seen.get(w, 0) + 1
                small[w] = small.get(w, 0) + (follow in "Ll")
    return sorted(w for w, n in small.items() if n >= least and n >= share * seen[w])


@functools.cache
def _learned() -> frozenset[str]:
    return frozenset(json.loads(MODEL.read_text()).get("abbreviations", ()))


@functools.cache
def _plain(words: frozenset[str]) -> frozenset[str]:
    return words | frozenset(map(skeleton, words))


def _word_class(text: str, end: int, following: str) -> str:
    """What the word before a single point is."""
    raw, start = _token(text, end)
    w = raw.lower().rpartition("’")[2].rpartition("'")[2]
    if not w:
        return "none"
    if w.isdigit():
        if len(w) <= 2 and following in "UL" and _token(text, _solid_end(text, start))[0].lower() in ARTICLES:
            return "ordinal"
        return "number"
    cut = w.rstrip(".")
    if len(w) == 1 and w.isalpha():
        before, at = _token(text, _solid_end(text, start))
        if before.endswith(".") and before[:-1].lower() + "." + w in CLOCK:
            return "trailing"
        if w in ("г", "r") and before[:1].isdigit():
            return "trailing"
        return "initial"
    if cut in CLOCK:
        return "trailing"
    if cut in ("sr", "jr"):
        before, _ = _token(text, _solid_end(text, start))
        if following == "U" and OF.match(text, end + 1):
            return "leading"  # capitals throughout
        return "trailing" if before[:1].isupper() and not before.endswith(".") and before.lower() not in ("el", "al", "del", "un") else "leading"
    if cut in _plain(LEADING):
        return "leading"
    if cut in _plain(TRAILING):
        return "trailing"
    if cut in _learned():
        return "leading"
    if "." in cut[1:] or cut.endswith(("-à-d", "-à-d")):
        return "leading"
    if len(cut) > 1 and "-" in cut and all(len(x) <= 1 for x in cut.replace(".", "").split("-")):
        return "initial"
    return "word"


def _following(text: str, at: int) -> tuple[str, int]:
    """Kind of what follows: E end, U capital, L small letter, D figure, O opening mark, W letter without case, d/D dash before small or capital, P other."""
    n = len(text)
    k = at
    while k < n and (text[k].isspace() or text[k] in "\u200b\u200c\u200d\u2060\ufeff\xad"):
        k += 1
    if k >= n:
        return "E", k
    c = text[k]
    if c.isdigit():
        return "D", k
    if c.isalpha():
        return ("L" if c.islower() else "U" if c.isupper() else "W"), k
    if c in "—–-":
        k2 = k + 1
        while k2 < n and text[k2].isspace():
            k2 += 1
        return ("l" if text[k2 : k2 + 1].islower() else "u"), k
    if c in OPENERS:
        return "O", k
    return "P", k


Bundle = tuple[str, str, str, str, str]


def candidates(text: str) -> tuple[list[int], list[Bundle]]:
    """Positions behind which a sentence may end, in order, each with its description."""
    ends: list[int] = []
    what: list[Bundle] = []
    ascii_only = text.isascii()
    if not ascii_only:
        thai = len(THAI.findall(text)) if THAI.search(text) else 0
        if thai and thai * 2 > sum(map(str.isalpha, text)):
            for m in BLANKS.finditer(text):
                if 0 < m.start() and m.end() < len(text):
                    ends.append(m.start())
                    what.append(("blank", "-", "-", "-", "-"))
            return ends, what
    greek = not ascii_only and GREEK.search(text) is not None and len(GREEK.findall(text)) * 3 > len(text)
    n = len(text)
    last = 0
    for m in (CANDIDATE_GREEK if greek else CANDIDATE).finditer(text):
        s, e = m.span()
        if s < last:
            continue
        c = text[s]
        if c == "\n":
            ends.append(s)
            what.append(("paragraph", "-", "-", "-", "-"))
            last = e
            continue
        quote = False
        if c in "」』»«”“\"":
            kind = "close"
            quote = True
        else:
            run = text[s:e]
            kind = "full" if c in FULL_STOPS or run[-1] in FULL_STOPS else "dots" if "…" in run or ".." in run else "dot" if run == "." else "mark"
        # closing marks
        while e < n:
            q = text[e]
            if q in ALWAYS_CLOSE:
                quote |= q in CLOSED_QUOTE
                e += 1
            elif q in MAYBE_CLOSE and (e + 1 >= n or not text[e + 1].isalnum() and text[e + 1] not in "¿¡"):
                quote = True
                e += 1
            elif q.isspace() and e + 1 < n and text[e + 1] in "»!?" and (e + 2 >= n or not text[e + 2].isalnum() and text[e + 2] not in "„“«"):
                quote |= text[e + 1] == "»"
                e += 2
            else:
                break
        last = e
        if e >= n:
            continue
        nx = text[e]
        gap = nx.isspace()
        follow, k = _following(text, e)
        if follow == "E":
            continue
        if not gap and not quote and kind in ("dot", "dots", "mark") and follow in "LDP":
            if kind == "dot" or follow != "D":
                continue
        if kind == "dot" and not gap and not quote and follow != "W":
            continue
        speech = "-"
        if quote:
            if follow in "UW" and (not WIDE.match(text, k) and _attributed(text, k) or SPOKEN_CJK.match(UNSEEN.sub("", CLAUSE.match(text, k).group()))):
                speech = "said"
            speech = speech if speech != "-" else "quote"
        word = _word_class(text, s, follow) if kind == "dot" and not quote else "-"
        ends.append(e)
        what.append((kind, follow, word, speech, "gap" if gap else "tight"))
    return ends, what


@functools.cache
def _saying() -> frozenset[str]:
    return _plain(frozenset(SAY.split("|")))


def _attributed(text: str, at: int) -> bool:
    """One or two words, or a name of any number of words, with a verb of saying and its mark behind them."""
    words, name = 0, True
    while m := WORD.match(text, at):
        w = m.group(1)
        small = w.lower()
        if words and (small in _saying() or not w.isascii() and not _saying().isdisjoint((skeleton(small), skeleton(w).lower()))) and CLOSED.match(text, m.end()):
            return True
        words += 1
        name &= small in PARTICLES or w[:1].isupper() and (len(w) == 1 or not w.isupper())
        gap = BETWEEN.match(text, m.end())
        if gap is None or words > 2 and not name:
            return False
        at = gap.end()
    return False


#: Shapes of speech that a sample may lack, taken into the training as they are.
SHAPES = (
    "“Stop!” Grikar replied. He ran. “Who is it?” Dal asked. It rained. “Late,” she said. “Yes.” They left.",
    "»Halt!« Er rief den Hund. Er lief. »Halt!« Marta sagte nichts. «¡Alto!» Kazur gritó. «Alto.» Se fue.",
    "「行く？」猫は寝た。「行く」と言った。「行く。」雨が降った。“走吗？”守塔人说。“走。”他走了。",
    "В 1847 г. Тот ушёл. Г. Бель пришёл. EE. UU. y Dal. El Sr. Dal vio. A. C. Dal, p. ex. Dal, vino. Fin.",
)


# -- model -----------------------------------------------------------------
def features(b: Bundle) -> tuple[str, ...]:
    kind, follow, word, speech, gap = b
    return (f"k={kind}", f"k={kind}|f={follow}", f"w={word}|f={follow}", f"w={word}", f"s={speech}|f={follow}", f"s={speech}|k={kind}", f"g={gap}|k={kind}|f={follow}")


def weak_labels(what: list[Bundle]) -> list[int]:
    """Boundary (1) or not (0) by plain rules: the training labels, never used for results."""
    out = []
    for kind, follow, word, speech, gap in what:
        if kind in ("blank", "paragraph"):
            y = 1
        elif speech == "said" or follow in "Ll" or follow == "P" and gap == "tight":
            y = 0
        elif kind == "close":
            y = int(follow in "OUW" and speech != "said")
        elif kind == "dot" and word in ("leading", "initial", "ordinal"):
            y = 0
        else:
            y = 1
        out.append(y)
    return out


def train(texts: list[str], epochs: int = 4, seed: int = 5) -> dict:
    """Averaged structured perceptron over candidate chains.

    Texts of scripts without stops are taken without any punctuation: their blanks are the labelled boundaries.
    """
    chains = []
    for t in [*texts, *SHAPES * max(1, len(texts) // 50)]:
        if len(THAI.findall(t)) * 2 > len(t):
            t = re.sub(r"[^\w\s\u0e00-\u0e7f]", "", t)
        _, what = candidates(t)
        if what:
            chains.append(([features(b) for b in what], weak_labels(what)))
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    trans, trans_total = np.zeros((2, 2)), np.zeros((2, 2))
    rng = np.random.default_rng(seed)
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(len(chains)):
            feats, gold = chains[i]
            emit = np.zeros((len(gold), 2))
            emit[:, 1] = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
            emit[np.arange(len(gold)), 1 - np.array(gold)] += 2.0  # a margin: the wrong tag gets a head start
            got = viterbi(emit, np.array([0]), np.array([len(gold)]), trans, np.zeros(2))
            for k, (y, z) in enumerate(zip(gold, got, strict=True)):
                if y != z:
                    for f in feats[k]:
                        w[f] = w.get(f, 0.0) + (y - z)
                if k and (gold[k - 1], y) != (got[k - 1], z):
                    trans[gold[k - 1], y] += 0.1
                    trans[got[k - 1], z] -= 0.1
            steps += 1
            if steps % 50 == 0:
                for f, v in w.items():
                    total[f] = total.get(f, 0.0) + v
                trans_total += trans
    n = max(1, steps // 50)
    return {"abbreviations": learn_abbreviations(texts), "weights": {f: round(v / n, 4) for f, v in sorted(total.items()) if v}, "trans": (trans_total / n).round(4).tolist(), "texts": len(chains)}


def train_bare(texts: list[str]) -> dict:
    """Model of text without punctuation: every fifth text is held out and gives the F1 of its script."""
    out: dict = {"bare": {}}
    for script in bare.SCRIPTS:
        # a text with a sentence of a page has no stops to learn from
        own = [(t, found) for t in texts if bare.script_of(t) == script and len(found := _cut(t, _punctuated(t))) > 1 and max(b - a for a, b in found) < LONGEST_SENTENCE]
        chains = [bare.strip(t, found) for t, found in own]
        if len(chains) < 20:
            continue
        model = bare.train([c for i, c in enumerate(chains) if i % 5])
        held = bare.f1(model, chains[::5])
        longest = max(b - a for _, found in own for a, b in found)
        used = np.flatnonzero(model[0])
        out["bare"][script] = {"at": used.tolist(), "weights": model[0][used].tolist(), "trans": model[1].tolist(), "longest": int(longest), "held_out_f1": round(held, 4), "texts": len(chains)}
    return out


@functools.cache
def _bare_model() -> dict[str, tuple[tuple[np.ndarray, np.ndarray], int]]:
    out = {}
    for script, m in json.loads(MODEL.read_text()).get("bare", {}).items():
        weights = np.zeros(1 << bare.BITS)
        weights[m["at"]] = m["weights"]
        out[script] = (weights, np.array(m["trans"])), m["longest"]
    return out


def _bare_ends(text: str) -> list[int] | None:
    """Ends of the sentences of an unpunctuated text longer than any sentence of its script in training; None for other texts.

    Blanks and line breaks inside part nothing there and are left out of the chain.
    """
    if text.isascii() or not (WIDE.search(text) or THAI.search(text)):
        return None
    at = np.array([i for i, c in enumerate(text) if not c.isspace()], np.int64)
    core = BLANKS.sub("", text)
    if not bare.is_bare(core) or (script := bare.script_of(core)) not in _bare_model():
        return None
    model, longest = _bare_model()[script]
    return at[np.flatnonzero(bare.decode(model, core))].tolist() if len(core) > longest else None


def _unpunctuated(text: str, ends: list[int], what: list[Bundle]) -> list[int]:
    """Ends of the sentences inside the paragraphs without any stop."""
    if text.isascii() or ends and not WIDE.search(text):
        return []
    stops = [e for e, b in zip(ends, what, strict=True) if b[0] != "paragraph"]
    out = []
    a = 0
    for b in [*(e for e, w in zip(ends, what, strict=True) if w[0] == "paragraph"), len(text)]:
        if bisect.bisect_right(stops, a) == bisect.bisect_right(stops, b):
            out += [a + e for e in _bare_ends(text[a:b]) or []]
        a = b
    return out


@functools.cache
def _model() -> tuple[dict[str, float], np.ndarray]:
    m = json.loads(MODEL.read_text())
    return m["weights"], np.array(m["trans"])


@functools.cache
def _score(b: Bundle) -> float:
    w = _model()[0]
    return sum(w.get(f, 0.0) for f in features(b))


def _punctuated(text: str) -> list[int]:
    return boundaries([text])[0]


def boundaries(texts: list[str | None]) -> list[list[int]]:
    """Ends of all sentences but the last of each text."""
    found = [candidates(t) if t else ([], []) for t in texts]
    lengths = np.array([len(w) for _, w in found], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    emit = np.zeros((int(lengths.sum()), 2))
    emit[:, 1] = [_score(b) for _, what in found for b in what]
    tags = viterbi(emit, starts, lengths, _model()[1], np.zeros(2))
    out = [[e for e, y in zip(ends, tags[a : a + n], strict=True) if y] for (ends, _), a, n in zip(found, starts, lengths, strict=True)]
    for i, (t, (ends, what)) in enumerate(zip(texts, found, strict=True)):
        if t and (own := _unpunctuated(t, ends, what)):
            out[i] = sorted({*out[i], *own})
    return out


def _cut(t: str | None, cuts: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the sentences between the cuts, without blanks around."""
    own = []
    a = 0
    for e in [*cuts, len(t or "")]:
        part = t[a:e] if t else ""
        left = len(part) - len(part.lstrip())
        right = len(part.rstrip())
        if right > left:
            own.append((a + left, a + right))
        a = e
    return own


def spans(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """(start, end) of every sentence of each text."""
    return [_cut(t, cuts) for t, cuts in zip(texts, boundaries(texts), strict=True)]
