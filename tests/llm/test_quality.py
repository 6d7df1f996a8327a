import random

from vellumdf.llm import quality
from vellumdf.llm.chains import viterbi
from vellumdf.llm.lines import not_prose

PROSE = "The clerk found the old key behind the door, and they kept it near the lamp. In the end she sold it."
JUNK = {
    "list": "- boat \n- glass Vehul\n- kettle \n- field Dal\n- mirror ",
    "index": "Pelgrix, 297\nNazuorth, 96, 82\nBefenpelr, 115, 246, 70, 184\nZudalkal, 57, 121–395, 338",
    "contents": "1 Namorck tower ........ 8\n2 Dorck glass    24\n3 Nadox chair ............ 28",
    "table": "Orveral | 90.64 | 850.71 | 549.09\nBatack | 391.85 | 153.53 | 392.16\nNadal | 725.96 | 819.77 | 660.70",
    "figures": "36631 67848 99228 5854 57192\n59750 41585 23356 96103\n46271 80262 39245 29732",
    "markup": '<div class="c3"><a href="/cup/47">settlement</a> <br/></div>\n<div class="c3"><a href="/bell/74">mill</a> <br/></div>',
    "symbols": "=_$-_#&+<^ =$%°_-°#@@& *: ^ &§§$ -+<°-*:@~°^#@__ §@-^++ %~>=_#%§$** $=>+*+ : |=~>",
    "letters": "Sxclz fdwgbsr xb flq. Nxhfpxhq krrwsn wtv dnmrpcfz hksnjkvw rptsp. Gzfctpm scknb sr drqlpzkf.",
    "repeated": "He saw the red door again and sat. " * 12,
    "words": "manuscript, merchandise, observation, letter, representation, pencil, island, engine, lighthouse, schoolmaster, negotiation",
}
TEXT = {
    "prose": PROSE,
    "capitals": PROSE.upper(),
    "verse": "The silent tree wanted her lamp\nA proud wall kept that river\nOnce her needle lost the ship",
    "figures in sentences": "In 1760, Veniram counted 9,069 sacks, 46 barrels and 57.42 pounds of nails. In 1712, Vehul counted 812 sacks and 9 barrels.",
    "speech": "“They kept the old barrel behind the bucket!” said Grikar. “Soon he sold the cellar?” she whispered.",
    "ja": "夜になると、灯台守は庭の鍵を忘れてしまった。猫だけがランプを運んでいた。",
    "th": "ตอนกลางคืนหมอประจำหมู่บ้านได้แต่อ่านแผนที่ ชาวประมงได้แต่ซ่อนแผนที่",
    "hi": "रात को पुस्तकपाल चुपचाप नीला बक्सा ले गया। उस सुबह लेखक धीरे से नक्शा ढूँढ रहा था।",
}


def test_kinds():
    texts = [*JUNK.values(), *TEXT.values(), None, "", " "]
    flags = dict(zip([*JUNK, *TEXT, "null", "empty", "blank"], not_prose(texts), strict=True))
    assert [k for k in JUNK if not flags[k]] == []
    assert [k for k in (*TEXT, "null", "empty", "blank") if flags[k]] == []


def test_styled_letters_do_not_matter():
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" < c < "~" and c.isalpha() else c for c in JUNK["repeated"])
    assert list(not_prose([wide, JUNK["list"].replace("a", "a​"), TEXT["prose"].replace("e", "е")])) == [True, True, False]


def test_long_phrases_are_repeated_too():
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    for period in (17, 24, 34, 60, 250):
        phrase = " ".join(rng.choice(words) for _ in range(period)).capitalize() + "."
        half = phrase.split()[: period // 2]
        twice = " ".join(half + half + ["pol", "gar", "min"]) + "."  # a phrase that holds the same words twice
        damaged = " ".join(w if rng.random() > 0.02 else "xoru" for w in ((phrase + " ") * 10).split())
        assert list(not_prose([(phrase + " ") * 10, (phrase + "\n") * 10, (twice + "\n") * 10, damaged])) == [True] * 4, period
        # once and twice is running text, and so is verse with a refrain
        verse = "".join("\n".join(" ".join(rng.choice(words) for _ in range(7)) for _ in range(6)) + f"\n{' '.join(half[:9])}\n\n" for _ in range(5))
        assert list(not_prose([phrase, phrase + " " + phrase, verse])) == [False] * 3, period


def test_statistics(spark):
    rows = [(1, PROSE, 9), (2, JUNK["table"], 9), (3, None, 9), (4, "", 9), (5, "Wort " * 60_000, 9)]
    df = spark.createDataFrame(rows, "block_id long, text string, unit_id long")
    got = {r.unit_id: r for r in quality.statistics(df, "block_id", "text").collect()}
    assert got[1].kind == "prose" and got[1].word_count == 22 and got[1].lines_ending_in_punctuation == 1.0 and got[1].common_word_share > 0.3
    assert got[2].kind == "table" and got[2].line_count == 3
    assert got[3].chars == got[4].chars == 0 and got[3].kind == "prose" and got[3].mean_word_length is None
    assert got[5].chars == 300_000 and got[5].kind == "junk"
    assert [tuple(r) for r in quality.not_running_text(df, "block_id", "text", "block").orderBy("unit_id").collect()] == [("block", 2), ("block", 5)]
    assert quality.statistics(df.limit(0), "block_id", "text").count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 5, 3])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    emit, trans, init = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = viterbi(emit, starts, lengths, trans, init)
    for s, n in zip(starts, lengths, strict=True):
        if n:
            paths = list(product(range(3), repeat=int(n)))
            score = lambda p: init[p[0]] + sum(emit[s + i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert tuple(got[s : s + n]) == max(paths, key=score)
