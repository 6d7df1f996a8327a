import pytest

from vellumdf.llm import bare, sentence_units, sentences
from vellumdf.llm.sentences import spans

CASES = {
    "en": ["Dr. Lonand met J. R. Bell at 5 p.m. He left the key, e.g. a spare one.", "Dr. Lonand met J. R. Bell at 5 p.m.", "He left the key, e.g. a spare one."],
    "speech": ["“Where is it?” she whispered. “Here.” They went on.", "“Where is it?” she whispered.", "“Here.”", "They went on."],
    "name first": ["“Stop!” Grikar replied. He ran.", "“Stop!” Grikar replied.", "He ran."],
    "de": ["Am 3. Mai kam Nr. 12, ca. 4,5 km, an. »Komm!«, rief er. Es ging.", "Am 3. Mai kam Nr. 12, ca. 4,5 km, an.", "»Komm!«, rief er.", "Es ging."],
    "fr": ["« Le mur ! » dit Nalon. Il partit… Puis il revint.", "« Le mur ! » dit Nalon.", "Il partit…", "Puis il revint."],
    "ja": ["「行く？」と彼女は言った。猫は寝た……。雨。", "「行く？」と彼女は言った。", "猫は寝た……。", "雨。"],
    "zh": ["“走吗？”她说。他走了……“好。”", "“走吗？”她说。", "他走了……", "“好。”"],
    "th": ["คนเฝ้า ประภาคาร ลืม", "คนเฝ้า", "ประภาคาร", "ลืม"],
    "el": ["Πού είναι το ρολόι; Ο κ. Βελμόρης έφυγε.", "Πού είναι το ρολόι;", "Ο κ. Βελμόρης έφυγε."],
    "ru": ["Проф. Негримив ушёл, и т. п. Он спал.", "Проф. Негримив ушёл, и т. п.", "Он спал."],
    "verse": ["The tree stood\nA wall fell\nThe end.", "The tree stood\nA wall fell\nThe end."],
    "dots": ["He saw a wall … it was red. Fine", "He saw a wall … it was red.", "Fine"],
}


@pytest.mark.parametrize("name", CASES)
def test_sentences(name):
    text, *want = CASES[name]
    assert [text[a:b] for a, b in spans([text])[0]] == want


def test_every_visible_character_once():
    texts = [c[0] for c in CASES.values()] + ["", None, " \n ", "  one. two  ", "x" * 50_000, "Wort. " * 3000]
    for t, own in zip(texts, spans(texts), strict=True):
        t = t or ""
        covered = [i for a, b in own for i in range(a, b)]
        assert len(covered) == len(set(covered))
        assert {i for i, c in enumerate(t) if not c.isspace()} <= set(covered)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in own)


def test_units(spark):
    df = spark.createDataFrame([(1, "One here. Two there.", "k"), (2, None, "k"), (3, "", "k"), (4, "- a \n- b \n- c \n- d ", "k"), (1, "One here. Two there.", "k")], "block_id long, text string, key string")
    got = sorted(map(tuple, sentence_units.sentence_spans(df, "block_id", "text").collect()))
    assert got == [(1, 0, 9), (1, 0, 9), (1, 10, 20), (1, 10, 20)]
    full = sentence_units.sentence_texts(df, "block_id", "text").where("block_id = 1").collect()
    assert {r.sentence for r in full} == {"One here.", "Two there."}
    assert sentence_units.sentence_spans(df.limit(0), "block_id", "text").count() == 0


def test_text_without_punctuation():
    own = "その朝灯台守だけが青い箱を海へ投げた 三日後彼女は青い箱を海へ投げた 古い船も石の橋を見つけた 昨日若い写字生だけが時計を運んでいた 夜になると小さな店は庭の鍵を運んでいた".split()
    t = "".join(own)
    got = [t[a:b] for a, b in spans([t])[0]]
    assert got == own
    assert spans([own[0]])[0] == [(0, len(own[0]))]  # no longer than a sentence
    thai = "เช้านั้นคนเฝ้าประภาคารค่อยๆซ่อนแผนที่ ในสายฝนหมอประจำหมู่บ้านก็ลืมกุญแจสวน สามวันต่อมาคนเฝ้าประภาคารก็อ่านแผนที่".split()
    assert len(spans(["".join(thai)])[0]) == 3


def test_stripping_keeps_where_sentences_begin():
    t = "甲乙。丙丁，戊！己"
    text, gold = bare.strip(t, spans([t])[0])
    assert text == "甲乙丙丁戊己" and gold.tolist() == [0, 0, 1, 0, 0, 1]


def test_bare_model_learns_held_out_boundaries():
    import random

    rng = random.Random(1)
    clause = lambda: rng.choice(["その朝", "昨日", "夜"]) + "".join(rng.choices("山川海空店鍵船", k=rng.randrange(2, 6))) + rng.choice(["見た", "捨てた"])
    texts = ["。".join(clause() for _ in range(rng.randrange(2, 7))) + "。" for _ in range(150)]
    chains = [bare.strip(t, spans([t])[0]) for t in texts]
    assert bare.f1(bare.train(chains[:120]), chains[120:]) > 0.9


def test_words_and_names_of_any_length():
    word = "Donau" + "dampfschiff" * 9
    assert spans([f"Der {word}. Er kam."])[0] == [(0, len(word) + 5), (len(word) + 6, len(word) + 13)]
    name = "Lo" + "tanendri" * 12
    t = f"“Late!” {name} said. They left."
    assert [t[a:b] for a, b in spans([t])[0]] == [f"“Late!” {name} said.", "They left."]


def test_abbreviations_are_learned_from_what_follows(monkeypatch):
    texts = ["Er kam mit Hptm. von Bell an."] * 3 + ["Sie lief. Er kam. Hptm. Bell blieb."]
    assert sentences.learn_abbreviations(texts) == ["hptm"]
    t = "Da stand Hptm. Bell am Tor. Er schwieg."
    assert len(spans([t])[0]) == 3
    monkeypatch.setattr(sentences, "_learned", lambda: frozenset(["hptm"]))
    assert [t[a:b] for a, b in spans([t])[0]] == ["Da stand Hptm. Bell am Tor.", "Er schwieg."]


def cut(t):
    return [t[a:b] for a, b in spans([t])[0]]


@pytest.mark.parametrize("word", ["pág", "pág", "Págs", "núm", "tél"])
def test_abbreviations_with_accents_stand_before_figures(word):
    assert cut(f"Navilond (véase {word}. 14) cruzó el palacio. Se fue.") == [f"Navilond (véase {word}. 14) cruzó el palacio.", "Se fue."]


def test_closing_mark_behind_a_line_break():
    assert cut("« Puis il vit\nle loup ?\n» cria-t-elle. « Non !\n» Il partit.") == ["« Puis il vit\nle loup ?\n» cria-t-elle.", "« Non !\n»", "Il partit."]
    assert cut("Er ging.\n»Komm!« Sie lief.") == ["Er ging.", "»Komm!«", "Sie lief."]


def test_attributions_of_any_length_and_with_invisible_characters():
    for said in ("Gri\xadkar re\u200bplied", "Maria von der Leyen said", "Dr. J. R. Bell Stone of the Hill said", "Kazur gritó"):
        assert cut(f"“Stop!” {said}. He ran.") == [f"“Stop!” {said}.", "He ran."]
    assert cut("“Stop!” He ran home, and Marta said. “Yes.”")[0] == "“Stop!”"
    assert cut("“STOP!” THE DOG RAN AND MARTA SAID. NO.")[0] == "“STOP!”"
    assert cut("«СТОЙ!» КАМИР СКАЗАЛ. ОН УШЁЛ.") == ["«СТОЙ!» КАМИР СКАЗАЛ.", "ОН УШЁЛ."]
    assert cut("“走吗？”她\xad说。雨。") == ["“走吗？”她\xad说。", "雨。"]
    name = "守塔人的年轻的抄写员的弟弟"
    assert cut(f"“走吗？”{name}说。雨。") == [f"“走吗？”{name}说。", "雨。"]
    assert cut("“走吗？”守塔人在雨里读完了一本小说。雨。") == ["“走吗？”", "守塔人在雨里读完了一本小说。", "雨。"]


def test_junior_in_capitals():
    assert cut("SASTOS JR. OF NO. 7 RAN. HE FELL.") == ["SASTOS JR. OF NO. 7 RAN.", "HE FELL."]


def test_paragraphs_without_punctuation():
    own = "その朝灯台守だけが青い箱を海へ投げた 三日後彼女は青い箱を海へ投げた 古い船も石の橋を見つけた 昨日若い写字生だけが時計を運んでいた 夜になると小さな店は庭の鍵を運んでいた".split()
    bare_text = "".join(own)
    assert cut(f"{bare_text}\n\n{bare_text}") == own * 2
    assert cut(f"猫は寝た。雨。\n\n{bare_text}") == ["猫は寝た。", "雨。", *own]
    wrapped = bare_text[:30] + "\n" + bare_text[30:]
    assert [s.replace("\n", "") for s in cut(wrapped)] == own


def test_sentences_of_all_sections(spark, tmp_path):
    from vellumdf.llm.queries import p5_sentences

    rows = [(1, "One here. Two there."), (2, "- a \n- b \n- c \n- d "), (3, "== ++ == ++ == ++ =="), (4, None), (5, " ")]
    spark.createDataFrame(rows, "section_id long, content string").write.parquet(f"{tmp_path}/book_sections.parquet")
    got = p5_sentences(spark, str(tmp_path)).collect()
    for key, text in rows:
        covered = [i for r in got if r.section_id == key for i in range(r.sent_start, r.sent_end)]
        assert len(covered) == len(set(covered))
        assert {i for i, c in enumerate(text or "") if not c.isspace()} <= set(covered)


def test_prose_whose_commas_fall_into_one_wrapped_line(spark):
    prose = [
        "Le n° 12, à env. 3,5 km, tandis que le tiroir que l’on\nporta sous le champ chercha le rêve.",
        "Por la noche el pozo vio el clavo suave, y Mortribel, p. ej. el menor,\r\neste techo bajo el tambor vio un tambor.",
        "A Viorkam, e.g. a spare one, so by noon he hid the kind road, when\nthis quiet barrel surrendered the boy on the nephew.",
    ]
    lists = ["Hof, Eimer, Schlüssel, Eimer, Turm,\nKessel, Wagen, Brief, Zaun, Bach,\nkessel, wagen, brief, zaun", "- kettle \n- neighborhood \n- afternoon \n- widow \n- box"]
    df = spark.createDataFrame(list(enumerate(prose + lists)), "block_id long, text string")
    got = sorted(map(tuple, sentence_units.sentence_spans(df, "block_id", "text").collect()))
    assert got == [(i, 0, len(t)) for i, t in enumerate(prose)]
