import pytest

from vellumdf.llm import encoding
from vellumdf.llm.mojibake import LATIN_PAIRS, READ_AS, REREAD, SCRIPTS, automaton, repair, sequences

LATIN = "Später hörte der Müller den Schlüssel, während die Tür „offen“ blieb – für £40."
FRENCH = "Le témoignage du bibliothécaire préférait l’été … où le père rêve après le déjeuner."
RUSSIAN = "Наш самостоятельный учитель рассматривал старый корабельщик и город."
GREEK = "Μέσα στη βροχή ο φύλακας ξέχασε το παλιό ρολόι κοντά στη γέφυρα."
JAPANESE = "その朝、灯台守だけが青い箱を海へ投げた。"


def wrong(text, written, read):
    return text.encode(written).decode(read)


@pytest.mark.parametrize("read", ["latin-1", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15"])
@pytest.mark.parametrize("text", [LATIN, FRENCH, RUSSIAN])
def test_utf8_round_trip(text, read):
    try:
        bad = wrong(text, "utf-8", read)
    except UnicodeDecodeError:
        pytest.skip("not every byte has a character there")
    fixed, spans, lost = repair(bad)
    assert spans and not lost and fixed == text


def test_twice_and_in_places():
    once = wrong("é", "utf-8", "cp1252")
    assert repair(f"Le caf{once} noir")[0] == "Le café noir"
    assert repair(f"Le caf{wrong(once, 'utf-8', 'cp1252')} é noir")[0] == "Le café é noir"


@pytest.mark.parametrize(("text", "written", "read"), [(RUSSIAN, "cp1251", "cp1252"), (RUSSIAN, "cp1251", "mac_roman"), (GREEK, "cp1253", "cp1252"), (JAPANESE, "utf-8", "latin-1")])
def test_other_scripts(text, written, read):
    assert repair(wrong(text, written, read))[0] == text


@pytest.mark.parametrize(("word", "written", "read"), [("Schlüssel", "mac_roman", "cp1252"), ("Müller", "cp1252", "mac_roman"), ("Später", "cp1252", "cp1251"), ("préférait", "cp850", "cp1252")])
def test_one_byte_words(word, written, read):
    assert repair(f"Da war {wrong(word, written, read)} und")[0] == f"Da war {word} und"


@pytest.mark.parametrize(
    "text",
    [LATIN, FRENCH, RUSSIAN, GREEK, JAPANESE, "n.º 12, n° 12, № 7, 5 °C, √28, Lenbe®, £875, ±, ‰, †", "╔═══════╦═════╗\n║ Kabe  ║ 162 ║\n╚═══════╩═════╝", "Тhе саndlе ѕhе ѕаw", "ＴＯТ TАMИB нe кoгда", "¿Él? ¡Sí! «Ça» Œuvre Ålesund Þann niebieską", "so­ft t​he", "", None, "……“后来”", "plain"],
)
def test_correct_text_is_left_alone(text):
    assert repair(text) == (text, 0, 0)


def test_lost_characters_and_table(spark):
    df = spark.createDataFrame([(1, "caf� noir", "k"), (2, "fine é", "k"), (3, None, "k"), (4, "", "k"), (5, "x" * 100_000 + "Ã©", "k")], "doc_id long, text string, key string")
    got = {r.doc_id: (r.garbled_spans, r.lost_chars) for r in encoding.restored(df, "doc_id", "text").collect()}
    assert got == {1: (0, 1), 5: (1, 0)}
    assert encoding.restored(df.limit(0), "doc_id", "text").count() == 0


def test_mixed_correct_text_stays_letter_for_letter():
    french = "Le café était fermé à midi."
    for read in ("cp1252", "latin-1"):
        bad = wrong(RUSSIAN, "cp1251", read)
        assert repair(f"{french} {bad}")[0] == f"{french} {RUSSIAN}"
        assert repair(f"{bad} {french}")[0] == f"{RUSSIAN} {french}"


@pytest.mark.parametrize("times", [2, 3, 5])
def test_damage_any_number_of_times(times):
    bad = good = "Ein Café."
    for _ in range(times):
        bad = wrong(bad, "utf-8", "latin-1")
    assert repair(bad)[0] == good


def test_every_pair_is_in_the_automaton():
    pairs = set().union(*sequences().values())
    assert {p[0] for p in pairs if p[1] == "utf-8"} == set(READ_AS)
    assert set(REREAD) <= pairs and {p for p, _ in SCRIPTS} <= pairs
    # a Latin page whose letters all print as letters of Latin words leaves no sign
    assert len(set(LATIN_PAIRS) & pairs) > len(LATIN_PAIRS) * 0.8
    assert len(automaton()) > 60_000


ARABIC = "كان الحارس القديم ينتظر السفينة في المساء"
HEBREW = "השומר הזקן חיכה לספינה בערב"
THAI = "คนเฝ้าประภาคารรอเรือในตอนเย็น"


@pytest.mark.parametrize(("text", "written"), [(ARABIC, "cp1256"), (ARABIC, "iso8859-6"), (HEBREW, "cp1255"), (THAI, "cp874")])
def test_scripts_without_capitals(text, written):
    assert repair(wrong(text, written, "latin-1"))[0] == text


@pytest.mark.parametrize(("written", "read"), [("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8-r")])
def test_cyrillic_under_another_cyrillic_page(written, read):
    assert repair(wrong(RUSSIAN, written, read))[0] == RUSSIAN
