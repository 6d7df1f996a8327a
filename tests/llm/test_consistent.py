from itertools import combinations

from vellumdf.llm import consistent, lookalikes
from vellumdf.llm.lookalikes import reading_forms, skeleton, skeletons

SCHEMA = "section_id long, book_id string, chapter_title string, content string, look string, stored string"


def test_same_look_same_form():
    same = ["Chapter one – “The café”", "Ｃｈａｐｔｅｒ one – “The café”", "Сhарtеr оnе – “The café”", "Chap​ter  one\n– “The café” "]
    assert len({skeleton(s) for s in same}) == 1


def test_letters_of_other_scripts():
    for odd, plain in (("օ", "o"), ("Ꭺ", "A"), ("ꓮ", "A"), ("ᴏ", "o"), ("ꓲ", "I"), ("Ⲏ", "H"), ("𝐁", "B")):
        assert skeleton(f"x{odd}x") == f"x{plain}x"
    table = lookalikes.foreign_letters()
    assert len(table) > 120
    # words of Cyrillic and Greek keep their own table, digits and case stay
    assert not any("Ͱ" <= c < "԰" for c in table) and skeleton("0O1lI") == "0O1lI"


def test_real_differences_stay():
    base = "Don’t – stop, Café"
    for other in ("don’t – stop, Café", "Don't – stop, Café", "Don’t - stop, Café", "Don’t – stop, Cafe", "Don’t — stop, Café", "Don’t – stop Café", "Don’t – “stop”, Café"):
        assert skeleton(base) != skeleton(other)


def test_batch_equals_single():
    texts = [None, "", " ", "ﬁn\x00e", "日本語　テキスト", "ﬃ x²", "Κ Ρ α", "á‍ b"]
    assert skeletons(texts) == [skeleton(t) if t is None else skeleton(t.replace("\x00", "�")) for t in texts]
    assert reading_forms([None, "ｆｕｌｌ​ é с"]) == [None, "full é с"]


def test_pairs_match_brute_force(spark):
    rows = [
        (1, "a", "One", "same text", "x", "y"), (2, "a", "Оne", "same text", "x", "y"), (3, "b", "One", "same text", "x", "y"), (4, "b", None, None, None, None),
        (5, "b", "", "​", "x", "y"), (6, "b", "​", "", "x", "y"), (7, "c", "One", "ｓame text", "x", "y"), (7, "c", "One", "ｓame text", "x", "y"), (8, None, "One", None, "x", "y"), (9, None, "Оne", None, "x", "y"),
    ]
    got = {tuple(r) for r in consistent.look_alikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for a, b in combinations(sorted(set(rows), key=str), 2):
        for field, k in (("content", 3), ("chapter_title", 2)):
            if a[k] is not None and b[k] is not None and a[k] != b[k] and skeleton(a[k]) == skeleton(b[k]) and (field == "content" or a[1] is not None and a[1] == b[1]):
                want.add((min(a[0], b[0]), max(a[0], b[0]), field))
    assert got == want
    links = {}
    for a, b, field in want:
        for x in (a, b):
            links[x, field] = links.get((x, field), 0) + 1
    classes = consistent.look_alike_classes(spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA)).collect()
    assert {(r.section_id, r.field_name): r.links for r in classes} == links


def test_a_look_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(consistent, "CHUNK", 3)
    rows = [(i, "a", None, "same text" if i % 3 else "ｓame text", "x", "y") for i in range(40)]
    got = {(r.section_id_a, r.section_id_b) for r in consistent.look_alikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a, b) for a, b in combinations(range(40), 2) if (a % 3 == 0) != (b % 3 == 0)}


def test_empty_table_and_forms(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert consistent.look_alikes(empty).count() == 0
    df = spark.createDataFrame([(1, "a", None, "Ｘ é", "x", "y")], SCHEMA)
    assert tuple(consistent.consistent_sections(df).first()) == (1, "a", None, "X é")
