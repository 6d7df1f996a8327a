import random

from vellumdf.llm import leakage

D, I = "doc_id long, text string, item_id long, key string", "item_id long, text string, task string"


def words(s):
    import re

    return re.findall(r"[^\W_]+", (s or "").lower())


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, u in items:
            v = words(u)
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, least=10):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], D)
    it = spark.createDataFrame([(i, t, "q") for i, t in items], I)
    return leakage.leaked(df, it, least)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(3, 30))) for i in range(20)]
    docs = [(d, text(rng.randrange(0, 120))) for d in range(60)]
    got = run(spark, docs, items, 5).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 5)
    for r in got:
        w, v = words(dict(docs)[r.doc_id]), words(dict(items)[r.item_id])
        assert w[r.doc_word : r.doc_word + r.matched_words] == v[r.item_word : r.item_word + r.matched_words]


def test_disguised_passages(spark):
    item = "She left it behind the Lentrikax and met the Tafensan when it was the Dalfentam that closed"
    docs = [
        (1, f"x. {item.upper()} y"), (2, "> " + item.replace(" ", "\n> ")), (3, item.replace("e", "е").replace("a", "ａ")), (4, item.replace("t", "t​").replace(" ", " ")),
        (5, " ".join(item.split()[:9])), (6, None), (7, ""), (8, item.replace("and met", "but met").replace("it was", "it is")), (9, "“" + item.replace("and", ", and —") + "”"), (9, item),
    ]
    got = sorted((r.doc_id, r.item_id) for r in run(spark, docs, [(1, item), (2, None), (3, "too short"), (1, item)]).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (9, 1)]


def test_letters_above_the_basic_plane(spark):
    item = "She left it behind the Lentrikax and met the Tafensan when it was the Dalfentam that closed"
    bold = "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else chr(0x1D400 + ord(c) - 65) if "A" <= c <= "Z" else c for c in item)
    han = " ".join(chr(0x20000 + i) for i in range(12))
    deseret = " ".join(chr(0x10400 + i) + chr(0x10401) for i in range(12))
    small = " ".join(chr(0x10428 + i) + chr(0x10429) for i in range(12))
    docs = [(1, bold), (2, han), (3, " ".join(chr(0x20100 + i) for i in range(12))), (4, small), (5, " ".join("\U0001f600" for _ in range(12))), (6, item.replace(" ", " \U0001f600 "))]
    got = sorted((r.doc_id, r.item_id) for r in run(spark, docs, [(1, item), (2, han), (3, deseret), (4, "\U0001f680 " * 12)]).collect())
    assert got == [(1, 1), (2, 2), (4, 3), (6, 1)]


def test_clean_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, item), (2, "other")], "doc_id long, text string")
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in leakage.without_leaks(df, it).collect()] == [2]
    assert leakage.leaked(df, it.limit(0)).count() == 0
    assert leakage.leaked(df.limit(0), it).count() == 0


def test_many_items_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(12)) for i in range(30)]
    docs = [(d, text(200) + " " + items[d % 30][1]) for d in range(40)]
    whole = {(r.doc_id, r.item_id, r.matched_words) for r in run(spark, docs, items, 6).collect()}
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 100)
    assert {(r.doc_id, r.item_id, r.matched_words) for r in run(spark, docs, items, 6).collect()} == whole and whole


def test_styled_letters_and_pictographs(spark):
    plain = "one two three four five six seven eight nine ten"
    bold = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in plain)
    assert run(spark, [(1, bold), (2, plain.replace(" ", "😀"))], [(1, plain)]).count() == 2
