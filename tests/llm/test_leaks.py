import random

import pytest

from cytora.llm import leaks

VOCAB = [f"w{i}" for i in range(3000)]


def words(seed, n):
    return random.Random(seed).sample(VOCAB, n)


ITEM = " ".join(words(1, 60))
OTHER = " ".join(words(2, 50))


def around(passage, seed=9):
    return " ".join(words(seed, 40)) + ". " + passage + ". " + " ".join(words(seed + 1, 40))


def alter(text, at):
    w = text.split()
    for i in at:
        w[i] = "zzz"
    return " ".join(w)


def find(text, items=((1, ITEM), (2, OTHER))):
    return {i: (n, s, e) for i, n, s, e in leaks.ItemIndex(list(items)).find(text)}


def part(a, n, text=ITEM):
    return " ".join(text.split()[a : a + n])


@pytest.mark.parametrize("a,n,leak", [(0, 60, True), (20, 15, True), (45, 15, True), (0, 15, True), (20, 12, False), (5, 8, False)])
def test_length(a, n, leak):
    assert (1 in find(around(part(a, n)))) == leak


def test_edits():
    p = part(10, 20)
    assert 1 in find(around(alter(p, [6, 13])))
    w = p.split()
    assert 1 in find(around(" ".join(w[:5] + w[6:12] + ["extra"] + w[12:])))
    assert 1 not in find(around(alter(p, range(0, 20, 3))))
    assert 1 not in find(around(" ".join(sorted(w))))
    # fifteen words with two edits in the worst places
    for i in range(1, 14):
        for j in range(i + 1, 14):
            assert 1 in find(around(alter(part(10, 15), [i, j]))), (i, j)


def test_both_items():
    assert set(find(around(part(0, 30)) + " " + part(5, 25, OTHER))) == {1, 2}


WRITTEN = "Quelle café naïve weiß signal laser drifts over night because cold water runs below valve number seven today again"
VARIANTS = [
    WRITTEN.upper(),
    WRITTEN.replace(" ", "\n* "),
    WRITTEN.replace(" ", "&nbsp;"),
    "<p>" + WRITTEN.replace("laser", "<b>la</b>ser").replace(" over ", "<br>over<br/>") + "</p>",
    WRITTEN.replace("e", "е").replace("o", "о"),  # Cyrillic look-alikes
    WRITTEN.replace("signal", "sig­nal").replace("night", "ni​ght"),
    WRITTEN.encode("utf-8").decode("latin-1"),
    WRITTEN.replace("é", "&eacute;").replace("ï", "&#239;"),
    WRITTEN.replace(" ", ", "),
    "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in WRITTEN),
]


@pytest.mark.parametrize("text", VARIANTS)
def test_writing(text):
    got = find("before " + text + " after", [(7, WRITTEN)])
    assert 7 in got
    n, s, e = got[7]
    assert n >= 15 and ("before " + text)[s:e]


@pytest.mark.parametrize("text", [*VARIANTS, "a < b and c > d", "&amp;&lt;&unknown; x", "", "<<<>>>", "—"])
def test_places_match_words(text):
    assert len(leaks.word_places(text)) == len(leaks.normalise(text).split())


def test_offsets_map_to_the_original():
    text = "x y z <i>" + part(3, 20).replace(" ", " &amp; ") + "</i> tail"
    n, s, e = find(text)[1]
    assert leaks.normalise(text[s:e]).split() == part(3, 20).split()


def test_table(spark):
    docs = spark.createDataFrame([(1, around(part(0, 40)), "x"), (2, around(part(0, 40)), "x"), (3, None, "x"), (4, "", "x"), (None, ITEM, "x"), (5, "long " * 200_000, "x"), (1, around(part(0, 40)), "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "s", ITEM), (2, "s", OTHER), (3, "s", ITEM), (4, "s", None), (5, "s", "short text"), (None, "s", ITEM)], "item_id long, suite string, item_text string")
    assert sorted(map(tuple, leaks.leaked(docs, items).collect())) == [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert leaks.leaked(docs.limit(0), items).count() == 0
    assert leaks.leaked(docs, items.limit(0)).count() == 0


def test_many_items_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MAX_ITEMS", 1)
    docs = spark.createDataFrame([(1, around(part(0, 40)) + part(0, 30, OTHER))], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, item_text string")
    assert sorted(map(tuple, leaks.leaked(docs, items).collect())) == [(1, 1), (1, 2)]
