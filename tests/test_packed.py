from hypothesis import given, settings
from hypothesis import strategies as st

from cytora.operators import packed


def values(text, **k):
    return [v for _, v, _ in packed.parse(text, **k)]


def test_separators_keep_positions():
    assert packed.parse("a,,b; c|d\te\nf,\ng,") == [(0, "a", None), (1, "", None), (2, "b", None), (3, "c", None), (4, "d", None), (5, "e", None), (6, "f", None), (7, "g", None), (8, "", None)]
    assert values("") == [""]


def test_quotes():
    assert values('"CD3, BV421-A";\'x "S4"-A\' , "the ""double"" gate"') == ["CD3, BV421-A", 'x "S4"-A', 'the "double" gate']
    assert packed.parse('"open, b') == [(0, '"open', "malformed_quote"), (1, "b", None)]
    assert packed.parse('"a" b,c') == [(0, '"a" b', "malformed_quote"), (1, "c", None)]
    assert values("clone \"S4\"-A;b") == ['clone "S4"-A', "b"]


def test_brackets():
    assert values("[a,b];c", brackets=True) == ["[a,b]", "c"]
    assert values("[a,b];c", brackets=False) == ["[a", "b]", "c"]
    assert values("[a,b];c") == ["[a,b]", "c"] and values("CD3 (x,y),z") == ["CD3 (x", "y)", "z"]
    assert packed.parse("(a,b", brackets=True)[0][2] == "malformed_bracket"


def test_entries():
    e = lambda k, t: [v for _, v, _ in packed.parse_entry(k, t)]
    assert e("laserwavelength", "488; 561,640") == ["488", "561", "640"]
    assert e("tr", "CD3,500;CD4,200") == ["CD3", "500", "CD4", "200"] and e("spill", "1;A;1,0") == ["1", "A", "1,0"]
    wide = 101
    text = ";".join([str(wide), *(f"C{i}" for i in range(wide)), *("0,5" for _ in range(wide * wide))])
    assert len(e("spillover", text)) == 1 + wide + wide * wide


def test_decimal_comma():
    m = lambda t: [v for _, v, _ in packed.parse_matrix(t)]
    assert m("2;A;B;1,0;0,05;0,1;1") == ["2", "A", "B", "1,0", "0,05", "0,1", "1"]
    assert m("2,A,B,1,0,0,1") == ["2", "A", "B", "1", "0", "0", "1"]
    assert m("2\tA\tB\t1,0\t0,05") == ["2", "A", "B", "1,0", "0,05"]
    assert m("2,A,B,1,0.5") == ["2", "A", "B", "1", "0.5"]
    assert m("2; A; B; x; 6,3E-02; 0,0E+00; 1") == ["2", "A", "B", "x", "6,3E-02", "0,0E+00", "1"]


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=12), min_size=1, max_size=8), st.sampled_from([",", ";", "|", "\t", ",\n"]))
@settings(max_examples=300, deadline=None)
def test_quoted_round_trip(items, sep):
    text = sep.join('"' + v.replace('"', '""') + '"' for v in items)
    assert values(text) == [v.strip(" \xa0") for v in items]


def test_long_text():
    text = ";".join(["x" * 50] * 20_000)
    assert len(values(text)) == 20_000


def test_table(spark):
    schema = "text_id long, text_map map<string,string>, pos string, item string"
    rows = [(1, {"cells": "a,,b", "other": "x,y"}, "p", "i"), (1, {"cells": "a,,b"}, "p", "i"), (2, None, "p", "i"), (3, {"spill": None, "tr": ""}, "p", "i"), (None, {"cells": "z"}, "p", "i")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, packed.file_list_items(df).collect())) == [(1, "cells", 0, "a"), (1, "cells", 2, "b")]
    assert packed.file_list_items(df.limit(0)).count() == 0
    split = packed.split_column(spark.createDataFrame([(1, "a;'b;c'"), (2, None)], "pos int, v string"), "v")
    assert sorted((r["v"], r["pos"], r["item"]) for r in split.collect()) == [("a;'b;c'", 0, "a"), ("a;'b;c'", 1, "b;c")]
