import unicodedata

import pytest

from ripplegraph.llm.lookalike import consistent_form, composing, lookalike_classes, lookalike_pairs, tables

SAME = [
    ("Straße 12, naïve?", "Ｓｔｒａße　１２， naïve？"), ("café", "café"), ("cafe͏́", "café"), ("copy", "сору"), ("HELP", "НЕLР"), ("հօոս", "honu"), ("a b", "a b"), ("a b", "a b"),
    ("file", "ﬁle"), ("office", "oﬃce"), ("VIII", "Ⅷ"), ("mix", "ⅿiⅹ"), ("x;", "x;"), ("K", "K"), ("zero", "ze​ro"), ("zero", "z­e﻿ro"), ("ガ", "ｶﾞ"), ("한글", unicodedata.normalize("NFD", "한글")),
    ("不", "不"), ("Düsseldorf", "Düsseldorf"), ("ë", "ё"), ("⚠️", "⚠"), ("a\r\nb", "a\nb"), ("1/2", "1⁄2"), ("𝐀bc", "Abc"), ("a‐b", "a-b"),
    ("vowel", "νοwеl"), ("LISU", "ꓡꓲꓢꓴ"), ("party", "ρаrtγ"),
]
DIFFER = [("a", "A"), ("e", "é"), ("e", "ë"), ("x2", "x²"), ("a.", "a!"), ("a b", "ab"), ("👩‍💻", "👩💻"), ("ひ", "び"), ("i", "ı"), ("½", "1/2"), ("①", "1"), ("и", "й"), ("a\nb", "a b"), ("f", "ſ")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.form for r in consistent_form(df).collect()}


def test_forms(spark):
    texts = [t for p in SAME + DIFFER for t in p]
    f = forms(spark, texts)
    for i, (a, b) in enumerate(SAME + DIFFER):
        assert (f[2 * i] == f[2 * i + 1]) == ((a, b) in SAME), (a, b, f[2 * i], f[2 * i + 1])


def test_form_is_stable_and_keeps_rows(spark):
    texts = [None, "", " ", "It's 'quoted' \\ %", *(t for p in SAME + DIFFER for t in p), "я" * 50_000, "a​" * 20_000]
    f = forms(spark, texts)
    assert len(f) == len(texts) and f[0] is None and f[1] == "" and f[2] == " " and f[3] == texts[3]
    assert forms(spark, [f[i] for i in range(len(texts))]) == f


@pytest.mark.parametrize("partitions", [1, 5])
def test_pairs_of_copies_and_blanks(spark, rows, partitions):
    data = [(1, "copy that"), (2, "copy that"), (3, "сору that"), (4, "copy that"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "　"), (10, "Copy that"), (3, "сору that"), (None, "copy that")]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in data], "doc_id long, text string, form string, body string").repartition(partitions)
    assert rows(lookalike_pairs(df)) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert rows(lookalike_classes(df)) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3)]


def test_empty(spark, rows):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(lookalike_pairs(df)) == [] and rows(consistent_form(df)) == []


def test_texts_without_composing_characters_are_normal():
    """Each code point alone and between letters stays as it is unless it is listed."""
    listed = set(composing())
    for o in range(0x110000):
        c = chr(o)
        if c not in listed and not 0xD800 <= o < 0xE000:
            assert unicodedata.is_normalized("NFC", f"a{c}e{c}{c}"), hex(o)


def test_tables_map_to_other_characters():
    one, many = tables()
    assert not set(one) & ({c for v in one.values() for c in v} | {c for v in many.values() for c in v})  # parts may follow each other
    assert all(len(v) == 1 and k != v for k, v in one.items()) and all(len(v) > 1 for v in many.values())
