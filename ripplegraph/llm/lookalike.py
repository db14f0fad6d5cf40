"""Visually identical text with different characters: one consistent form, and the texts that share it.

DuckDB runs inside Arrow partitions; its embedded SQL maps compatibility forms, invisible characters and look-alikes with
nfc_normalize, translate and regular expressions. What differs visibly stays apart: case, accents, superscripts,
punctuation, and joined or separate emoji.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.runtime import checkpointed

#: Letters, numerals and signs of other scripts that look like a character of the key's script.
LOOKALIKES = {
    # Latin, from Cyrillic, Greek, Armenian, Cherokee, Lisu, Hebrew and phonetic letters
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ",
    "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜϺᎷꓟ", "N": "Νꓠ",
    "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ",
    "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "оοօס", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уүγ",
    # signs
    "!": "ǃ", "%": "٪", "*": "∗٭", "-": "‐‑−", "/": "⁄∕", ":": "∶꞉։", ";": ";", "\\": "∖⧵", "|": "∣ǀ", "~": "∼",
    "·": "∙⋅·", "μ": "µ", "Σ": "∑", "Π": "∏", "Δ": "∆",
    # Katakana, Hiragana and ideographs
    "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ハ": "八", "ヘ": "へ", "ロ": "口", "ー": "一",
}
#: Characters that do not show. The joiner and the tags show only within emoji.
INVISIBLE = (
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U000e0100-\U000e01ef]"
)
_EMOJI = (
    "[\u00a9\u00ae\u203c\u2049\u20e3\u2122\u2139\u2190-\u21ff\u231a-\u23ff\u24c2\u25a0-\u27bf\u2934\u2935\u2b00-\u2bff\u3030\u303d\u3297\u3299"
    "\U0001f000-\U0001faff]"
)
JOINER = f"({_EMOJI}(?:\u200d{_EMOJI})+)|(\U0001f3f4[\U000e0020-\U000e007f]+)|[\u200d\U000e0000-\U000e007f]"
#: Kinds of blank, and ends of lines.
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u2800\u3000"
LINES = "\r\n|[\r\u0085\u2028\u2029]"
#: Compatibility forms of these kinds look like what they stand for; super, sub, circle, square, fraction and vertical do not.
_KINDS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Compatibility forms that do show: the long s and Greek symbol forms, and spacing accents (those that stand for a blank and a mark).
_SHOWN = {0x017F, *range(0x03D0, 0x03D7), 0x03F0, 0x03F1, 0x03F4, 0x03F5}

#: Where characters that stand for several are taken as looking like them: digraphs, Greek and Cyrillic, dots, numerals, ligatures.
_SPELLED = ((0x0080, 0x06FF), (0x1E00, 0x20A7), (0x2150, 0x2A7F), (0xFB00, 0xFB17))


@cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(character to character, character to several), from the rules above and the Unicode data of Python."""
    alike = {c: to for to, from_ in LOOKALIKES.items() for c in from_}
    blank = dict.fromkeys(BLANKS, " ")

    def mapped(s: str) -> str:
        return unicodedata.normalize("NFC", "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", s)))

    one, many = {}, {}
    for o in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        to = c
        if kind in _KINDS and o not in _SHOWN:
            to = unicodedata.normalize("NFKD", c)
            if to.startswith(" ") and len(to) > 1 or not to.strip() and c not in blank:
                continue
        to = mapped(to)
        if c in blank:
            to = " "
        elif c in alike:
            to = alike[c]
        if to != c and to != unicodedata.normalize("NFC", c):
            if len(to) == 1:
                one[c] = to
            elif any(a <= o <= b for a, b in _SPELLED):
                many[c] = to
    return one | {"\t": " "}, many


@cache
def composing() -> list[str]:
    """Characters that normalisation may change or join to the one before; text without any is in its form already."""
    second = set()
    changed = []
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            second.update(chr(int(x, 16)) for x in parts.split()[1:])
        if unicodedata.combining(c) or 0x1161 <= o <= 0x1175 or 0x11A8 <= o <= 0x11C2 or (parts and unicodedata.normalize("NFC", c) != c):
            changed.append(c)
    return sorted({*changed, *second})


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_of(chars: list[str]) -> str:
    """A regular expression for one of ``chars``, as ranges of code points."""
    ranges: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if ranges and o == ranges[-1][1] + 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    at = lambda o: f"\\x{{{o:X}}}"
    return "[" + "".join(at(a) if a == b else f"{at(a)}-{at(b)}" for a, b in ranges) + "]"


#: Characters of a part of the table that one call translates. DuckDB builds the part anew for each text, so parts are small
#: and only texts that hold one of their characters meet them.
_PART = 128


@cache
def form_sql(table: str) -> str:
    """The embedded SQL: (doc_id, text, form) from (doc_id, text)."""
    one, many = tables()
    guarded = lambda chars, then: f"CASE WHEN regexp_matches(t, {_quoted(_any_of(chars))}) THEN {then} ELSE t END"
    steps = f"regexp_replace(text, {_quoted(LINES)}, chr(10), 'g')"
    steps = f"regexp_replace({steps}, {_quoted(INVISIBLE)}, '', 'g')"
    steps = f"regexp_replace({steps}, {_quoted(JOINER)}, '\\1\\2', 'g')"
    spelled = "t"
    for c, to in many.items():
        spelled = f"replace({spelled}, {_quoted(c)}, {_quoted(to)})"
    stages = [guarded(list(many), spelled)]
    chars = sorted(one)
    for at in range(0, len(chars), _PART):
        part = chars[at : at + _PART]
        stages.append(guarded(part, f"translate(t, {_quoted(''.join(part))}, {_quoted(''.join(one[c] for c in part))})"))
    stages.append(guarded(composing(), "nfc_normalize(t)"))
    plain = "regexp_full_match(text, '[ -~\\n]*')"
    ctes = [f"s0 AS (SELECT doc_id, text, {steps} AS t FROM {table} WHERE NOT {plain})"]
    ctes += [f"s{i + 1} AS (SELECT doc_id, text, {stage} AS t FROM s{i})" for i, stage in enumerate(stages)]
    return f"WITH {', '.join(ctes)} SELECT doc_id, text, t AS form FROM s{len(stages)} UNION ALL SELECT doc_id, text, text FROM {table} WHERE {plain} OR text IS NULL"


#: Bytes of batches that DuckDB is given at once: it plans anew each time, which takes as long as some thousand texts.
_BYTES = 32_000_000


def _run(sql: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The SQL over Arrow batches, seen as the table ``texts``, in a DuckDB of one thread per task that never spills."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= _BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        try:
            for table in some(batches):
                con.register("texts", table)
                got = con.sql(sql).to_arrow_table()
                con.unregister("texts")
                yield from got.cast(schema).to_batches(max_chunksize=10_000)
        finally:
            con.close()

    return run


def consistent_form(documents: DataFrame) -> DataFrame:
    """(doc_id, form) of every document; a null text has a null form, an empty one an empty form.

    Every document keeps its row, repeats included; texts are taken whole. Columns but doc_id and text are ignored, an
    empty table gives an empty one. The form is meant for comparisons: in it Cyrillic and Greek letters that look Latin are
    Latin, so words of those scripts are mixed in it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string())])
    run = _run(f"SELECT doc_id, form FROM ({form_sql('texts')})", schema)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, form string")


def _alike(documents: DataFrame) -> DataFrame:
    """(form, body, doc_id) of the documents whose form several different texts have; form and body are 128-bit hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("body", pa.string())])
    sql = f"SELECT doc_id, md5(form) AS form, md5(text) AS body FROM ({form_sql('texts')}) WHERE regexp_matches(form, '[^\\s\\pZ\\pC]')"
    d = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = d.mapInArrow(_run(sql, schema), "doc_id long, form string, body string")
    hashed = checkpointed(hashed.select("doc_id", F.unhex("form").alias("form"), F.unhex("body").alias("body")).distinct())
    texts = hashed.groupBy("form", "body").agg(F.count("*").alias("n")).groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(hashed.join(texts.select("form"), "form", "left_semi"))


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b, of documents whose texts differ but have one form.

    Null texts, and texts without a visible character, are no case; exact copies are no pair of each other. A doc_id that
    is repeated is never paired with itself. Columns but doc_id and text are ignored, an empty table gives no pairs.

    Scale: behind the form only 128-bit hashes of form and text move. Only forms with two texts or more go on; pairs are
    sought between the distinct texts of a form and only then spread to the documents that have them, so copies are never
    compared, and what is made is what comes out. A text that very many documents share is split by the adaptive skew join.
    Where so many look alike that their pairs are too many to write, ``lookalike_classes`` says the same in a row a document.
    """
    live = _alike(documents)
    a, b = (live.select("form", F.col("body").alias(k)).distinct() for k in "ab")
    texts = a.join(b, "form").where("a < b").select("a", "b")
    pairs = texts.join(live.select(F.col("body").alias("a"), F.col("doc_id").alias("i")), "a").join(live.select(F.col("body").alias("b"), F.col("doc_id").alias("j")), "b")
    return pairs.where("i <> j").select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of each document that looks like one with other characters: the class is named by its
    least doc_id, n_links counts the documents of the class whose text differs. Cases as in ``lookalike_pairs``; a doc_id
    with several texts has a row for each class and text. Rows stay as many as documents, whatever the size of a class."""
    live = _alike(documents)
    bodies = live.groupBy("form", "body").agg(F.count("*").alias("same"), F.min("doc_id").alias("least"))
    classes = bodies.groupBy("form").agg(F.sum("same").alias("size"), F.min("least").alias("class_id"))
    x = live.join(bodies.select("form", "body", "same"), ["form", "body"]).join(classes, "form")
    return x.select("doc_id", "class_id", (F.col("size") - F.col("same")).alias("n_links"))
