import random

import pytest

from ripplegraph.llm.tokens import _ids, _tokenizer, boundaries, decode, encode, token_bytes, token_counts, tokenizer_path

PATH = tokenizer_path()
TEXTS = [
    None, "", " ", "\n\n\n", "a", "It's <|endoftext|> we'll they've O(n²)\r\n\t  x", "naïve — café 🎉👩‍💻 日本語のテキスト", "a  b   c \n\n d" * 40, "x" * 3000, " " * 3000, "ab 　  'r're'll" * 60, "'" * 500 + "s'll",
]


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, no int").repartition(3)
    return encode(df, PATH, **how)


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 2_048), (64, 24), (17, 16), (200, 9)])
def test_chunks_give_what_whole_texts_give(spark, chunk, overlap):
    r = random.Random(chunk)
    alphabet = [*"abcdefgh'stlrvem", " ", "  ", "\n", "\t", "é", "日", "🎉", "12", "3", "!?", " ", " we'll", "\r\n"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(900))) for _ in range(60)]
    want = {i: _tokenizer(PATH).encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {x.doc_id: list(x.ids) for x in run(spark, texts, chunk=chunk, overlap=overlap).collect()}
    assert got == want
    sizes = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, chunk, overlap)
    assert {x.doc_id: x.n_tokens for x in sizes.collect()} == {i: len(v) for i, v in want.items()}


def test_ranks_and_tokenizer_agree_on_every_character():
    """Each code point between letters, digits, blanks and signs."""
    texts = [f"a{c}1{c} {c}  {c}'s{c}{c}!" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert _ids(PATH, part) == [e.ids for e in _tokenizer(PATH).encode_batch_fast(part, add_special_tokens=False)]


def test_round_trip(spark):
    got = {x.doc_id: x.text for x in decode(run(spark, TEXTS, chunk=64, overlap=24), PATH).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_every_byte_has_a_token():
    assert {b for b in token_bytes(PATH).values() if len(b) == 1} == {bytes([i]) for i in range(256)}


def test_boundaries_cover_the_text():
    text = TEXTS[6]
    assert boundaries(PATH, text)[-1] == len(text)


def test_empty_table_and_bad_sizes(spark):
    assert run(spark, []).collect() == [] and run(spark, []).columns == ["doc_id", "ids"]
    with pytest.raises(ValueError, match="overlap"):
        run(spark, [], chunk=8, overlap=8)


def test_a_long_run_inside_a_long_text(spark):
    """Only the stretch without a place to cut is put together; all else stays in pieces of a chunk."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcde") for _ in range(r.randrange(2, 9))) for _ in range(n))
    texts = [words(300) + " " + "x" * 700 + " " + words(300), "y" * 500 + words(200), words(200) + " " * 400, "z" * 900]
    want = {i: _tokenizer(PATH).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {x.doc_id: list(x.ids) for x in run(spark, texts, chunk=100, overlap=40).collect()} == want
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {x.doc_id: (x.n_tokens, x.source) for x in token_counts(df, PATH, 100, 40, keep=("source",)).collect()}
    assert got == {i: (len(v), f"s{i}") for i, v in want.items()}


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path("word_bpe_49k"))
