"""Encoding of the whole corpus with a public tokenizer, long texts in overlapping chunks."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.runtime import checkpointed, stored

#: Characters of a chunk, and of what it shares with the next; texts of up to a chunk are encoded as they are.
CHUNK, OVERLAP = 16_384, 2_048
#: Characters at a chunk's end whose pre-tokens may still depend on what follows (the longest contraction has three).
_UNSURE = 4

#: Fixed value: the published pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The tokenizer's file in ``folder``, else in $TOKENIZERS_DIR, else in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), f"{name}.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings are ordinary text
    return t


@cache
def checked(path: str) -> str:
    """``path``, if its tokenizer may be run in chunks: a byte-level one that splits text by ``PATTERN`` and nothing else.

    A normalizer, another pattern, or one that looks back makes pieces depend on what was cut off; those are refused rather
    than encoded wrongly.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError(f"{path}: only byte-level tokenizers with the published pattern and no normalizer can be run in chunks")
    return path


@cache
def _encoder(path: str):
    """The same vocabulary as ranks, which encode the same several times faster (a test compares the two)."""
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of each text by the rank file if there is one, else by the tokenizer's own library."""
    if os.path.exists(path.removesuffix(".json") + ".tiktoken"):
        return [_encoder(path).encode_ordinary(t) for t in texts]
    return [e.ids for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = list(accumulate(map(len, ids), initial=0))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(chain.from_iterable(ids), pa.int32()))


def boundaries(path: str, text: str) -> list[int]:
    """Ends of the pre-tokens of ``text``."""
    return [end for _, (_, end) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def _chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """(number, whether it is the last, text) of each chunk, the next chunk's first ``overlap`` characters included."""
    n = -(-len(text) // size)
    for k in range(n):
        yield k, k == n - 1, text[k * size : (k + 1) * size + overlap]


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = _ids(path, [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _lists(ids)], names=["doc_id", "ids"])

    return run


_CHUNK_ROWS = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])
_CHUNK_DDL = "doc_id long, no int, last boolean, text string"


def _cut(size: int, overlap: int):
    """Each text as its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chunks = _chunks(text, size, overlap)
                while rows := [(doc, *c) for c in islice(chunks, 256)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CHUNK_ROWS, strict=True)], schema=_CHUNK_ROWS)

    return run


def _counted_or_cut(path: str, size: int, overlap: int, schema: pa.Schema):
    """Of each text either its number of tokens, or its chunks where it is long; the columns behind the text go along."""
    nothing = list(schema)[2:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                short = pc.less_equal(pc.fill_null(pc.utf8_length(part.column(1)), 0), size)
                few = part.filter(short)
                counts = pa.array(map(len, _ids(path, [t or "" for t in few.column(1).to_pylist()])), pa.int64())
                none = [pa.nulls(few.num_rows, f.type) for f in nothing]
                yield pa.RecordBatch.from_arrays([few.column(0), counts, *none, *few.columns[2:]], schema=schema)
                for row in part.filter(pc.invert(short)).to_pylist():
                    doc, text, *rest = row.values()
                    chunks = _chunks(text, size, overlap)
                    while rows := [(doc, None, *c, *rest) for c in islice(chunks, 256)]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _edges(path: str, size: int, overlap: int):
    """Per chunk the sure pre-token ends in its first and in its last ``overlap`` characters, counted from where that part begins.

    Only ends behind a character that is no blank count: text cut there has the same pre-tokens as within the whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for text in b.column(3).to_pylist():
                ends = [e for e in boundaries(path, text) if not text[e - 1].isspace()]
                heads.append([e for e in ends if e <= overlap - _UNSURE])
                tails.append([e - size for e in ends if size < e <= size + overlap - _UNSURE])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, schema.field(2).type), pa.array(tails, schema.field(3).type)], schema=schema)

    return run


def _pieces(path: str, count: bool):
    """Encodes the text between two places where chunks are in step; a piece is whole chunks but for its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, no, texts, begin, end = (b.column(i).to_pylist() for i in range(5))
            ids = _ids(path, ["".join(t)[s : None if e is None else e] for t, s, e in zip(texts, begin, end, strict=True)])
            out = pa.array(map(len, ids), pa.int64()) if count else _lists(ids)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), out], names=["doc_id", "no", "ids"])

    return run


def encode(documents: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) of every document, without special tokens; null and empty texts have an empty list.

    doc_id is expected to be unique. Columns but doc_id and text are ignored, an empty table gives an empty one. A tokenizer
    that cannot be run in chunks raises ValueError.

    Texts of up to ``chunk`` characters are encoded where they are read, without a shuffle. Longer ones, found in a second
    scan (which costs less than moving or storing the ids of all others), are cut into overlapping chunks and stored; these
    spread over the cluster and are pre-tokenised there. Where a chunk and the next have a pre-token end in common within
    their overlap, they are in step from there on, as a pre-token depends on nothing before it; the text is cut there, and
    the pieces are encoded in parallel and put in order. Chunks whose overlap has no such place (a run of thousands of
    letters or blanks) are put together for that stretch alone, so the result is always exact.
    """
    path = _able(path, chunk, overlap)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_whole(path), "doc_id long, ids array<int>")
    parts = stored(_spread(docs.where(is_long).mapInArrow(_cut(chunk, overlap), _CHUNK_DDL)))
    p = F.sort_array(F.collect_list(F.struct("no", "ids")))
    long = _encoded(parts, path, chunk, overlap, False).groupBy("doc_id").agg(F.flatten(p["ids"]).alias("ids"))
    return short.unionByName(long)


def token_counts(documents: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, keep...) of every document: the sizes of what ``encode`` gives, in one scan of the texts.

    The columns ``keep`` go along, so that they need no join afterwards; ``documents`` may be several rows a doc_id only if
    they have a text of at most ``chunk`` characters.
    """
    path = _able(path, chunk, overlap)
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).cast("string").alias(c) for c in keep))
    extra = "".join(f", `{c}` string" for c in keep)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *list(_CHUNK_ROWS)[1:], *((c, pa.string()) for c in keep)])
    ddl = f"doc_id long, n_tokens long, no int, last boolean, text string{extra}"
    first = d.mapInArrow(_counted_or_cut(path, chunk, overlap, schema), ddl)
    first = stored(first.withColumn("short", F.col("n_tokens").isNotNull()), by="short")
    short = first.where("short").select("doc_id", "n_tokens", *keep)
    chunks = first.where("not short")
    sizes = _encoded(_spread(chunks.select("doc_id", "no", "last", "text")), path, chunk, overlap, True).groupBy("doc_id").agg(F.sum("ids").alias("n_tokens"))
    if keep:
        sizes = sizes.join(chunks.where("no = 0").select("doc_id", *keep), "doc_id")
    return short.unionByName(sizes.select("doc_id", "n_tokens", *keep))


def _able(path: str | None, chunk: int, overlap: int) -> str:
    if not 0 < overlap < chunk:
        raise ValueError("overlap must lie between 0 and chunk")
    return checked(path or tokenizer_path())


def _spread(parts: DataFrame) -> DataFrame:
    """Chunks by number, so that those of a text are not all put together again."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "no")


def _encoded(parts: DataFrame, path: str, chunk: int, overlap: int, count: bool) -> DataFrame:
    """(doc_id, no, ids) of the pieces of chunked texts; ``ids`` their number if only that is asked for."""
    edges = parts.mapInArrow(_edges(path, chunk, overlap), "doc_id long, no int, head array<int>, tail array<int>")
    w = W.partitionBy("doc_id").orderBy("no")
    in_step = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    sync = edges.select("doc_id", "no", in_step.alias("end"))
    # A piece begins behind each place in step; ``first`` is the number of its first chunk.
    sync = sync.withColumn("begin", F.when(F.lag("no").over(w).isNull(), 0).otherwise(F.lag("end").over(w)))
    sync = checkpointed(sync.withColumn("first", F.last(F.when(F.col("begin").isNotNull(), F.col("no")), ignorenulls=True).over(w)))
    x = parts.join(sync, ["doc_id", "no"])
    kind = "long" if count else "array<int>"
    ddl = f"doc_id long, no int, ids {kind}"
    alone = (F.col("first") == F.col("no")) & (F.col("end").isNotNull() | F.col("last"))
    one = x.where(alone).select("doc_id", "no", F.array("text").alias("texts"), "begin", (F.col("end") + chunk).alias("end"))
    # A stretch without a place to cut: bodies without what they share with the next, the last one with it.
    several = x.where(~alone).groupBy("doc_id", F.col("first").alias("no")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda c: c["text"]).alias("texts"), F.max("begin").alias("begin"), F.max_by("end", "no").alias("end"), F.count("*").alias("n")
    )
    bodies = F.transform("texts", lambda t, i: F.when(i < F.size("texts") - 1, F.left(t, F.lit(chunk))).otherwise(t))
    several = several.select("doc_id", "no", bodies.alias("texts"), "begin", (F.col("end") + F.col("n") * chunk).cast("int").alias("end"))
    return one.unionByName(several).mapInArrow(_pieces(path, count), ddl)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens' raw bytes joined and read as UTF-8; null ids give a null text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(path)
        for b in batches:
            texts = [None if ids is None else b"".join(raw[i] for i in ids).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    """Each id's bytes: byte-level vocabularies spell bytes 33-126, 161-172 and 174-255 as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in own)}
    return {i: bytes(spelled[c] for c in t) for t, i in _tokenizer(path).get_vocab(with_added_tokens=False).items() if all(c in spelled for c in t)}
