"""Byte-exact hunks of patches, with identities, and their structural projection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(rb"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_INDEX = re.compile(rb"index ([0-9a-f]+)\.\.([0-9a-f]+)")
_NO_NEWLINE = b"\\ No newline at end of file"
_MOST = 2**32 - 1


class PatchError(ValueError):
    """A patch whose hunks do not hold what their headers say."""


def _path(line: bytes, side: bytes) -> str | None:
    name = line[4:].rstrip(b"\r\n").split(b"\t")[0]
    if name == b"/dev/null":
        return None
    if not name.startswith(side):
        raise PatchError("file header without a side prefix")
    return name[2:].decode()


def parse_patch(data: bytes) -> list[tuple]:
    """(path, old_start, old_lines, new_start, new_lines, old_blob, new_blob, raw) of each hunk, in order of place.

    The bytes of a hunk run from its header to the next line that is not its own; a marker for a missing line end belongs
    to it. Raises PatchError where a body does not match its header.
    """
    out: list[tuple] = []
    lines = [m.span() for m in re.finditer(rb"[^\n]*\n|[^\n]+", data)]
    old = new = old_blob = new_blob = None
    k = 0
    while k < len(lines):
        a, b = lines[k]
        line = data[a:b]
        k += 1
        if line.startswith(b"diff --git "):
            old = new = old_blob = new_blob = None
        elif m := _INDEX.match(line):
            old_blob, new_blob = (None if set(x) == {48} else x.decode() for x in m.groups())
        elif line.startswith(b"--- "):
            old = _path(line, b"a/")
            old_blob = old_blob if old else None
        elif line.startswith(b"+++ "):
            new = _path(line, b"b/")
            new_blob = new_blob if new else None
        elif line.startswith(b"@@ "):
            m = _HUNK.match(line)
            path = new or old
            if not m or not path:
                raise PatchError("hunk header that cannot be read, or without a file")
            numbers = [1 if x is None else int(x) for x in m.groups()]
            if max(numbers) > _MOST:
                raise PatchError("number beyond 32 bits")
            left = [numbers[1], numbers[3]]
            while k < len(lines):
                c = data[lines[k][0] : lines[k][0] + 1]
                if c == b"\\":
                    if data[slice(*lines[k])].rstrip(b"\r\n") != _NO_NEWLINE:
                        raise PatchError("unknown marker")
                elif left == [0, 0]:
                    break
                elif c in (b" ", b"-", b"+"):
                    left[0] -= c != b"+"
                    left[1] -= c != b"-"
                    if min(left) < 0:
                        raise PatchError(f"hunk of {path} holds more than it declares")
                else:
                    raise PatchError(f"line of {path} that belongs to no hunk")
                k += 1
            if left != [0, 0]:
                raise PatchError(f"hunk of {path} holds less than it declares")
            out.append((path, *numbers, old_blob, new_blob, data[a : lines[k - 1][1]]))
    return sorted(out, key=lambda h: (h[0], h[1:5]))


_SCHEMA = pa.schema([
    ("patch_id", pa.string()), ("path", pa.string()), ("old_start", pa.int64()), ("old_lines", pa.int64()), ("new_start", pa.int64()), ("new_lines", pa.int64()), ("old_blob", pa.string()), ("new_blob", pa.string()), ("raw", pa.binary()), ("error", pa.string()),
])
_DDL = "patch_id string, path string, old_start long, old_lines long, new_start long, new_lines long, old_blob string, new_blob string, raw binary, error string"


def observed_hunks(patches: DataFrame) -> DataFrame:
    """The hunks of (patch_id, data binary); a patch that is not well formed gives one row with its error and no hunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(i, *h, None) for h in parse_patch(data or b"")]
                except (PatchError, UnicodeDecodeError) as e:
                    rows.append((i, *[None] * 8, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return patches.select(F.col("patch_id").cast("string"), "data").mapInArrow(run, _DDL)


def structural(hunks: DataFrame) -> DataFrame:
    """(patch_id, path, hunks): the numbers of each file's hunks in order, without bytes."""
    h = F.struct("old_start", "old_lines", "new_start", "new_lines")
    return hunks.where("error is null").groupBy("patch_id", "path").agg(F.sort_array(F.collect_list(h)).alias("hunks"))


def missing_hunks(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Identities that relations refer to and no indexed hunk has."""
    return wanted.select("identity").distinct().join(known.select("identity"), "identity", "left_anti")
