"""TypeScript text to rows: symbols, imports and calls by a scanner of its own, names resolved across files by joins.

There is no type checker here. A call is resolved by name: to a value imported under that name, else to a symbol declared
in the file. Members of an imported namespace are resolved in its file. Lost against a compiler: members of objects, names that are re-exported,
and calls to parameters or destructured values.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.ids import edge_id, slugify
from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.extract import classify_path, extract_documents, extract_migrations, parse_markers
from ripplegraph.runtime import stored

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$][\w$]*)"""
    r"""|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<mark>.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "typeof", "await", "function", "new", "super", "import", "in", "of", "instanceof", "void", "delete", "throw", "case", "else", "do", "yield", "async", "constructor"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "else", "do", "=>"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Source:
    """Tokens of one file, with the bracket each closes and the doc comment before each."""

    def __init__(self, text: str) -> None:
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.doc: list[str | None] = []
        self._scan(text, 0, False)
        self.match = [-1] * len(self.text)
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] != "mark":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                while stack and _OPEN[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    self.match[stack[-1]] = i
                    self.match[i] = stack.pop()

    def _scan(self, text: str, pos: int, nested: bool) -> int:
        """From ``pos`` to the end, or to the brace that closes a template's ``${``."""
        doc, depth = None, 0
        while pos < len(text):
            c = text[pos]
            if c == "`":
                start = pos
                pos += 1
                while pos < len(text) and text[pos] != "`":
                    if text[pos] == "\\":
                        pos += 2
                    elif text.startswith("${", pos):
                        pos = self._scan(text, pos + 2, True)
                    else:
                        pos += 1
                pos += 1
                self._add("string", "`", start, pos, None)
                continue
            m = None
            if c == "/" and (not self.text or self.text[-1] in _BEFORE_REGEX or (self.kind[-1] == "mark" and self.text[-1] not in (")", "]", "}"))):
                m = _REGEX.match(text, pos)
                if m:
                    self._add("string", "/", pos, m.end(), None)
                    pos = m.end()
                    continue
            m = _TOKEN.match(text, pos)
            kind, value, start, pos = m.lastgroup, m.group(), pos, m.end()
            if kind == "doc":
                doc = value
            elif kind not in ("space", "comment"):
                if nested and value == "{":
                    depth += 1
                elif nested and value == "}":
                    if not depth:
                        return pos
                    depth -= 1
                self._add("mark" if kind == "arrow" else kind, value, start, pos, doc)
                doc = None
        return pos

    def _add(self, kind: str, value: str, start: int, end: int, doc: str | None) -> None:
        self.kind.append(kind)
        self.text.append(value)
        self.at.append(start)
        self.end.append(end)
        self.doc.append(doc)

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.at[i])

    def end_line(self, i: int) -> int:
        return bisect_right(self.lines, self.end[i] - 1)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] != "string" and self.text[i] in texts

    def name(self, i: int) -> str | None:
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] == "name" else None

    def skip(self, i: int) -> int:
        """The token behind token ``i``, or behind the bracket it opens."""
        return self.match[i] + 1 if self.match[i] > i else i + 1

    def find(self, i: int, *stops: str) -> int:
        """The first of ``stops`` from ``i`` on outside brackets."""
        while i < len(self.text) and not self.is_(i, *stops) and not (self.is_(i, *_CLOSE)):
            i = self.skip(i)
        return i

    def statement_end(self, i: int) -> int:
        """The last token of an expression statement or type: before ``;``, a comma, a closing bracket or a new statement."""
        last = i
        while i < len(self.text) and not self.is_(i, ";", ",") and not self.is_(i, *_CLOSE):
            if i > last and self.line(i) > self.end_line(i - 1) and self.kind[i] == "name" and self.text[i] in {"export", "const", "let", "var", "function", "class", "interface", "type", "enum", "import", "return", "if"}:
                break
            i = self.skip(i)
            last = i
        return i if self.is_(i, ";") else i - 1


def extract_source(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(symbols, imports, calls) of one file.

    symbols: (ord, name, kind, start_line, end_line, exported, doc); imports: (specifier, names as they are here, line,
    namespace, names as they are there);
    calls: (caller, callee, line, receiver), the receiver of ``a.b()`` being a.
    """
    s = Source(text)
    symbols: list[tuple] = []
    imports: list[tuple] = []
    calls: list[tuple] = []
    spans: list[tuple[int, int, str]] = []  # named functions and classes, for callers
    bodies: set[int] = set()  # braces that open class bodies and the like, in which name( declares

    def record(first: int, last: int, name: str, kind: str, exported: bool, caller: bool) -> None:
        symbols.append((len(symbols), name, kind, s.line(first), s.end_line(last), exported, s.doc[first]))
        if caller:
            spans.append((first, last, name))

    i, n = 0, len(s.text)
    while i < n:
        if s.kind[i] != "name" or s.is_(i - 1, "."):
            if s.name(i) and s.name(i - 2) and s.is_(i + 1, "(") and not s.is_(i - 3, "."):
                calls.append((i, s.text[i], s.line(i), s.text[i - 2]))
            i += 1
            continue
        word, first = s.text[i], i
        while s.name(first - 1) in _MODIFIERS:
            first -= 1
        exported = any(s.text[k] == "export" for k in range(first, i))
        nxt = s.name(i + 1)
        if word == "function" and (s.name(i + 1) or (s.is_(i + 1, "*") and s.name(i + 2))):
            name_at = i + 1 if nxt else i + 2
            body = s.find(name_at + 1, "{", ";")
            while s.is_(body, "{") and s.is_(body - 1, ":", "|", "&", "=>", "is", "<", ","):  # an object type in the return type
                body = s.find(s.skip(body), "{", ";")
            last = s.match[body] if s.is_(body, "{") and s.match[body] > 0 else min(body, n - 1)
            if s.is_(i - 1, "=", "(", ",", ":", "=>", "return"):  # an expression, not a declaration
                i = name_at + 1
                continue
            record(first, last, s.text[name_at], "function", exported, True)
            i = name_at + 1
        elif word in ("class", "interface", "enum") and nxt and nxt not in ("extends", "implements") and not s.is_(i - 1, "=", "(", ",", ":", "return"):
            body = s.find(i + 2, "{", ";")
            last = s.match[body] if s.is_(body, "{") and s.match[body] > 0 else min(body, n - 1)
            if word == "enum" and s.name(first - 1) == "const":
                first -= 1
                exported = exported or s.name(first - 1) == "export"
                first -= s.name(first - 1) == "export"
            bodies.add(body)
            record(first, last, nxt, word, exported, word == "class")
            i += 2
        elif word == "type" and nxt and s.is_(i + 2, "=", "<") and not s.is_(i - 1, "{", ",", "import"):
            eq = s.find(i + 2, "=") if s.is_(i + 2, "=") else i + 2
            while eq < n and not s.is_(eq, "="):
                eq += 1
            record(first, min(s.statement_end(eq + 1), n - 1), nxt, "type", exported, False)
            i += 2
        elif word in ("const", "let", "var") and nxt and nxt != "enum":
            at = i + 1
            while s.name(at):
                eq = s.find(at + 1, "=", ";", ",")
                if not s.is_(eq, "="):
                    break
                v = eq + 1
                v += s.is_(v, "async")
                arrow = -1
                if s.is_(v, "function"):
                    body = s.find(v + 1, "{", ";")
                    last = s.match[body] if s.is_(body, "{") else body
                    arrow = v
                else:
                    p = v
                    if s.is_(p, "<"):
                        while p < n and not s.is_(p, "("):
                            p += 1
                    if s.is_(p, "(") and s.match[p] > 0:
                        k = s.match[p] + 1
                        if s.is_(k, ":"):
                            k = s.find(k + 1, "=>", ";", ",")
                        arrow = k if s.is_(k, "=>") else -1
                    elif s.name(p) and s.is_(p + 1, "=>"):
                        arrow = p + 1
                    if arrow > 0:
                        last = s.match[arrow + 1] if s.is_(arrow + 1, "{") and s.match[arrow + 1] > 0 else s.statement_end(arrow + 1) - s.is_(s.statement_end(arrow + 1), ";")
                if arrow > 0:
                    record(first, min(max(last, v), n - 1), s.text[at], "function", exported, True)
                    break
                k = s.find(eq + 1, ",", ";")
                if not s.is_(k, ",") or (s.line(k) != s.line(eq) and not s.name(k + 1)):
                    break
                at = k + 1
            i += 2
        elif word == "import" and not s.is_(i + 1, "(", "."):
            stop = i + 1
            while stop < n and s.kind[stop] != "string" and not s.is_(stop, ";"):
                stop += 1
            if stop < n and s.kind[stop] == "string":
                names: list[str] = []
                origins: list[str] = []
                namespace = None
                if not (s.is_(i + 1, "type") and not s.is_(i + 2, "from", ",")):
                    k = i + 1
                    while k < stop:
                        if s.name(k) and s.text[k] not in ("from", "as", "type"):
                            origin = s.text[k]
                            if s.is_(k + 1, "as"):
                                k += 2
                            if s.name(k) and not s.is_(k - 1, "type"):
                                names.append(s.text[k])
                                origins.append(origin)
                        elif s.is_(k, "*") and s.is_(k + 1, "as"):
                            namespace = s.name(k + 2)
                        elif s.is_(k, "type") and s.name(k + 1) and s.is_(k + 2, "as"):
                            k += 3
                        k += 1
                imports.append((text[s.at[stop] + 1 : s.end[stop] - 1], names, s.line(i), namespace, origins))
            i = stop + 1
        else:
            if s.is_(i + 1, "(") and word not in _NO_CALL and not s.is_(i - 1, "function", "new"):
                close = s.match[i + 1]
                follows = close + 1 if close > 0 else n
                declares = s.is_(follows, "{") or (s.is_(follows, ":") and _opened_by(s, i) in bodies)
                if not declares:
                    calls.append((i, word, s.line(i), None))
            i += 1
    out = []
    spans.sort()
    for at, callee, line, receiver in calls:
        inside = [(last - first, name) for first, last, name in spans if first <= at <= last]
        out.append((min(inside)[1] if inside else None, callee, line, receiver))
    return symbols, imports, out


def _opened_by(s: Source, i: int) -> int:
    """The brace whose body directly holds token ``i``."""
    k = i - 1
    while k >= 0:
        if s.is_(k, *_CLOSE) and s.match[k] >= 0:
            k = s.match[k]
        elif s.is_(k, *_OPEN):
            return k
        k -= 1
    return -1


def module_candidates(path: str, specifier: str) -> list[str]:
    """Files that a relative specifier may mean, in order of preference; others name packages."""
    if not specifier.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))
    bare = re.sub(r"\.(js|mjs|cjs|jsx)$", "", base)
    return [base, *(f"{bare}{x}" for x in (".ts", ".tsx", ".mts", ".cts")), *(f"{base}/index{x}" for x in (".ts", ".tsx"))]


_SCHEMA = pa.schema([
    ("rel_path", pa.string()),
    ("symbols", pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("doc", pa.string())]))),
    ("imports", pa.list_(pa.struct([("specifier", pa.string()), ("names", pa.list_(pa.string())), ("line", pa.int32()), ("namespace", pa.string()), ("origins", pa.list_(pa.string())), ("candidates", pa.list_(pa.string()))]))),
    ("calls", pa.list_(pa.struct([("caller", pa.string()), ("callee", pa.string()), ("line", pa.int32()), ("receiver", pa.string())]))),
])
_DDL = (
    "rel_path string, symbols array<struct<ord:int,name:string,kind:string,start_line:int,end_line:int,exported:boolean,doc:string>>, "
    "imports array<struct<specifier:string,names:array<string>,line:int,namespace:string,origins:array<string>,candidates:array<string>>>, calls array<struct<caller:string,callee:string,line:int,receiver:string>>"
)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            symbols, imports, calls = extract_source(text or "")
            imports = [(*i, module_candidates(path, i[0])) for i in imports]
            rows.append((path, *([dict(zip((f.name for f in _SCHEMA.field(k).type.value_type), r, strict=True)) for r in part] for k, part in ((1, symbols), (2, imports), (3, calls)))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def extract_files(files: DataFrame) -> DataFrame:
    """(rel_path, symbols, imports, calls) of TypeScript files (rel_path, content)."""
    return files.select("rel_path", "content").mapInArrow(_extract, _DDL)


def index_repository(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository's ``files`` (rel_path, content): modules, tests, symbols, markers, documents,
    migrations, and the imports, calls, tests and links between them, before merging.

    Rows carry ``seq`` for first-wins merges (``merge_nodes``, ``merge_edges``).
    """
    f = files.select(normalize_path("rel_path").alias("rel_path"), "content").withColumn("role", classify_path(F.col("rel_path"), F.col("content")))
    repo = F.lit(f"repo:{root}")
    code = f.where("role in ('source', 'test')")
    own = F.when(F.col("role") == "test", F.concat(F.lit("test:"), "rel_path")).otherwise(F.concat(F.lit("mod:"), "rel_path"))
    mods = code.select("rel_path", "role", own.alias("id"))
    x = stored(extract_files(code))

    def ev(path, start, end, kind):  # noqa: ANN001, ANN202
        return F.array(F.struct(path.alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), kind.alias("source_kind"), F.lit(None).cast("string").alias("excerpt")))

    null = F.lit(None)
    no_tags, no_meta = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")

    def node(df, id_, kind, name, path, evidence, seq, exported=None, context=None, tags=no_tags, meta=no_meta):  # noqa: ANN001, ANN202
        exported = null.cast("boolean") if exported is None else exported
        return df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), path.alias("file_path"), (null.cast("string") if context is None else context).alias("bounded_context"), exported.alias("exported"), evidence.alias("evidence"), tags.alias("tags"), meta.alias("metadata"), seq.alias("seq"))

    def edge(df, kind, a, b, evidence, seq, meta=no_meta):  # noqa: ANN001, ANN202
        return df.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), evidence.alias("evidence"), meta.alias("metadata"), seq.alias("seq"))

    seq = lambda stage, *parts: F.concat_ws("\1", F.lit(stage), *(F.lpad(p.cast("string"), 9, "0") if str(p).find("line") >= 0 or str(p).find("ord") >= 0 else p for p in parts))
    path, c = F.col("rel_path"), F.col
    is_test = c("role") == "test"
    base = F.element_at(F.split(path, "/"), -1)
    code_ev = lambda line: ev(path, line, null, F.lit("code"))
    sym = x.select("rel_path", F.explode("symbols").alias("s")).select("rel_path", "s.*").withColumn("id", F.concat_ws(":", F.lit("sym"), "kind", "rel_path", "name", "start_line"))
    last = sym.groupBy("rel_path", "name").agg(F.max_by("id", "ord").alias("id"))
    imp = x.select("rel_path", F.explode("imports").alias("i")).select("rel_path", "i.*")
    cand = imp.select("rel_path", "specifier", "line", "names", "origins", "namespace", F.posexplode("candidates").alias("pos", "target"))
    to = cand.join(mods.select(c("rel_path").alias("target"), c("id").alias("to_id"), c("role").alias("to_role")), "target")
    to = to.groupBy("rel_path", "specifier", "line", "names", "origins", "namespace").agg(F.min_by(F.struct("target", "to_id"), "pos").alias("t")).select("rel_path", "specifier", "line", "names", "origins", "namespace", "t.target", "t.to_id")
    from_ = to.join(mods.select("rel_path", c("id").alias("from_id"), "role"), "rel_path")
    bound = from_.select("rel_path", "role", "from_id", "target", "line", F.explode(F.arrays_zip("names", "origins")).alias("z")).select("rel_path", "role", "from_id", "target", "line", c("z.names").alias("name"), c("z.origins").alias("origin"))
    imported = bound.join(last.select(c("rel_path").alias("target"), c("name").alias("origin"), c("id").alias("sym_id")), ["target", "origin"])
    value = bound.join(last.select(c("rel_path").alias("target"), "name", c("id").alias("sym_id")), ["target", "name"])
    call = x.select("rel_path", F.explode("calls").alias("k")).select("rel_path", "k.*")
    known = imported.select("rel_path", c("name").alias("callee"), c("sym_id").alias("to_id"), F.lit(0).alias("pref")).unionByName(last.select("rel_path", c("name").alias("callee"), c("id").alias("to_id"), F.lit(1).alias("pref")))
    known = known.groupBy("rel_path", "callee").agg(F.min_by("to_id", "pref").alias("to_id"))
    through = from_.where("namespace is not null").select("rel_path", c("namespace").alias("receiver"), "target").join(last.select(c("rel_path").alias("target"), c("name").alias("callee"), c("id").alias("to_id")), "target")
    plain = call.where("receiver is null").join(known, ["rel_path", "callee"]).select("rel_path", "caller", "line", "to_id")
    call = plain.unionByName(call.join(through, ["rel_path", "receiver", "callee"]).select("rel_path", "caller", "line", "to_id")).join(last.select("rel_path", c("name").alias("caller"), c("id").alias("caller_id")), ["rel_path", "caller"], "left").join(mods.select("rel_path", c("id").alias("mod_id")), "rel_path")
    mark = parse_markers(sym.where("doc is not null").select(F.struct("rel_path", "id", "start_line", "ord").alias("k"), c("doc").alias("comment")), "k").select("k.*", "no", "tag", "slug", "statement")
    slug = slugify("slug")
    what = {"capability": ("cap:", "capability", "implements_capability"), "invariant": ("inv:", "invariant", "constrained_by"), "contract": ("contract:", "contract", "declares"), "risk": ("risk:", "risk", "related_to"), "boundedContext": ("bc:", "bounded_context", "belongs_to")}
    said = F.when(c("statement").isNotNull(), F.create_map(F.lit("statement"), c("statement"))).otherwise(no_meta)
    docs = extract_documents(f.where("role = 'document'").select("rel_path", c("content").alias("text")), "rel_path")
    doc_id, doc_ev = F.concat(F.lit("doc:"), path), ev(path, F.lit(1), null, F.lit("document"))
    migs = f.where("role = 'migration'").select("rel_path", c("content").alias("text"))
    tables, limits = extract_migrations(migs, "rel_path")
    made = migs.select("rel_path").join(tables.groupBy("rel_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "table_name"))), lambda t: t["table_name"]), ",").alias("tables")), "rel_path", "left")
    mig_id, mig_ev = F.concat(F.lit("mig:"), path), code_ev(F.lit(1))
    flag = lambda b: F.when(b, "true").otherwise("false")
    about = F.create_map(F.lit("type"), c("type"), F.lit("deprecated"), flag(c("deprecated")))
    listed = lambda col, p, kind: node(docs.select("rel_path", F.explode(col).alias("v")), F.concat(F.lit(p), slugify("v")), F.lit(kind), c("v"), null.cast("string"), doc_ev, seq("5", path, c("v")), tags=F.array(F.lit("from-doc")))
    adr = docs.where("type = 'adr' or decision is not null")
    dec_id = F.concat(F.lit("dec:"), slugify("rel_path"))
    in_context = docs.where("bounded_context is not null")
    nodes = [
        node(f.limit(1), repo, F.lit("repository"), F.lit(root), null.cast("string"), F.filter(code_ev(F.lit(1)), lambda _: F.lit(False)), F.lit("0")),
        node(mods, c("id"), F.when(is_test, "test").otherwise("module"), base, path, ev(path, null, null, F.when(is_test, "test").otherwise("code")), seq("1", path)),
        node(sym, c("id"), c("kind"), c("name"), path, ev(path, c("start_line"), c("end_line"), F.lit("code")), seq("2", path, c("ord")), exported=c("exported"), meta=F.create_map(F.lit("exported"), flag(c("exported")))),
        node(mark.where("tag = 'tag'"), c("id"), null.cast("string"), null.cast("string"), null.cast("string"), F.filter(code_ev(F.lit(1)), lambda _: F.lit(False)), seq("9", path, c("ord")), tags=F.array("slug")),
        node(mark.where("tag = 'boundedContext'"), c("id"), null.cast("string"), null.cast("string"), null.cast("string"), F.filter(code_ev(F.lit(1)), lambda _: F.lit(False)), seq("9", path, c("ord")), context=c("slug")),
        node(docs, doc_id, F.lit("document"), c("title"), path, doc_ev, seq("4", path), context=c("bounded_context"), tags=F.when(c("deprecated"), F.array(F.lit("deprecated"))).otherwise(no_tags), meta=about),
        listed("capabilities", "cap:", "capability"), listed("invariants", "inv:", "invariant"),
        node(adr, dec_id, F.lit("decision"), c("title"), path, doc_ev, seq("5", path), context=c("bounded_context"), meta=F.create_map(F.lit("statement"), F.coalesce("decision", "title"))),
        node(in_context, F.concat(F.lit("bc:"), slugify("bounded_context")), F.lit("bounded_context"), c("bounded_context"), null.cast("string"), doc_ev, seq("5", path)),
        node(made, mig_id, F.lit("migration"), base, path, mig_ev, seq("6", path), meta=F.create_map(F.lit("tables"), F.coalesce("tables", F.lit("")))),
        node(limits, F.concat(F.lit("inv:"), slug), F.lit("invariant"), c("slug"), null.cast("string"), code_ev(c("line")), seq("7", path, c("line")), tags=F.array(F.lit("from-migration")), meta=said),
    ]
    edges = [
        edge(mods, "belongs_to", c("id"), repo, ev(path, null, null, F.lit("code")), seq("1", path)),
        edge(sym.join(mods.select("rel_path", c("id").alias("m")), "rel_path"), "declares", c("m"), c("id"), code_ev(c("start_line")), seq("2", path, c("ord"))),
        edge(from_, "imports", c("from_id"), c("to_id"), code_ev(c("line")), seq("3", path, c("line")), F.create_map(F.lit("specifier"), c("specifier"))),
        edge(call, "calls", F.coalesce("caller_id", "mod_id"), c("to_id"), code_ev(c("line")), seq("3", path, c("line"))),
        edge(value.where("role = 'test'"), "tested_by", c("sym_id"), c("from_id"), ev(path, c("line"), null, F.lit("test")), seq("4", path, c("line"))),
        edge(value.where("role = 'test'"), "covers", c("from_id"), c("sym_id"), ev(path, c("line"), null, F.lit("test")), seq("4", path, c("line"))),
        edge(docs, "belongs_to", doc_id, repo, doc_ev, seq("4", path)), edge(adr, "decides", doc_id, dec_id, doc_ev, seq("5", path)),
        edge(in_context, "belongs_to", doc_id, F.concat(F.lit("bc:"), slugify("bounded_context")), doc_ev, seq("5", path)),
        edge(docs.select("rel_path", F.explode("capabilities").alias("v")), "documents", doc_id, F.concat(F.lit("cap:"), slugify("v")), doc_ev, seq("5", path, c("v"))),
        edge(docs.select("rel_path", F.explode("invariants").alias("v")), "documents", doc_id, F.concat(F.lit("inv:"), slugify("v")), doc_ev, seq("5", path, c("v"))),
        edge(docs.select("rel_path", F.explode("contradicts").alias("v")), "contradicts", doc_id, F.concat(F.lit("doc:"), "v"), doc_ev, seq("5", path, c("v"))),
        edge(made, "belongs_to", mig_id, repo, mig_ev, seq("6", path)), edge(limits, "related_to", mig_id, F.concat(F.lit("inv:"), slug), code_ev(c("line")), seq("7", path, c("line"))),
    ]
    for tag, (prefix, kind, relation) in what.items():
        m = mark.where(c("tag") == tag)
        tags = no_tags if tag == "boundedContext" else F.array(F.lit("from-code"))
        nodes.append(node(m, F.concat(F.lit(prefix), slug), F.lit(kind), c("slug"), null.cast("string"), code_ev(c("start_line")), seq("3", path, c("ord")), tags=tags, meta=said))
        edges.append(edge(m, relation, c("id"), F.concat(F.lit(prefix), slug), code_ev(c("start_line")), seq("3", path, c("ord"))))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id(F.col("kind"), F.col("from_id"), F.col("to_id")))
