from pyspark.sql import functions as F

from ripplegraph.operators.extract import classify_path, extract_documents, extract_migrations, is_excluded, parse_front_matter, parse_markers


def test_front_matter(spark):
    t = ["---\na: 1\nb: [x, 'y', \"z\" ]\na: two:three\n: no\nplain\nempty: []\n---\nbody\r\nmore", "---\r\nk: 'v'\r\n---\r\n", "---\n---\nrest", "---\nk: v\nno end", "no\n---\nk: v\n---", "", None, "--- \nk:\n---  ", "---\nk: v\n----\nj: w\n---"]
    got = {r.i: r for r in parse_front_matter(spark.createDataFrame(list(enumerate(t)), "i int, text string"), "i").collect()}
    assert got[0].data == {"a": ["two:three"], "b": ["x", "y", "z"], "empty": []} and got[0].body == "body\nmore" and got[0].body_start_line == 9
    assert got[1].data == {"k": ["v"]} and got[1].body == "" and got[1].body_start_line == 4
    assert (got[2].data, got[2].body, got[2].body_start_line) == ({}, "rest", 3) and (got[3].data, got[3].body, got[3].body_start_line) == ({}, t[3], 1)
    assert got[4].body == t[4] and got[5].body == "" and got[7].data == {"k": [""]} and got[8].data == {"k": ["v"], "j": ["w"]}


def test_documents_migrations_and_markers(spark, rows):
    d = spark.createDataFrame([("d/a.md", "---\ndeprecated: true\n---\nx\n#  Title \n# Other")], "p string, text string")
    assert rows(extract_documents(d, "p"), "title", "type", "deprecated") == [("Title", "doc", True)]
    t, c = extract_migrations(spark.createDataFrame([("m", 'create TABLE if not exists "a" (x);\n-- @Constraint k : v \nCREATE TABLE b(y) -- @constraint n')], "p string, text string"), "p")
    assert rows(t) == [("m", 0, "a"), ("m", 1, "b")] and rows(c) == [("m", 2, "k", "v"), ("m", 3, "n", None)]
    m = parse_markers(spark.createDataFrame([(1, "/** @BoundedContext Sales\n * @risk race-1:  two at once \n * @nothing x\n */"), (2, None), (3, "/** */")], "k int, comment string"), "k")
    assert rows(m) == [(1, 0, "boundedContext", "Sales", None), (1, 1, "risk", "race-1", "two at once")]


def test_paths(spark, rows):
    p = spark.createDataFrame([(x,) for x in ("src/a.ts", "src/a.spec.tsx", "tests/a.ts", "db/migrations/1.ts", "x/1.sql", "r.mdx", "dist/a.ts", "a.js")], "p string")
    assert rows(p.select("p", classify_path(F.col("p")), is_excluded(F.col("p"), ["x/*"]))) == sorted([("src/a.ts", "source", False), ("src/a.spec.tsx", "test", False), ("tests/a.ts", "test", False), ("db/migrations/1.ts", "migration", False), ("x/1.sql", "migration", True), ("r.mdx", "document", False), ("dist/a.ts", "source", True), ("a.js", "other", False)], key=repr)
