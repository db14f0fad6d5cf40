from pyspark.sql import functions as F

from ripplegraph.functions.hashing import canonical_json, canonical_map, fingerprint, hunk_identity, is_safe_path, json_text
from ripplegraph.functions.ids import fnv1a, slugify
from ripplegraph.operators.observed import observed_hunks, structural

PATCH = b"diff --git a/x.ts b/x.ts\nindex 000000..abc123\n--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,2 @@ f\n a\r\n-b\n+c\n\\ No newline at end of file\n@@ -9 +9,0 @@\n-z\ndiff --git a/g b/g\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-q"


def test_patches(spark, rows):
    bad = {"more": b"--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n-b\n", "less": b"--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-a\n", "bare": b"@@ -1 +1 @@\n", "odd": b"--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n?\n"}
    df = spark.createDataFrame([("p", bytearray(PATCH)), ("e", bytearray()), ("n", None), *((k, bytearray(v)) for k, v in bad.items())], "patch_id string, data binary")
    h = observed_hunks(df)
    assert rows(h.where("error is null"), "path", "old_start", "old_lines", "new_start", "new_lines", "old_blob", "new_blob") == [("g", 1, 1, 0, 0, None, None), ("x.ts", 1, 2, 1, 2, None, "abc123"), ("x.ts", 9, 1, 9, 0, None, "abc123")]
    assert {r[0] for r in rows(h.where("error is not null"), "patch_id")} == set(bad)
    assert [len(r.hunks) for r in structural(h).orderBy("path").collect()] == [1, 2]
    assert b"".join(bytes(r.raw) for r in h.where("path = 'x.ts'").orderBy("old_start").collect()) == PATCH[PATCH.index(b"@@") : PATCH.index(b"diff --git a/g")]


def test_identity_depends_on_every_part(spark):
    base = dict(repository="repo:r", path="a/b.txt", old_start=1, old_lines=2, new_start=1, new_lines=2, old_blob=None, new_blob="abc", raw=b"-a\n+b\n")

    def of(**change):
        v = base | change
        lit = {k: F.lit(x).cast("string") if x is None else F.lit(x) for k, x in v.items()}
        return spark.range(1).select(hunk_identity(**lit, magic=b"HUNKFRM0")).first()[0]

    changes = [{}, {"repository": "repo:s"}, {"path": "a/c.txt"}, {"old_start": 2**32 - 1}, {"old_lines": 1}, {"new_start": 0}, {"new_lines": 9}, {"old_blob": ""}, {"new_blob": None}, {"raw": b"-a\n"}]
    ids = [of(**c) for c in changes]
    assert len(set(ids)) == len(ids) and all(len(i) == 71 for i in ids) and of() == ids[0]


def test_hashes_and_slugs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fnv1a(F.lit("mod:a->mod:b"))) == "8a96afdb"
    assert [one(slugify(F.lit(t))) for t in ("Héllo, Wörld!", "—", "x" * 99, " a--b ")] == ["hello-world", "empty", "x" * 60, "a-b"]
    assert one(canonical_json(b=F.lit("1"), a=json_text(F.lit('q"\\')), c=F.lit(None).cast("string"))) == '{"a":"q\\"\\\\","b":1}'
    assert one(canonical_map(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit(None).cast("string")))) == '{"a":null,"z":"1"}'
    assert [one(is_safe_path(F.lit(p))) for p in ("a/b", "", "/a", "C:x", "a//b", "a/../b", "./a", "a.b/..c", "a\\..")] == [True, False, False, False, False, False, False, True, False]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    prints = [fingerprint(x, [], F.col("k"), F.col("v"), "d:v1").first()[0] for x in (df, df.orderBy(F.desc("k")).repartition(3), df.where("k < 3"))]
    assert prints[0] == prints[1] != prints[2]
