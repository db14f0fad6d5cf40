from datetime import datetime, timedelta

from ripplegraph.operators.snapshots import snapshot_changes
from ripplegraph.operators.versions import delivered_snapshots, one_per_commit, with_positions

T0 = datetime(2024, 1, 1)
SNAP = "snapshot_id string, repository_identity string, commit_id string, captured_at timestamp_ntz"
ROW = "snapshot_id string, id string, name string, tags array<string>, metadata map<string,string>, delivered_at timestamp_ntz, idx int, change string"


def at(days):
    return T0 + timedelta(days=days)


def row(s, i, name="n", tags=None, meta=None, day=0):
    return (s, i, name, tags, meta, at(day), 1, "x")


def changes(spark, snaps, data):
    n = spark.createDataFrame(data, ROW)
    return snapshot_changes(spark.createDataFrame(snaps, SNAP), {"nodes": n}, n)


SNAPS = [("s3", "r", "c3", at(3)), ("s1", "r", "c1", at(1)), ("s2", "r", "c2", at(2)), ("s2", "r", "c2", at(2)), ("never", "r", "c9", at(2.5))]


def test_added_removed_changed_and_back(spark, rows):
    data = [row("s1", "a"), row("s2", "a", "other"), row("s3", "a", "other"), row("s1", "b"), row("s3", "b"), row("s2", "c")]
    assert rows(changes(spark, SNAPS, data)) == sorted([("s2", "nodes", "a", "changed"), ("s2", "nodes", "b", "removed"), ("s3", "nodes", "b", "added"), ("s2", "nodes", "c", "added"), ("s3", "nodes", "c", "removed")], key=repr)


def test_sets_have_no_order_and_null_is_empty(spark, rows):
    data = [row("s1", "a", tags=["x", "y", "x"], meta={"p": "1", "q": None}), row("s2", "a", tags=["y", "x"], meta={"q": None, "p": "1"}), row("s1", "b", tags=None, meta=None), row("s2", "b", tags=[], meta={}), row("s3", "a", tags=["y", "x"], meta={"p": "1", "q": ""}), row("s3", "b")]
    assert rows(changes(spark, SNAPS, data)) == [("s3", "nodes", "a", "changed")]


def test_null_differs_from_empty_and_latest_delivery_counts(spark, rows):
    data = [row("s1", "a", name=None), row("s2", "a", name=""), row("s2", "a", name="late", day=5), row("s3", "a", name="late"), row("s3", "a", name="late"), row("s1", None), row(None, "a"), row("zz", "a")]
    assert rows(changes(spark, SNAPS, data)) == [("s2", "nodes", "a", "changed")]


def test_last_capture_of_a_commit_and_undelivered_snapshots(spark):
    snaps = [*SNAPS, ("s2b", "r", "c2", at(2.2))]
    n = spark.createDataFrame([row(s, "a") for s in ("s1", "s2", "s2b", "s3")], ROW)
    got = with_positions(one_per_commit(delivered_snapshots(spark.createDataFrame(snaps, SNAP), n)))
    assert [(r.snapshot_id, r.next_id) for r in got.orderBy("idx").collect()] == [("s1", "s2b"), ("s2b", "s3"), ("s3", None)]


def test_empty(spark, rows):
    assert rows(changes(spark, [], [])) == [] and rows(changes(spark, SNAPS, [])) == []
