import pytest

from ripplegraph.operators.orphans import PARENT_ARRIVES, PARENT_LEAVES, REFERENCE_OPENS
from ripplegraph.streaming.intervals import stream_intervals
from ripplegraph.streaming.orphans import stream_orphans


@pytest.fixture
def run(spark, tmp_path):
    def run(batches, schema, operator, mode):
        got = []
        src, k = tmp_path / "in", 0
        src.mkdir()
        stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.append(sorted(map(tuple, df.collect()), key=repr))).start()
        try:
            for b in batches:
                k += 1
                spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
                part = next((tmp_path / f"b{k}").glob("*.parquet"))
                part.rename(src / f"{k}.parquet")
                q.processAllAvailable()
        finally:
            q.stop()
        return [g for g in got if g]

    return run


def test_intervals_close_holes(run):
    got = run([[("a", 1, 3, 1), ("a", 8, 9, 1), ("b", 5, 5, 1), ("b", None, 5, 1)], [("a", 4, 7, 2), ("b", 5, 5, 2)]], "entity string, start long, end long, version long", stream_intervals, "update")
    assert got == [
        [("a", "gap", 4, 7, 1, True), ("a", "period", 1, 3, 1, True), ("a", "period", 8, 9, 1, True), ("b", "period", 5, 5, 1, True)],
        [("a", "gap", 4, 7, 2, False), ("a", "period", 1, 3, 2, False), ("a", "period", 1, 9, 2, True), ("a", "period", 8, 9, 2, False)],
    ]


def test_orphans_resolve_and_reopen(run):
    e = [[("k", 1, REFERENCE_OPENS, "r")], [("k", 4, PARENT_ARRIVES, None)], [("k", 6, PARENT_LEAVES, None)], [("k", 9, PARENT_ARRIVES, None)]]
    assert run(e, "key string, seq long, op int, ident string", stream_orphans, "append") == [[("k", "r", 1, 4)], [("k", "r", 6, 9)]]
