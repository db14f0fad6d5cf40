from datetime import datetime

from ripplegraph.llm.streaming import stream_co_change
from tests.test_streaming import run  # noqa: F401


def test_co_change_counts_late_and_repeated_commits_once(run):  # noqa: F811
    d = lambda day: datetime(2024, 1, day)
    batches = [[("c1", ["a", "b", "a"], d(2)), ("c1", ["a", "b"], d(2)), ("c2", ["b", "a", None], d(3))], [("c3", ["z"], datetime(2024, 6, 1))], [("c4", ["z"], datetime(2024, 6, 2))]]
    got = run(batches, "commit_id string, files array<string>, committed_at timestamp", stream_co_change, "append")
    assert [r[1:] for g in got for r in g] == [("a", "b", 2)]
