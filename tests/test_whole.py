import random
from datetime import datetime

from ripplegraph.operators.control import impact_paths
from ripplegraph.plans import authored_queries, control_queries, graph_queries


def test_integrity_covers_relations_of_every_part(spark, rows, tmp_path):
    spark.range(1, 1201).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "'b' as p_brand", "'t' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 3).selectExpr("id as o_orderkey", "1L as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(control_queries.integrity_violations(spark, str(tmp_path)))
    dangling = [f"p{k}" for k in range(99, 1201, 100)]
    assert sorted(s for r, s in got if r == "relation_from_id_is_element") == sorted(dangling)
    assert sorted(s for r, s in got if r == "relation_to_id_is_element") == sorted([*dangling, "p1201"])


def test_slice_query_goes_beyond_12_ids(spark, rows, tmp_path):
    ids = ["change.a", *(f"goal.g{k:02}" for k in range(20))]
    links = [("s", f"repo.{i}", "symbol", f"sym:{i}") for i in ids]
    spark.createDataFrame(links, "snapshot_id string, owner_id string, kind string, ref string").write.parquet(f"{tmp_path}/sem_links.parquet")
    got = rows(authored_queries.semantic_slice(spark, str(tmp_path)), "seed_set", "id", "hop", "truncated")
    assert got == [("change.a", i, k, False) for k, i in enumerate(ids)]


def impact_by_reference(edges, sources, max_depth):
    """The reference's queue: two paths a destination at any depth, paths of least depth go on."""
    queue, best, found = [(s,) for s in sorted(sources)], {s: 0 for s in sources}, {}
    while queue:
        path = queue.pop(0)
        if len(path) > max_depth:
            continue
        for b in sorted({b for a, b in edges if a == path[-1]} - set(path)):
            if b not in sources and len(found.setdefault(b, [])) < 2:
                found[b].append([*path, b])
            if len(path) <= best.get(b, len(path)):
                best[b] = len(path)
                queue.append((*path, b))
    return sorted(((i, p) for i, ps in found.items() for p in ps), key=repr)


def test_impact_paths_keeps_a_longer_second_path(spark, rows):
    sets = {"short": ["sa", "sb", "ba"], "detour": ["sx", "sa", "sz", "xt", "at", "zt", "tx", "ta", "tz"]}
    # The two first paths to t hold a, so that only a third one can bring a its second path.
    sets["third"] = ["sa", "ab", "ac", "bt", "ct", "sy", "yz", "zt", "ta"]
    rnd = random.Random(5)
    sets |= {f"random{k}": sorted({rnd.choice("sabcdefgh") + rnd.choice("abcdefgh") for _ in range(22)}) for k in range(6)}
    for e in sets.values():
        df = spark.createDataFrame([(a, b, "calls") for a, b in e], "from_id string, to_id string, relation string")
        got = rows(impact_paths(df, spark.createDataFrame([("q", "s")], "source_set string, id string")), "id", "path")
        assert got == impact_by_reference([tuple(x) for x in e], {"s"}, 8)


def graph_at(spark, path, nodes, edges):
    """Tables of one snapshot under ``path``: nodes of (id, kind, exported, tags), edges of (kind, from_id, to_id)."""
    like = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").schema for t in ("snapshots", "nodes", "edges")}
    at = datetime(2024, 1, 1)
    rows = {
        "snapshots": [{"snapshot_id": "s1", "repository_identity": "repo", "commit_id": "c", "captured_at": at}],
        "nodes": [{"snapshot_id": "s1", "id": i, "kind": k, "name": i, "file_path": f"{i}.ts", "exported": x, "tags": t, "evidence": [], "metadata": {}, "delivered_at": at} for i, k, x, t in nodes],
        "edges": [{"snapshot_id": "s1", "id": f"{k}:{a}>{b}", "kind": k, "from_id": a, "to_id": b, "evidence": [], "metadata": {}, "delivered_at": at} for k, a, b in edges],
    }
    for t, x in rows.items():
        spark.createDataFrame(x, like[t]).write.parquet(f"{path}/{t}.parquet")


def test_impact_queries_reach_depth_8(spark, rows, tmp_path):
    f = [f"f{k}" for k in range(10)]
    graph_at(spark, tmp_path, [(i, "function", False, ["critical"] if i == "f0" else []) for i in f], [("calls", a, b) for a, b in zip(f, f[1:])])
    assert rows(control_queries.impact_paths(spark, str(tmp_path)), "path") == [(">".join(f[: k + 1]),) for k in range(1, 9)]
    assert rows(control_queries.impact_reach(spark, str(tmp_path)), "id", "depth") == [(f"f{k}", k) for k in range(1, 9)]


def test_claim_scores_reach_4_hops_over_the_reference_edges(spark, rows, tmp_path):
    nodes = [("f0", "function", False, ["security"])] + [(f"f{k}", "function", False, []) for k in (1, 2, 3)] + [(i, "interface", True, []) for i in "fnrx"]
    graph_at(spark, tmp_path, nodes, [("calls", "f0", "f1"), ("calls", "f1", "f2"), ("calls", "f2", "f3"), ("declares", "f3", "f"), ("declares", "f2", "n"), ("related_to", "f0", "r"), ("imports", "f0", "x")])
    got = rows(graph_queries.claim_scores(spark, str(tmp_path)), "hop", "reachable")
    assert got == sorted([(1, True), (3, True), (4, True), (None, False)], key=repr)
