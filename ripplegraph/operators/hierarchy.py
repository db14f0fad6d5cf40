"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.runtime import checkpointed, release

SEPARATOR = " > "


def resolve_hierarchy(links: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, node_id, root_id, depth, path, ids) of every id at an end of a link.

    ``links`` has ``scope``, ``child`` and ``parent``; a scope is one forest and may be null. Links with a null end do
    not count; repeats count once; of several parents of one child the smallest counts. A link from a node to itself is
    a cycle. Nodes on a cycle have root_id '', depth -1, path '' and null ids, nodes below a cycle depth -2. Other
    columns of ``links`` are ignored; an empty table gives an empty result.

    Each round joins the unresolved nodes to the pointers of all nodes and so doubles the distance of every pointer: a
    tree of depth d takes log2(d) + 1 rounds. A node that hangs on a root is resolved from the start, so no round meets a
    root, however many children it has; under another hot parent the join is split by its size. A round writes only the
    nodes it was given, and resolved ones are never written again. No group is ever gathered. If a round resolves nothing no tree node is left; the rest then jumps on, without paths, until
    the set of pointers no longer shrinks, when it is exactly the nodes on cycles.
    """
    l = links.where("child is not null and parent is not null")  # noqa: E741
    l = checkpointed(l.groupBy(F.col(scope).alias("scope"), "child").agg(F.min("parent").alias("parent")))  # noqa: E741
    above = l.select(F.col("scope").alias("s"), F.col("child").alias("n"))
    same = lambda a, x: a["scope"].eqNullSafe(above["s"]) & (a[x] == above["n"])
    tops = l.select("scope", F.col("parent").alias("node")).distinct()
    tops = tops.join(above, same(tops, "node"), "left_anti")
    t = l.join(above, same(l, "parent"), "left").select(
        "scope", F.col("child").alias("node"), F.col("parent").alias("ptr"), F.lit(1).alias("dist"),
        F.array("parent", "child").alias("ids"),  # from ptr to node
        F.col("n").isNull().alias("done"),
    )
    t = checkpointed(t)
    finished = [t.where("done")]
    rest, open_now, open_before = t.where("not done"), t.where("not done").count(), None
    while open_now and open_now != open_before:
        t = checkpointed(_doubled(rest, [*finished, rest], keep_path=True))
        finished.append(t.where("done"))
        rest, open_before = t.where("not done"), open_now
        open_now = rest.count()
    name = lambda node, root, depth, path, ids: (F.col(node).alias("node_id"), root.alias("root_id"), depth.alias("depth"), path.alias("path"), ids.alias("ids"))
    found = [tops.select("scope", *name("node", F.col("node"), F.lit(0), F.col("node"), F.array("node")))]
    found += [x.select("scope", *name("node", F.col("ptr"), F.col("dist"), F.array_join("ids", SEPARATOR), F.col("ids"))) for x in finished]
    if open_now:  # what is left hangs on cycles: jump on until only cycle nodes are pointed at
        rest = checkpointed(rest.select("scope", "node", "ptr", F.lit(0).alias("dist"), F.array().cast("array<string>").alias("ids"), "done"))
        targets = rest.select("scope", "ptr").distinct().count()
        while True:
            last = rest
            rest = checkpointed(_doubled(rest, [rest], keep_path=False))
            release(last)
            before, targets = targets, rest.select("scope", "ptr").distinct().count()
            if targets == before:
                break
        hit = rest.select(F.col("scope").alias("s"), F.col("ptr").alias("p")).distinct()
        x = rest.join(hit, rest["scope"].eqNullSafe(hit["s"]) & (rest["node"] == hit["p"]), "left")
        none = F.lit(None).cast("array<string>")
        found.append(x.select("scope", *name("node", F.lit(""), F.when(F.col("p").isNotNull(), -1).otherwise(-2), F.lit(""), none)))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("scope", scope)


def _doubled(rest: DataFrame, targets: list[DataFrame], keep_path: bool) -> DataFrame:
    """Every unresolved node's pointer replaced by its target's pointer, its path prefixed by the target's."""
    to = reduce(DataFrame.unionByName, targets)
    to = to.select(F.col("scope").alias("s"), F.col("node").alias("n"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("ids").alias("ids2"), F.col("done").alias("done2"))
    if len(targets) > 2:  # a table of rounds has a part for each; as many as a shuffle makes will do
        to = to.coalesce(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rest.join(to, rest["scope"].eqNullSafe(to["s"]) & (rest["ptr"] == to["n"])).select(
        "scope",
        "node",
        F.col("ptr2").alias("ptr"),
        (F.col("dist") + F.col("dist2")).alias("dist"),
        (F.concat("ids2", F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0)))) if keep_path else F.col("ids")).alias("ids"),
        F.col("done2").alias("done"),
    )


def descendants(resolved: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, ancestor_id, node_id, distance): all nodes beneath each node, read off the resolved paths.

    Nodes on or below cycles have no hierarchy and take no part.
    """
    up = resolved.where("depth > 0").select(scope, "node_id", "depth", F.posexplode("ids").alias("pos", "ancestor_id"))
    return up.where("pos < depth").select(scope, "ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))
