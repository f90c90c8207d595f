"""Trees given as (node, parent), of any depth: roots, ancestors, crumbs, cascades.

Nothing is read off the form of a code, and no step is taken level by level: pointers
to parents are doubled, so a tree of depth d takes about log2(d) rounds, each one
join that is written before the next. A parent that has no row of its own is a
root. A pointer that is still on its way after log2(number of nodes) rounds goes in a
circle: such nodes are found and named, and never followed further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise


def _whole(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent): one row for each node, the parents without a row too."""
    own = edges.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"), F.count_distinct(parent).alias("parents"))
    own = own.withColumn("parent", F.when(F.col("parents") > 1, F.raise_error(F.concat(F.lit("a node has several parents: "), F.col("node").cast("string")))).otherwise(F.col("parent"))).drop("parents")
    above = own.select(F.col("parent").alias("node")).filter("node is not null").distinct().join(own.select("node"), "node", "left_anti")
    return own.unionByName(above.withColumn("parent", F.lit(None).cast(own.schema["parent"].dataType)))


def lifted(edges: DataFrame, node: str = "node", parent: str = "parent", marked: Column | None = None) -> DataFrame:
    """(node, root, depth, marked): the root of each node, how many steps it is away, and whether the node or one above it is marked.

    The root is null, and the depth too, for nodes in a circle and those that hang
    below one. `marked` is a condition on the rows of `edges`. A node may be repeated
    with the same parent; with another one, it is an error. The rounds run when this is
    called.
    """
    whole = _whole(edges, node, parent)
    if marked is None:
        flags = whole.withColumn("marked", F.lit(False))
    else:
        named = edges.filter(marked).select(F.col(node).alias("node")).distinct().withColumn("marked", F.lit(True))
        flags = whole.join(named, "node", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    now = materialise(flags.select("node", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"), "marked"))
    rounds = max(1, now.count().bit_length())
    for _ in range(rounds):
        if now.filter("up is not null").isEmpty():
            break
        above = now.select(F.col("node").alias("up"), *[F.col(c).alias(f"{c}_up") for c in ("up", "root", "depth", "marked")])
        joined = now.join(above, "up", "left")
        now = materialise(joined.select(
            "node", F.col("up_up").alias("up"), F.coalesce("root_up", "root").alias("root"), (F.col("depth") + F.coalesce("depth_up", F.lit(0))).alias("depth"), (F.col("marked") | F.coalesce("marked_up", F.lit(False))).alias("marked"),
        ))
    ended = F.col("up").isNull()
    return now.select("node", F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("depth")).alias("depth"), "marked")


def circles(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node): the nodes from which no root is reached."""
    return lifted(edges, node, parent).filter("root is null").select("node")


def ancestors(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance): all nodes above each node; nodes from which no root is reached have none.

    A round joins the pairs that are exactly as far apart as the round reaches with
    all pairs found so far, so each pair is made once.
    """
    reached = lifted(edges, node, parent).filter("root is not null")
    deepest = reached.agg(F.max("depth")).first()[0] or 0
    steps = _whole(edges, node, parent).join(reached.select("node"), "node", "left_semi").filter("parent is not null")
    found = materialise(steps.select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    span = 1
    while span < deepest:
        further = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        new = found.filter(F.col("distance") == span).join(further, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        found = materialise(found.unionByName(new))
        span *= 2
    return found


def crumbs(edges: DataFrame, label: str, node: str = "node", parent: str = "parent", between: str = " › ") -> DataFrame:
    """(node, depth, crumbs): the labels from the root down to each node."""
    labels = edges.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("ancestor")).agg(F.min(label).alias("label"))
    own = edges.filter(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("distance")).distinct()
    named = ancestors(edges, node, parent).unionByName(own).join(labels, "ancestor", "left")
    way = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("k"), F.coalesce("label", F.col("ancestor").cast("string")).alias("label"))))
    return named.groupBy("node").agg(F.max("distance").alias("depth"), F.array_join(F.transform(way, lambda x: x["label"]), between).alias("crumbs"))


def cascade(edges: DataFrame, gone: Column, node: str = "node", parent: str = "parent") -> DataFrame:
    """The rows of `edges` that stay when the rows under a condition go with all that hangs below them."""
    down = lifted(edges, node, parent, gone).filter("marked").select(F.col("node").alias(node))
    return edges.join(down, node, "left_anti").select(*edges.columns)
