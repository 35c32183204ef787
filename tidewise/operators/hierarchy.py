"""Hierarchies of series: edges `parent, child`, their closure, reconciliation, consistency and evaluation.

Edges are a table like any other. All pairs of a node and what is above it come by pointer doubling: each round joins every node's
pointer 2^k levels up with what is known there, so a hierarchy of depth d takes log2(d) rounds, and no edge comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.functions import metrics as mt
from tidewise.storage import cut

#: How far sums of the same numbers in different orders may be apart, as a part of the sum of their sizes.
ROUNDING = 1e-12
AGGREGATES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "min": F.min, "max": F.max}


def checked(edges: DataFrame) -> DataFrame:
    """Distinct edges; raises if a child is its own parent or has two."""
    edges = edges.select("parent", "child").distinct()
    bad = edges.withColumn("_n", F.count("*").over(Window.partitionBy("child"))).where((F.col("_n") > 1) | (F.col("parent") == F.col("child"))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['child']!r} has itself or two nodes as parent")
    return edges


def ancestors(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """`node, above, dist, share`: every node with each node above it, how many levels up, and the product of the edges' `weight` on the way.

    Raises on a cycle: a pointer that still leads somewhere after more levels than there are edges never ends.
    """
    own = F.lit(1.0) if weight is None else F.col(weight)
    jumps = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("above"), own.alias("share")))
    most = jumps.count()
    pairs, length = jumps.select("node", "above", F.lit(1).cast("long").alias("dist"), "share"), 1
    while True:
        up = jumps.select("node", F.col("above").alias("mid"), F.col("share").alias("_s"))
        further = pairs.select(F.col("node").alias("mid"), "above", (F.col("dist") + length).alias("dist"), "share")
        pairs = cut(pairs.unionByName(up.join(further, "mid").select("node", "above", "dist", (F.col("_s") * F.col("share")).alias("share"))))
        jumps = cut(up.join(jumps.select(F.col("node").alias("mid"), "above", "share"), "mid").select("node", "above", (F.col("_s") * F.col("share")).alias("share")))
        length *= 2
        if jumps.isEmpty():
            return pairs
        if length > most:
            raise ValueError("the hierarchy has a cycle")


def levels(edges: DataFrame) -> DataFrame:
    """`node, level`: how many nodes are above each; raises on a cycle, a self-loop or a child with two parents."""
    edges = checked(edges)
    below = ancestors(edges).groupBy("node").agg(F.max("dist").alias("level"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    return below.unionByName(roots.select("node", F.lit(0).cast("long").alias("level")))


def closure(edges: DataFrame) -> DataFrame:
    """`node, leaf`: the leaves under each node, a leaf under itself."""
    edges = checked(edges)
    leaves = edges.select(F.col("child").alias("leaf")).join(edges.select(F.col("parent").alias("leaf")), "leaf", "left_anti")
    under = ancestors(edges).select(F.col("node").alias("leaf"), F.col("above").alias("node")).join(leaves, "leaf", "left_semi")
    return under.select("node", "leaf").union(leaves.select(F.col("leaf").alias("node"), "leaf"))


def bottom_up(forecasts: DataFrame, edges: DataFrame, value: str = "yhat", agg: str = "sum") -> DataFrame:
    """Every node's forecast from its leaves'; series outside the hierarchy pass through. Means are means of leaves."""
    pairs = closure(edges)
    known = forecasts.select("unique_id", "ds", value)
    inside = known.join(pairs, known["unique_id"] == pairs["leaf"]).groupBy(F.col("node").alias("unique_id"), "ds").agg(AGGREGATES[agg](value).alias(value))
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("unique_id")).distinct()
    return inside.unionByName(known.join(nodes, "unique_id", "left_anti"))


def shares(edges: DataFrame, history: DataFrame) -> DataFrame:
    """`root, node, share`: products along the path of each child's part of its siblings' history. A parent without history raises."""
    edges = checked(edges)
    leaf_sums = history.groupBy("unique_id").agg(F.sum("y").alias("total"))
    totals = closure(edges).join(leaf_sums, F.col("leaf") == F.col("unique_id"), "left").groupBy("node").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    own = edges.join(totals, F.col("child") == F.col("node"))
    sums = own.groupBy("parent").agg(F.sum("total").alias("all"))
    if not sums.where(F.abs("all") < 1e-12).isEmpty():
        raise ValueError("a parent has no history to share out")
    part = own.join(sums, "parent").select("parent", "child", (F.col("total") / F.col("all")).alias("part"))
    roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")
    below = ancestors(part, "part").select(F.col("above").alias("root"), "node", "share").join(roots, "root", "left_semi")
    return roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("share")).unionByName(below)


def top_down(forecasts: DataFrame, edges: DataFrame, history: DataFrame, value: str = "yhat") -> DataFrame:
    """Roots' forecasts shared out by history; series outside the hierarchy pass through."""
    known = forecasts.select("unique_id", "ds", value)
    split = shares(edges, history)
    inside = known.join(split, known["unique_id"] == split["root"]).select(F.col("node").alias("unique_id"), "ds", (F.col(value) * F.col("share")).alias(value))
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("unique_id")).distinct()
    return inside.unionByName(known.join(nodes, "unique_id", "left_anti"))


def reconcile(forecasts: DataFrame, edges: DataFrame, method: str, history: DataFrame | None = None, value: str = "yhat", exog_agg: dict[str, str] | None = None) -> DataFrame:
    """Coherent forecasts by `bottom_up` or `top_down`; with `exog_agg`, covariates are gathered upwards by column."""
    if method == "top_down":
        if history is None:
            raise ValueError("top_down needs the history")
        out = top_down(forecasts, edges, history, value)
    elif method == "bottom_up":
        out = bottom_up(forecasts, edges, value)
    else:
        raise ValueError("method must be bottom_up or top_down")
    for column, agg in (exog_agg or {}).items():
        out = out.join(bottom_up(forecasts, edges, column, agg), ["unique_id", "ds"], "full")
    return out


def check_consistency(forecasts: DataFrame, edges: DataFrame, value: str = "yhat", atol: float = 1e-8, rtol: float = 0.0) -> DataFrame:
    """`unique_id, child, ds, reason, parent_value, children_sum, diff`: missing nodes, and times where the sum is off.

    A sum is off if it differs by more than `atol` plus `rtol` times the sum of the children's sizes; sums over tasks have no fixed
    order, so that large values that do agree differ in their last digits.
    """
    present = forecasts.select("unique_id").distinct()
    edges = edges.select("parent", "child").distinct()
    no_parent = edges.select(F.col("parent").alias("unique_id")).distinct().join(present, "unique_id", "left_anti").select("unique_id", F.lit(None).cast("string").alias("child"), F.lit("missing_parent").alias("reason"))
    known = edges.join(present.withColumnRenamed("unique_id", "parent"), "parent", "left_semi")
    no_child = known.join(present.withColumnRenamed("unique_id", "child"), "child", "left_anti").select(F.col("parent").alias("unique_id"), "child", F.lit("missing_child").alias("reason"))
    whole = known.join(no_child.select(F.col("unique_id").alias("parent")).distinct(), "parent", "left_anti")
    sums = whole.join(forecasts.select(F.col("unique_id").alias("child"), "ds", F.col(value).alias("v")), "child").groupBy(F.col("parent").alias("unique_id"), "ds").agg(F.sum("v").alias("children_sum"), F.sum(F.abs("v")).alias("_size"))
    off = forecasts.select("unique_id", "ds", F.col(value).alias("parent_value")).join(sums, ["unique_id", "ds"]).withColumn("diff", F.col("parent_value") - F.col("children_sum"))
    off = off.where(F.abs("diff") > F.lit(float(atol)) + rtol * F.col("_size")).withColumn("reason", F.lit("sum_mismatch"))
    return off.unionByName(no_parent.unionByName(no_child), allowMissingColumns=True).select("unique_id", "child", "ds", "reason", "parent_value", "children_sum", "diff")


def evaluate_hierarchy(forecasts: DataFrame, edges: DataFrame, method: str, history: DataFrame | None = None, observed: DataFrame | None = None, value: str = "yhat") -> DataFrame:
    """Reconcile, check and score: `level, n_points, n_series, n_timestamps, mae, rmse, mape, smape, n_inconsistent`, over all (level null) and by level.

    `observed` (unique_id, ds, y) has the values of any nodes; missing ones of inner nodes are sums of their leaves. Metrics are over
    rows with a value, counts over all reconciled rows. Series outside the hierarchy have level -1. One pass of grouping sets.
    """
    found = cut(reconcile(forecasts, edges, method, history, value))
    if observed is None:
        known = found.select("unique_id", "ds", F.lit(None).cast("double").alias("y")).limit(0)
    else:
        sums = bottom_up(observed.withColumnRenamed("y", value), edges, value).withColumnRenamed(value, "_sum")
        known = sums.join(observed.select("unique_id", "ds", "y"), ["unique_id", "ds"], "full").select("unique_id", "ds", F.coalesce("y", "_sum").alias("y"))
    off = check_consistency(found, edges, value, rtol=ROUNDING).groupBy("unique_id").agg(F.count("*").alias("_off"))
    rows = found.join(known, ["unique_id", "ds"], "left").join(levels(edges).withColumnRenamed("node", "unique_id"), "unique_id", "left")
    rows = rows.withColumn("level", F.coalesce("level", F.lit(-1).cast("long")))
    scored = rows.withColumn("yhat", F.col(value)).groupingSets([[], [F.col("level")]], F.col("level")).agg(
        F.count("*").alias("n_points"), F.countDistinct("unique_id").alias("n_series"), F.countDistinct("ds").alias("n_timestamps"),
        *(m().alias(n) for n, m in (("mae", mt.mae), ("rmse", mt.rmse), ("mape", mt.mape), ("smape", mt.smape))),
    )
    wrong = off.join(levels(edges).withColumnRenamed("node", "unique_id"), "unique_id", "left").groupingSets([[], [F.col("level")]], F.col("level")).agg(F.sum("_off").alias("n_inconsistent"))
    return scored.join(wrong.withColumnRenamed("level", "_level"), F.col("level").eqNullSafe(F.col("_level")), "left").drop("_level").withColumn("n_inconsistent", F.coalesce("n_inconsistent", F.lit(0)))
