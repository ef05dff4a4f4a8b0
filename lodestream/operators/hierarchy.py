"""Parent links to full hierarchies: loops exposed by peeling leaves, trees ranked as Euler tours.

1. Peeling. With g = f^(2^k) the image of g holds the nodes of height 2^k or more, so squaring g on its own image peels
   2^k layers of leaves a round; what stays is exactly the loops. The domain shrinks with every round.
2. Each loop is opened at its smallest member, which makes a forest.
3. Euler tour. Every non-root node has an arc down and an arc up; the arcs' successors follow from first child and next
   sibling. Children of a parent with very many are linked in salted groups, the groups then chained.
4. Parallel list ranking by pointer jumping gives each arc its distance to the tour's end, its remaining sum of +1/-1,
   and the tree's root. Arcs leave the work once they reach the end, whole tours once their first arc has.
Entry and exit of a node give depth, number of descendants and, by interval containment, ancestors and descendants.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: Children beyond which a parent's sibling links are made in salted groups.
HOT_CHILDREN, SALTS = 100_000, 64


def _loops(links: DataFrame) -> DataFrame:
    """(x, y): the links between members of loops, by peeling 2^k layers of leaves in round k."""
    g, size = links, links.count()
    while size:
        image = g.select(F.col("y").alias("x")).distinct()
        inner = g.join(image, "x", "left_semi")
        g = cut(inner.alias("a").join(g.alias("b"), F.col("a.y") == F.col("b.x")).select("a.x", "b.y"))
        left = g.count()
        if left == size:
            break
        size = left
    return links.join(g.select("x"), "x", "left_semi")


def _loop_labels(loops: DataFrame, ids: DataFrame) -> DataFrame:
    """(x, label): the smallest id, as a string, of the loop that x is in; windows of 2^k members until none changes."""
    g = cut(loops.join(ids.select(F.col("node").alias("x"), F.col("id").alias("m")), "x"))
    while True:
        b = g.select(F.col("x").alias("y"), F.col("y").alias("y2"), F.col("m").alias("m2"))
        g = cut(g.join(b, "y").select("x", F.col("y2").alias("y"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("changed")))
        if not g.where("changed").limit(1).count():
            return g.select("x", F.col("m").alias("label"))
        g = g.drop("changed")


def _arcs(tree: DataFrame) -> DataFrame:
    """(arc, next, tail, r, s) of the forest (x, p): arc 2x goes down to x, 2x+1 back up; tail is the root where next is null."""
    hot = tree.groupBy("p").count().where(F.col("count") > HOT_CHILDREN).select("p", F.lit(True).alias("hot"))
    # at most one row for HOT_CHILDREN links
    t = tree.join(F.broadcast(hot), "p", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("x"), F.lit(SALTS))).otherwise(0)
    )
    t = t.withColumn("sibling", F.lead("x").over(Window.partitionBy("p", "salt").orderBy("x")))
    heads = t.where("hot").groupBy("p", "salt").agg(F.min("x").alias("head"))
    heads = heads.select("p", "salt", F.lead("head").over(Window.partitionBy("p").orderBy("salt")).alias("following"))
    t = t.join(heads, ["p", "salt"], "left").withColumn("sibling", F.coalesce("sibling", "following"))
    t = t.select("x", "p", "sibling", "salt")
    first = t.groupBy("p").agg(F.min(F.struct("salt", "x")).alias("f")).select(F.col("p").alias("x"), F.col("f.x").alias("child"))
    inner = tree.select(F.col("x").alias("p"), F.lit(True).alias("inner"))
    t = t.join(first, "x", "left").join(inner, "p", "left")
    down = F.struct((F.col("x") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("x") * 2 + 1).alias("next"), F.lit(None).cast("bigint").alias("tail"), F.lit(1).alias("w"))
    up = F.struct((F.col("x") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.when(F.col("inner"), F.col("p") * 2 + 1)).alias("next"), F.when(F.col("sibling").isNull() & F.col("inner").isNull(), F.col("p")).alias("tail"), F.lit(-1).alias("w"))
    both = t.select(F.explode(F.array(down, up)).alias("a")).select("a.*")
    # an arc down to a root's first child begins a tour
    heads = first.join(tree.select("x"), "x", "left_anti").select((F.col("child") * 2).alias("arc"), F.lit(True).alias("begins"))
    both = both.join(heads, "arc", "left")
    return both.select("arc", "next", "tail", F.lit(1).cast("bigint").alias("r"), F.col("w").cast("bigint").alias("s"), F.coalesce("begins", F.lit(False)).alias("begins"))


def _ranked(arcs: DataFrame) -> DataFrame:
    """(arc, tail, r, s, begins): distance to the end, remaining sum and root of every arc, by pointer jumping."""
    live, finished = cut(arcs), []
    active = live.where("next IS NOT NULL").count()
    while active:
        b = live.select(F.col("arc").alias("next"), F.col("next").alias("n2"), F.col("tail").alias("t2"), F.col("r").alias("r2"), F.col("s").alias("s2"))
        moving, resting = live.where("next IS NOT NULL"), live.where("next IS NULL")
        moved = moving.join(b, "next").select("arc", F.col("n2").alias("next"), F.col("t2").alias("tail"), (F.col("r") + F.col("r2")).alias("r"), (F.col("s") + F.col("s2")).alias("s"), "begins")
        live = cut(moved.unionByName(resting))
        counts = live.agg(F.count("next").alias("active"), F.count("*").alias("all")).first()
        active = counts.active
        if active and active < counts["all"] / 3:
            over = live.where("begins AND next IS NULL").select("tail")
            finished.append(live.join(over, "tail", "left_semi").select(live.columns))
            live = cut(live.join(over, "tail", "left_anti").select(live.columns))
    out = live
    for f in finished:
        out = out.unionByName(f)
    return out.drop("next")


def hierarchy(df: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(key, parent, root, depth, entry, exit, descendants, in_loop), one row a distinct key.

    root: the last node reached along parent links; depth: links followed. A parent that is null, blank or not among the
    keys ends the walk. Where the walk enters a loop, depth is -1, root the smallest key (as a string) of the loop's
    members, and in_loop tells members from those that lead into it. entry and exit number the tree's tour: y descends
    from x where both have one root and x.entry < y.entry and y.exit < x.exit (a root has entry 0). In a tree opened from
    a loop they hold for the tree below the loop's smallest member.

    Rows repeated for a key count once (should they disagree, the smallest parent holds); null keys are left out; an empty
    table gives an empty result; other columns are ignored.
    """
    blank = F.trim(F.col(parent).cast("string")) == ""
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.when(~blank, F.col(parent))).alias("parent"))
    ids = cut(cut(rows).withColumn("node", F.monotonically_increasing_id()))
    at = ids.select(F.col("id").alias("parent"), F.col("node").alias("y"))
    links = cut(ids.where("parent IS NOT NULL").join(at, "parent").select(F.col("node").alias("x"), "y"))
    loops = cut(_loops(links))
    tree = links
    labels = None
    if loops.limit(1).count():
        labels = cut(_loop_labels(loops, ids))
        opened = labels.join(ids.select(F.col("node").alias("x"), "id"), "x").where("id = label").select("x")
        tree = cut(links.join(opened, "x", "left_anti"))
    ranked = _ranked(_arcs(tree.withColumnRenamed("y", "p")))
    node = F.shiftright("arc", 1)
    is_down = F.col("arc") % 2 == 0
    by_node = ranked.groupBy(node.alias("node")).agg(
        F.max("tail").alias("root_node"),
        F.max(F.when(is_down, F.col("r"))).alias("down"),
        F.max(F.when(~is_down, F.col("r"))).alias("up"),
        F.max(F.when(is_down, 1 - F.col("s"))).alias("depth"),
    )
    lengths = ranked.where("begins").select(F.col("tail").alias("root_node"), F.col("r").alias("length"))
    placed = by_node.join(lengths, "root_node", "left").select(
        "node", "root_node", "depth", (F.col("length") - F.col("down") + 1).alias("entry"), (F.col("length") - F.col("up") + 1).alias("exit")
    )
    roots = lengths.select(F.col("root_node").alias("node"), "root_node", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("entry"), (F.col("length") + 1).alias("exit"))
    known = placed.unionByName(roots)
    out = ids.join(known, "node", "left").withColumns(
        {"root_node": F.coalesce("root_node", "node"), "depth": F.coalesce("depth", F.lit(0)), "entry": F.coalesce("entry", F.lit(0)), "exit": F.coalesce("exit", F.lit(1))}
    )
    named = ids.select(F.col("node").alias("root_node"), F.col("id").alias("root"))
    out = out.join(named, "root_node")
    if labels is None:
        out = out.withColumns({"in_loop": F.lit(False), "looped": F.lit(False)})
    else:
        members = labels.select(F.col("x").alias("node"), F.lit(True).alias("in_loop"))
        below = labels.join(ids.select(F.col("node").alias("x"), F.col("id").alias("root")), "x").where("root = label").select("root", F.lit(True).alias("looped"))
        out = out.join(members, "node", "left").join(below, "root", "left")
    looped = F.coalesce("looped", F.lit(False))
    return out.select(
        F.col("id").alias(key), "parent", "root", F.when(looped, F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        "entry", "exit", F.floor((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint").alias("descendants"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"),
    )


def paths(tree: DataFrame, key: str = "id") -> DataFrame:
    """(key, path): the keys from the root down to each node, of a result of hierarchy().

    Nodes are range-partitioned by (root, entry) and swept with a stack; what a partition's first node hangs below is
    found by interval containment, so a tree may span any number of partitions.
    """
    laid = cut(tree.select(key, "root", "entry", "exit").repartitionByRange("root", "entry").sortWithinPartitions("root", "entry"))
    part = laid.withColumn("part", F.spark_partition_id())
    first = part.groupBy("part").agg(F.min(F.struct("root", "entry", "exit")).alias("f")).select("part", "f.*")
    above = (
        laid.alias("t")
        .join(F.broadcast(first.alias("f")), F.expr("t.root = f.root AND t.entry < f.entry AND t.exit > f.exit"))  # one row a partition
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("t.entry", "t.exit", f"t.{key}"))).alias("stack"))
    )
    started = part.join(F.broadcast(first.select("part", F.col("entry").alias("e0"), F.col("root").alias("r0"))), "part")
    at_first = started.where("entry = e0 AND root = r0").join(above, "part", "left").select("root", "entry", "stack")

    def sweep(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple] = []
        root = None
        for f in frames:
            out = []
            for k, r, e, x, begin in zip(f[key], f["root"], f["entry"], f["exit"], f["stack"], strict=True):
                if begin is not None:
                    stack, root = [(int(s["exit"]), s[key]) for s in begin], r
                elif r != root:
                    stack, root = [], r
                while stack and stack[-1][0] < e:
                    stack.pop()
                stack.append((int(x), k))
                out.append([s[1] for s in stack])
            yield pd.DataFrame({key: f[key], "path": out})

    swept = laid.join(F.broadcast(at_first), ["root", "entry"], "left").sortWithinPartitions("root", "entry")
    kind = tree.schema[key].dataType
    return swept.mapInPandas(sweep, T.StructType([T.StructField(key, kind), T.StructField("path", T.ArrayType(kind))]))


def descendants(tree: DataFrame, wanted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(ancestor, key): every node below each node, or below each wanted key (a column named like key).

    The pairs are those of paths(), so a node meets its own ancestors only, never the rest of its tree. Where links lead
    into a loop, they are followed once around: every other member of the loop is an ancestor too, no node its own.
    """

    def pairs(d: DataFrame) -> DataFrame:
        return paths(d, key).select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("ancestor"), key)

    tree = cut(tree)
    looped = tree.where("depth = -1")
    out = pairs(tree.where("depth >= 0"))
    if looped.limit(1).count():
        # the opened tree has only part of the pairs with members of its loop
        members = tree.where("in_loop").select(F.col(key).alias("ancestor"), "root")
        around = members.join(looped.select(key, "root"), "root").where(F.col("ancestor") != F.col(key)).select("ancestor", key)
        out = out.unionByName(around.unionByName(pairs(looped)).distinct())
    if wanted is None:
        return out
    return out.join(wanted.select(F.col(key).alias("ancestor")).distinct(), "ancestor", "left_semi")
