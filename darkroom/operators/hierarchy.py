"""Parent-child rows as full hierarchies: depth, root, path and descendants of every node, cycles named.

Peeling by doubled jumps exposes the cycles in a logarithmic number of rounds;
the forest that remains is toured (Euler), the tours are contracted onto rulers
and ranked by pointer jumping, and a node's entry and exit give its depth, root,
path and descendants.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators.components import components
from darkroom.operators.skew import lookup
from darkroom.plans.staging import Staging

#: Parts into which the children of one parent are cut, so that no task sorts all children of a parent.
PARTS = 64
#: Lists of more arcs than this are contracted: one of RULER arcs is a ruler, where jumps stop.
CONTRACT, RULER = 200_000, 16
#: Positions of a tour that are turned into paths together, and rows of a task that does so.
STRETCH, BUCKET = 4_096, 50_000


def clean_links(df: DataFrame, node: Column, parent: Column, staging: Staging) -> tuple[DataFrame, DataFrame, int]:
    """(nodes (v), links (v, p), number of links): every node once, and the links to nodes that exist.

    Rows without a node are ignored. Of several links of one node the smallest counts.
    """
    rows, seen = staging.observed(df.select(node.alias("v"), parent.alias("p")).filter("v is not null").groupBy("v").agg(F.min("p").alias("p")))
    nodes = rows.select("v")
    links, kept = staging.observed(lookup(rows.filter("p is not null"), nodes.withColumnRenamed("v", "p"), "p", rows=seen["rows"]).select("v", "p"))
    return nodes, links, kept["rows"]


def cycle_nodes(links: DataFrame, n: int, staging: Staging) -> DataFrame:
    """(v) of the nodes of the ``n`` ``links`` that lie on a cycle.

    After k rounds the jumps are 2^k long and the nodes less than 2^k from a
    root are peeled off. If a round peels none, no node that remains leads to a
    root; from then on the ends of the jumps are counted, and if these are no
    longer fewer than before, they are the cycles' nodes.
    """
    state, ends = links, -1
    while n:
        # Jumps of twice the length; nodes whose chain ends on the way drop out.
        ahead = state.select(F.col("v").alias("k"), "p")
        jumped, seen = staging.observed(lookup(state.withColumnRenamed("p", "k"), ahead, "k", rows=n).select("v", "p"))
        if state is not links:
            staging.drop(state)
        state, left = jumped, seen["rows"]
        if left < n:
            n = left
            continue
        reached = state.select("p").distinct().count()
        if reached == ends:
            break
        ends = reached
    return state.select(F.col("p").alias("v")).distinct()


def euler_arcs(forest: DataFrame) -> DataFrame:
    """The Euler tours of ``forest`` (v, p), as arcs (a, s, w, c, r).

    a is the arc into (``v>``) or out of (``v<``) a node, s its successor (null at the end of a
    tour), w its weight (1 and -1), c counts it, and r is the tour's root on its last arc. A
    parent's children are chained within PARTS parts, and the parts one after the other.
    """
    parted = forest.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    w = Window.partitionBy("p", "part").orderBy("v")
    inner = parted.withColumn("next", F.lead("v").over(w))
    firsts = parted.groupBy("p", "part").agg(F.min("v").alias("first"))
    over = firsts.withColumn("next_part", F.lead("first").over(Window.partitionBy("p").orderBy("part")))
    last = inner.filter("next is null").join(over.select("p", "part", "next_part"), ["p", "part"]).select("v", "p", F.col("next_part").alias("next"))
    chained = inner.filter("next is not null").select("v", "p", "next").unionByName(last)
    first_child = firsts.groupBy("p").agg(F.min_by("first", "part").alias("child"))
    has_arc = forest.select(F.col("v").alias("p"), F.lit(True).alias("inner"))
    down = forest.select("v").join(first_child.withColumnRenamed("p", "v"), "v", "left")
    into = down.select(F.concat("v", F.lit(">")).alias("a"), F.when(F.col("child").isNotNull(), F.concat("child", F.lit(">"))).otherwise(F.concat("v", F.lit("<"))).alias("s"), F.lit(1).cast("long").alias("w"), F.lit(None).cast("string").alias("r"))
    # Of each parent and part only the last child looks up its parent: PARTS rows a parent at most.
    closing = chained.filter("next is null").join(has_arc, "p", "left")
    up = closing.unionByName(chained.filter("next is not null").withColumn("inner", F.lit(None).cast("boolean")).select(closing.columns))
    ends = F.col("next").isNull() & F.col("inner").isNull()
    out = up.select(
        F.concat("v", F.lit("<")).alias("a"),
        F.when(F.col("next").isNotNull(), F.concat("next", F.lit(">"))).when(F.col("inner"), F.concat("p", F.lit("<"))).alias("s"),
        F.lit(-1).cast("long").alias("w"),
        F.when(ends, F.col("p")).alias("r"),
    )
    return into.unionByName(out).withColumn("c", F.lit(1).cast("long"))


def _jump_to_end(state: DataFrame, open_: int, staging: Staging) -> DataFrame:
    """Lists (a, s, w, c, r) by pointer jumping: s null, w and c sums from a to the end of its list, and the list's r."""
    while open_:
        ahead = state.select(F.col("a").alias("s"), F.col("s").alias("s2"), F.col("w").alias("w2"), F.col("c").alias("c2"), F.col("r").alias("r2"))
        # Arcs that haven't reached their end have different successors, so no key repeats.
        moved = state.filter("s is not null").join(ahead, "s").select("a", F.col("s2").alias("s"), (F.col("w") + F.col("w2")).alias("w"), (F.col("c") + F.col("c2")).alias("c"), F.col("r2").alias("r"))
        new, seen = staging.observed(moved.unionByName(state.filter("s is null").select("a", "s", "w", "c", "r")), open=F.count_if(F.col("s").isNotNull()))
        staging.drop(state)
        state, open_ = new, seen["open"]
    return state


def rank_lists(arcs: DataFrame, staging: Staging, contract: int = CONTRACT, level: int = 0) -> DataFrame:
    """(a, w, c, r): sums of w and c from each arc to the end of its list, and the list's r.

    Beyond ``contract`` arcs one of RULER arcs is a ruler. An arc jumps until it
    stands before a ruler or at the end, which few arcs take long to reach; the
    short list of the rulers alone is ranked to the end, and one join gives
    every arc what lies behind its ruler. So most arcs move a few times only,
    however long their list is.
    """
    state, seen = staging.observed(arcs.select("a", "s", "w", "c", "r"), open=F.count_if(F.col("s").isNotNull()))
    if seen["rows"] <= contract:
        return _jump_to_end(state, seen["open"], staging).drop("s")
    ruler = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RULER)) == 0
    # (t: the ruler that the arc stands before, once it has reached one; s: where it jumps from, until then)
    split = lambda df: df.select("a", F.when(~ruler("s"), F.col("s")).alias("s"), F.coalesce("t", F.when(ruler("s"), F.col("s"))).alias("t"), "w", "c", "r")
    short, seen = staging.observed(split(state.withColumn("t", F.lit(None).cast("string"))), open=F.count_if(F.col("s").isNotNull()))
    staging.drop(state)
    open_ = seen["open"]
    while open_:
        ahead = short.select(F.col("a").alias("s"), F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("w").alias("w2"), F.col("c").alias("c2"), F.col("r").alias("r2"))
        moved = short.filter("s is not null").join(ahead, "s").select("a", F.col("s2").alias("s"), F.col("t2").alias("t"), (F.col("w") + F.col("w2")).alias("w"), (F.col("c") + F.col("c2")).alias("c"), F.col("r2").alias("r"))
        new, seen = staging.observed(moved.unionByName(short.filter("s is null")), open=F.count_if(F.col("s").isNotNull()))
        staging.drop(short)
        short, open_ = new, seen["open"]
    rulers = rank_lists(short.filter(ruler("a")).select("a", F.col("t").alias("s"), "w", "c", "r"), staging, contract, level + 1)
    behind = rulers.select(F.col("a").alias("t"), F.col("w").alias("w2"), F.col("c").alias("c2"), F.col("r").alias("r2"))
    # Up to a few hundred arcs stand before one ruler.
    rest = short.filter("t is not null").join(behind, "t").select("a", (F.col("w") + F.col("w2")).alias("w"), (F.col("c") + F.col("c2")).alias("c"), F.col("r2").alias("r"))
    return short.filter("t is null").select("a", "w", "c", "r").unionByName(rest)


def hierarchy(df: DataFrame, node: Column, parent: Column, staging: Staging) -> DataFrame:
    """(v, parent, root, depth, tree, entry, exit, descendants, in_cycle) of every node.

    root is the last node of the chain and depth the number of links to it; the
    root itself has depth 0. A link to a node that doesn't exist, like none,
    ends a chain. Where a chain runs into a circle (a link to oneself is one),
    root is the smallest node of the circle, depth is -1, and entry, exit and
    descendants are those of the tree that hangs on the circle's node. tree is
    the root of that tree. x is y or a descendant of y if both have the same
    tree and y.entry <= x.entry and x.exit <= y.exit. An empty table gives an empty result; other columns are
    not looked at.
    """
    nodes, links, n = clean_links(df, node, parent, staging)
    circle = staging.save(cycle_nodes(links, n, staging))
    names = components(links.join(circle, "v", "left_semi").select(F.col("v").alias("a"), F.col("p").alias("b")), staging)
    forest = staging.save(links.join(circle, "v", "left_anti"))
    ranked = rank_lists(euler_arcs(forest), staging)
    side = ranked.withColumn("v", F.expr("substring(a, 1, length(a) - 1)")).withColumn("into", F.col("a").endswith(">"))
    tour = side.groupBy("v").agg(
        F.max(F.when(F.col("into"), F.col("c"))).alias("from_end"), F.max(F.when(~F.col("into"), F.col("c"))).alias("to_end"),
        F.max(F.when(F.col("into"), F.col("w"))).alias("w"), F.max("r").alias("r"),
    )
    tour = staging.save(tour)
    lengths = tour.groupBy("r").agg(F.max("from_end").alias("total"))
    toured = staging.save(lookup(tour, lengths, "r", rows=n).select("v", "r", (1 - F.col("w")).alias("depth"), (F.col("total") - F.col("from_end") + 1).alias("entry"), (F.col("total") - F.col("to_end") + 1).alias("exit"), ((F.col("from_end") - F.col("to_end") - 1) / 2).cast("long").alias("below"), "total"))
    roots = toured.groupBy("r").agg(F.max("total").alias("total")).select(F.col("r").alias("v"), "total")
    flat = nodes.join(toured.drop("total"), "v", "left").join(roots, "v", "left")
    placed = flat.select("v", F.coalesce("r", "v").alias("r"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("exit", F.coalesce("total", F.lit(0)) + 1).alias("exit"), F.coalesce("below", (F.coalesce("total", F.lit(0)) / 2).cast("long")).alias("descendants"))
    # Trees on circles are few or all of one; the circles' nodes decide, so they are looked up by a shuffle that AQE may split.
    named = placed.join(names.select(F.col("v").alias("r"), "label"), "r", "left")
    return named.join(links, "v", "left").join(circle.withColumn("on", F.lit(True)), "v", "left").select(
        "v", F.col("p").alias("parent"), F.coalesce("label", "r").alias("root"), F.when(F.col("label").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.col("r").alias("tree"), "entry", "exit", "descendants", F.coalesce("on", F.lit(False)).alias("in_cycle"),
    )


def tree_paths(tree: DataFrame) -> DataFrame:
    """(v, path): each node's chain from the root of its tree down to itself, from the intervals of ``hierarchy``.

    A tour is cut into stretches of STRETCH positions. A node goes to the
    stretch of its entry, and to every stretch that starts within its interval:
    those are the ancestors that are open there. Within a stretch one pass over
    the entries, with the open intervals on a stack, gives every path. A stretch
    holds as many rows as it has positions and open ancestors, so a large tree
    is spread over tasks; all that is sent is less than the paths themselves.
    """
    own = tree.select("tree", "v", "entry", "exit", F.expr(f"entry div {STRETCH}").alias("stretch"), F.lit(True).alias("own"))
    open_ = tree.filter(F.expr(f"(exit - 1) div {STRETCH} > entry div {STRETCH}")).select("tree", "v", "entry", "exit", F.explode(F.expr(f"sequence(entry div {STRETCH} + 1, (exit - 1) div {STRETCH})")).alias("stretch"), F.lit(False).alias("own"))
    kind = dict(tree.dtypes)["v"]

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tree", "stretch", "entry"], ignore_index=True)
        names, paths, at, stack = [], [], None, []
        for t, stretch, entry, leave, v, mine in zip(*(frame[c] for c in ("tree", "stretch", "entry", "exit", "v", "own"))):
            if (t, stretch) != at:
                at, stack = (t, stretch), []
            while stack and stack[-1][0] < entry:
                stack.pop()
            stack.append((leave, v))
            if mine:
                names.append(v)
                paths.append([x for _, x in stack])
        return pd.DataFrame({"v": names, "path": paths})

    rows = own.unionByName(open_)
    # Small trees are handled many at a time.
    buckets = max(1, -(-tree.count() // BUCKET))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("tree", "stretch"), F.lit(buckets))).groupBy("bucket").applyInPandas(walk, f"v {kind}, path array<{kind}>")


def descendant_pairs(paths: DataFrame) -> DataFrame:
    """(v, descendant) of every node and each node below it, from ``tree_paths``; as many rows as the depths add up to."""
    return paths.select(F.col("v").alias("descendant"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("v")).select("v", "descendant")
