"""Parent links to full hierarchies: Euler tours ranked in parallel.

Rows (group, node, parent) form trees of unknown depth, possibly with circles.

1. Nodes are numbered in the order (group, length of node, node), in ranges,
   so that neighbours in a tree mostly share a block. A group of any size is
   cut into several blocks.
2. Leaves are peeled, first inside each block, then on what is left; nodes that
   never become leaves are on circles. Their parent link is cut, which turns
   the rest into a forest.
3. Each node has two arcs, down and up; an arc's successor follows the tour
   around its tree. Blocks contract the stretches of a tour that stay inside
   them; only the links between blocks are ranked across the cluster.
4. Ranks give entry and exit positions, and with them depth, root and number
   of descendants. Sweeping the nodes in entry order yields the paths: the
   ancestors of a partition's first node are those whose interval spans it.

No step holds a whole group in one task: the number of blocks follows from the
counted rows, so that a block has about ROWS_PER_BLOCK of them at any size.
What crosses blocks is ranked in one task only while it is at most `bound`
rows, beyond that by pointer jumping over the cluster, whose rounds grow with
the logarithm of the rows.

Edge cases: a null, blank or unknown parent makes a root; spaces around ids do
not belong to them; of several rows of one node the last by `order` counts;
rows with a null or blank node are left out; a null group is a group of its
own; an empty table gives an empty table. Needs spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.session import materialise, n_partitions

#: Rows that one task may rank or peel alone (16 to 48 bytes each).
BOUND = 2_000_000
#: Rows that a block aims at; a Python worker holds one block at a time, some 100 bytes a row.
ROWS_PER_BLOCK = 500_000
#: Ancestors of the partitions' first nodes that may be broadcast.
OPENING = 200_000
_BLOCK = 33  # monotonically_increasing_id() has the partition above this bit
TRIM = r"(?U)^\s+|\s+$"


def number_nodes(rows: DataFrame, group: str, node: str, parent: str, order: list, partitions: int) -> DataFrame:
    """id, grp, node, parent of each distinct node; ids ascend with (group, length, node)."""
    trimmed = rows.select(F.col(group).alias("grp"), F.regexp_replace(node, TRIM, "").alias("node"), F.regexp_replace(parent, TRIM, "").alias("parent"), F.struct(*order).alias("o"))
    last = trimmed.where(F.col("node") != "").groupBy("grp", "node").agg(F.max_by("parent", "o").alias("parent"))
    ranged = materialise(last).repartitionByRange(partitions, "grp", F.length("node"), "node").sortWithinPartitions("grp", F.length("node"), "node")
    return materialise(ranged.withColumn("id", F.monotonically_increasing_id()))


def link_parents(nodes: DataFrame) -> DataFrame:
    """(id, pid): pid is the parent's id, or -1 for a root."""
    # a key no node has, spread by id, so that roots don't gather in one task
    missing = F.concat(F.lit("\x00"), (F.col("id") % 997).cast("string"))
    child = nodes.select("id", F.coalesce("grp", F.lit("\x00")).alias("grp"), F.when(F.col("parent").isNull() | (F.col("parent") == ""), missing).otherwise(F.col("parent")).alias("node"))
    target = nodes.select(F.coalesce("grp", F.lit("\x00")).alias("grp"), "node", F.col("id").alias("pid"))
    return child.join(target, ["grp", "node"], "left").select("id", F.coalesce("pid", F.lit(-1)).alias("pid"))


def _peel_locally(ids: np.ndarray, pids: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """Mask of the nodes left after peeling leaves; `blocked` nodes have children elsewhere."""
    n = len(ids)
    order = np.argsort(ids)
    sorted_ids = ids[order]
    at = np.minimum(np.searchsorted(sorted_ids, pids), max(n - 1, 0))
    parent = np.where((n > 0) & (sorted_ids[at] == pids), order[at], -1) if n else np.empty(0, np.int64)
    waiting = np.bincount(parent[parent >= 0], minlength=n) + blocked.astype(np.int64)
    left = np.ones(n, bool)
    leaves = np.flatnonzero(waiting == 0)
    while len(leaves):
        left[leaves] = False
        up = parent[leaves]
        up = up[up >= 0]
        np.subtract.at(waiting, up, 1)
        up = np.unique(up)
        leaves = up[(waiting[up] == 0) & left[up]]
    return left


def circle_nodes(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """Ids of the nodes on circles. `links` is partitioned by block."""
    b = F.shiftright(F.col("id"), _BLOCK).alias("b")
    crossing = links.where((F.col("pid") >= 0) & (F.shiftright(F.col("pid"), _BLOCK) != F.shiftright(F.col("id"), _BLOCK)))
    told = crossing.select(F.col("pid").alias("id")).distinct().select(b, "id", F.lit(-1).cast("long").alias("pid"), F.lit(True).alias("blocked"))
    marked = links.select(b, "id", "pid", F.lit(False).alias("blocked")).unionAll(told)

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        told, own = pdf.loc[pdf["blocked"], "id"].to_numpy(), pdf.loc[~pdf["blocked"], ["id", "pid"]]
        ids = own["id"].to_numpy()
        return own.loc[_peel_locally(ids, own["pid"].to_numpy(), np.isin(ids, told))]

    core = materialise(marked.groupBy("b").applyInPandas(peel, "id long, pid long"))
    size = core.count()
    if size == 0:
        return core.select("id")
    if size <= bound:
        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if parts:
                pdf = pd.concat(parts)
                ids, pids = pdf["id"].to_numpy(), pdf["pid"].to_numpy()
                yield pd.DataFrame({"id": ids[_peel_locally(ids, pids, np.zeros(len(ids), bool))]})

        return materialise(core.coalesce(1).mapInPandas(finish, "id long"))
    # After 2^k >= size jumps along parent links, exactly the nodes of circles are still arrived at.
    jump = core.select("id", F.col("pid").alias("to"))
    for _ in range(max(1, int(size).bit_length())):
        nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        jump = materialise(jump.join(nxt, "to", "inner").select("id", F.col("to2").alias("to")).where(F.col("to") >= 0))
    return materialise(jump.select(F.col("to").alias("id")).distinct())


# Arcs: 2*id goes down to a node, 2*id+1 comes up from it. A target below 0 is
# the end of a tour and names its root: -(root id) - 1.


def _successors(ids: np.ndarray, pids: np.ndarray, first_far: np.ndarray, next_far: np.ndarray) -> np.ndarray:
    """Successor of arcs [down..., up...] of a block's nodes.

    first_far: first child in other blocks, or -1. next_far: for the last node
    of a run of siblings, the first sibling of the next run, or -1.
    """
    n = len(ids)
    order = np.lexsort((ids, pids))
    same = np.zeros(n, bool)
    same[:-1] = (pids[order][1:] == pids[order][:-1]) & (pids[order][1:] >= 0)
    sibling = np.full(n, -1, np.int64)
    sibling[order[:-1]] = np.where(same[:-1], ids[order][1:], -1)
    by_id = np.argsort(ids)
    pos = np.minimum(np.searchsorted(ids[by_id], pids), n - 1)
    local = (ids[by_id][pos] == pids) & (pids >= 0)
    first = np.full(n, -1, np.int64)
    starts = order[np.r_[True, ~same[:-1]]]
    starts = starts[local[starts]]
    first[by_id[pos[starts]]] = ids[starts]
    first = np.where(first >= 0, first, first_far)
    # the last of a parent's local children goes on to the parent's far children
    far_of_parent = np.where(local, first_far[by_id[pos]], -1)
    onward = np.where(local, far_of_parent, next_far)
    sibling = np.where(sibling >= 0, sibling, onward)
    down = np.where(first >= 0, 2 * first, 2 * ids + 1)
    up = np.where(sibling >= 0, 2 * sibling, np.where(pids >= 0, 2 * pids + 1, -ids - 1))
    return np.r_[down, up]


def _contract(arcs: np.ndarray, succ: np.ndarray, depth: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every arc: the first arc outside `arcs` that its tour reaches, and the weights up to there."""
    n = len(arcs)
    order = np.argsort(arcs)
    at = np.minimum(np.searchsorted(arcs[order], succ), n - 1)
    nxt = np.where((succ >= 0) & (arcs[order][at] == succ), order[at], -1)
    target, depth, count = succ.copy(), depth.copy(), count.copy()
    for _ in range(max(1, int(n).bit_length() + 1)):
        go = np.flatnonzero(nxt >= 0)
        if not len(go):
            break
        to = nxt[go]
        depth[go] += depth[to]
        count[go] += count[to]
        target[go] = target[to]
        nxt[go] = nxt[to]
    return target, depth, count


_TOUR = "id long, kind int, down_to long, down_depth long, down_count long, up_to long, up_depth long, up_count long"


def euler_ranks(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(id, root, depth, size, entry) of a forest given as (id, pid); entry ascends along the tour of a root."""
    block = lambda c: F.shiftright(F.col(c), _BLOCK)
    far = links.where((F.col("pid") >= 0) & (block("pid") != block("id"))).groupBy("pid", block("id").alias("b")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    runs = far.withColumn("next", F.lead("first").over(Window.partitionBy("pid").orderBy("b")))
    heads = far.groupBy(F.col("pid").alias("id")).agg(F.min_by("first", "b").alias("first_far"))
    tails = runs.where(F.col("next").isNotNull()).select(F.col("last").alias("id"), F.col("next").alias("next_far"))
    entered = far.select(F.col("first").alias("id"))
    # what other blocks have to tell a block travels with its rows: one exchange, no joins
    say = lambda df, kind, v: df.select(block("id").alias("b"), "id", F.col(v).alias("v"), F.lit(kind).alias("k"))
    rows = say(links, 0, "pid").unionAll(say(heads, 1, "first_far")).unionAll(say(tails, 2, "next_far")).unionAll(say(entered, 3, "id"))

    def tour(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ids, v, k = pdf["id"].to_numpy(), pdf["v"].to_numpy(), pdf["k"].to_numpy()
        order = np.argsort(all_ids[k == 0])
        ids, pids = all_ids[k == 0][order], v[k == 0][order]
        n = len(ids)
        first_far, next_far, entered = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int32)
        first_far[np.searchsorted(ids, all_ids[k == 1])] = v[k == 1]
        next_far[np.searchsorted(ids, all_ids[k == 2])] = v[k == 2]
        entered[np.searchsorted(ids, all_ids[k == 3])] = 1
        succ = _successors(ids, pids, first_far, next_far)
        arcs = np.r_[2 * ids, 2 * ids + 1]
        one = np.ones(n, np.int64)
        to, depth, count = _contract(arcs, succ, np.r_[one, -one], np.r_[one, np.zeros(n, np.int64)])
        # kind: 1 its down arc, 2 its up arc is entered from another block
        kind = entered + 2 * (first_far >= 0).astype(np.int32)
        return pd.DataFrame({"id": ids, "kind": kind, "down_to": to[:n], "down_depth": depth[:n], "down_count": count[:n], "up_to": to[n:], "up_depth": depth[n:], "up_count": count[n:]})

    tours = materialise(rows.groupBy("b").applyInPandas(tour, _TOUR))
    links_between = tours.where("(kind & 1) = 1").select((F.col("id") * 2).alias("arc"), F.col("down_to").alias("to"), F.col("down_depth").alias("d"), F.col("down_count").alias("c")).unionAll(tours.where("(kind & 2) = 2").select((F.col("id") * 2 + 1).alias("arc"), F.col("up_to").alias("to"), F.col("up_depth").alias("d"), F.col("up_count").alias("c")))
    ranks = _rank(links_between, bound)
    open_ = tours.where("down_to >= 0 or up_to >= 0")
    closed = tours.where("down_to < 0 and up_to < 0")
    r1 = ranks.select(F.col("arc").alias("down_to"), F.col("to").alias("t1"), F.col("d").alias("d1"), F.col("c").alias("c1"))
    r2 = ranks.select(F.col("arc").alias("up_to"), F.col("to").alias("t2"), F.col("d").alias("d2"), F.col("c").alias("c2"))
    # targets below 0 have no rank; they are told apart by id so that they don't share a key
    resolved = open_.join(r1, "down_to", "left").join(r2, "up_to", "left").select("id", F.coalesce("t1", "down_to").alias("down_to"), (F.col("down_depth") + F.coalesce("d1", F.lit(0))).alias("down_depth"), (F.col("down_count") + F.coalesce("c1", F.lit(0))).alias("down_count"), (F.col("up_count") + F.coalesce("c2", F.lit(0))).alias("up_count"))
    full = closed.select("id", "down_to", "down_depth", "down_count", "up_count").unionAll(resolved)
    # sums run from an arc to the end of its tour, where the depth is 0 again
    return full.select("id", (-F.col("down_to") - 1).alias("root"), (1 - F.col("down_depth")).alias("depth"), (F.col("down_count") - F.col("up_count") - 1).alias("size"), (-F.col("down_count")).alias("entry"))


def _rank(between: DataFrame, bound: int) -> DataFrame:
    """(arc, to, d, c) with every `to` followed to the end of its tour."""
    between = materialise(between)
    size = between.count()
    schema = "arc long, to long, d long, c long"
    if size <= bound:
        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if parts:
                pdf = pd.concat(parts)
                arcs = pdf["arc"].to_numpy()
                to, d, c = _contract(arcs, pdf["to"].to_numpy(), pdf["d"].to_numpy(), pdf["c"].to_numpy())
                yield pd.DataFrame({"arc": arcs, "to": to, "d": d, "c": c})

        return between.coalesce(1).mapInPandas(finish, schema)
    done = None
    while not between.where("to >= 0").isEmpty():
        jump = between.select(F.col("arc").alias("to"), F.col("to").alias("t2"), F.col("d").alias("d2"), F.col("c").alias("c2"))
        moved = between.where("to >= 0").join(jump, "to").select("arc", F.col("t2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), (F.col("c") + F.col("c2")).alias("c"))
        done = between.where("to < 0")
        between = materialise(moved.unionAll(done))
    return between


_PATHS = "grp string, node string, root_node string, root long, entry long, depth long, size long, path string, role string"


def sweep_paths(nodes: DataFrame, partitions: int, joiner: str = "/", opening_bound: int = OPENING) -> DataFrame:
    """Paths of nodes (id, grp, node, root, depth, size, entry, role) by a sweep in entry order."""
    ranged = materialise(nodes.repartitionByRange(partitions, "root", "entry").sortWithinPartitions("root", "entry").withColumn("p", F.spark_partition_id()))
    # one row a partition: its first node
    edges = ranged.groupBy("p").agg(F.min(F.struct("root", "entry")).alias("f")).select(F.col("p").alias("at"), F.col("f.root").alias("root"), F.col("f.entry").alias("first"))
    spanning = materialise(ranged.where(F.col("size") > 0).join(F.broadcast(edges), "root").where((F.col("entry") < F.col("first")) & (F.col("first") <= F.col("entry") + F.col("size"))).select("at", "root", "entry", "size", "node"))
    columns = ["grp", "node", "root", "entry", "size", "depth", "role"]
    if spanning.count() > opening_bound:
        # deep trees: a partition and the ancestors of its first node meet in one task, none of them on the driver
        return ranged.select("p", *columns).groupBy("p").cogroup(spanning.select(F.col("at").alias("p"), *[F.col(c).alias(f"above_{c}") for c in ("entry", "size", "node")]).groupBy("p")).applyInPandas(lambda own, above: _sweep_together(own, above, joiner), _PATHS)
    opening = spanning.groupBy("at", "root").agg(F.array_sort(F.collect_list(F.struct("entry", "size", "node"))).alias("above"))
    opening = edges.join(opening, ["at", "root"], "left").select(F.col("at").alias("p"), F.col("root").alias("r0"), F.col("first").alias("e0"), "above")
    fed = ranged.join(F.broadcast(opening), "p", "left").withColumn("above", F.when((F.col("root") == F.col("r0")) & (F.col("entry") == F.col("e0")), F.col("above"))).select(*columns, "above")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Sweep(joiner)
        for pdf in batches:
            yield state.paths(pdf, pdf["above"])

    return fed.mapInPandas(sweep, _PATHS)


class _Sweep:
    """The ancestors of the node the sweep is at, as (last entry below, path)."""

    def __init__(self, joiner: str):
        self.joiner, self.root, self.stack, self.root_node = joiner, None, [], None

    def paths(self, pdf: pd.DataFrame, aboves) -> pd.DataFrame:
        paths, roots = [], []
        for node, r, entry, size, above in zip(pdf["node"], pdf["root"], pdf["entry"], pdf["size"], aboves):
            if r != self.root:
                self.root, self.stack, self.root_node = r, [], None
                for x in above if above is not None else ():
                    self._open(x["entry"] + x["size"], x["node"])
            while self.stack and self.stack[-1][0] < entry:
                self.stack.pop()
            if size:
                path = self._open(entry + size, node)
            else:
                path = f"{self.stack[-1][1]}{self.joiner}{node}" if self.stack else node
                self.root_node = self.root_node or node
            paths.append(path)
            roots.append(self.root_node)
        return pd.DataFrame({"grp": pdf["grp"], "node": pdf["node"], "root_node": roots, "root": pdf["root"], "entry": pdf["entry"], "depth": pdf["depth"], "size": pdf["size"], "path": paths, "role": pdf["role"]})

    def _open(self, last: int, node: str) -> str:
        path = f"{self.stack[-1][1]}{self.joiner}{node}" if self.stack else node
        self.root_node = self.root_node or node
        self.stack.append((last, path))
        return path


def _sweep_together(own: pd.DataFrame, above: pd.DataFrame, joiner: str) -> pd.DataFrame:
    # a side without rows comes without columns
    if not len(own):
        return pd.DataFrame({c.split()[0]: [] for c in _PATHS.split(", ")})
    own = own.sort_values(["root", "entry"])
    first = above.rename(columns=lambda c: c.removeprefix("above_")).sort_values("entry").to_dict("records") if len(above) else []
    state = _Sweep(joiner)
    return state.paths(own, [first if i == 0 and first else None for i in range(len(own))])


def hierarchy(rows: DataFrame, group: str, node: str, parent: str, order: list, bound: int = BOUND, partitions: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """grp, node, root_node, depth, size, path, role, tour, entry of every node.

    The descendants of a node are those with the same `tour` whose `entry` lies
    in (entry, entry + size]; entries of a tour ascend in preorder.

    role is `none` in a tree, `on` for a node of a circle and `below` for one
    that hangs on a circle; for the last two root_node and path are '' and depth
    and size -1. `order` decides which of several rows of a node counts.

    `rows` is counted first (for a table, from its files' footers); there are
    at least `partitions` blocks, and more as soon as that many would hold more
    than `rows_per_block` rows each. The steps run while the plan is made.
    """
    p = max(partitions or n_partitions(rows.sparkSession), -(-rows.count() // rows_per_block))
    nodes = number_nodes(rows, group, node, parent, order, p)
    links = materialise(link_parents(nodes))
    circles = circle_nodes(links, bound).withColumn("circle", F.lit(True))
    cut = links.join(circles, "id", "left").select("id", F.when(F.col("circle"), F.lit(-1)).otherwise(F.col("pid")).alias("pid"))
    ranks = euler_ranks(cut, bound)
    on = circles.select(F.col("id").alias("root"), F.lit(True).alias("hangs"))
    full = nodes.select("id", "grp", "node").join(ranks, "id").join(on, "root", "left")
    role = F.when(F.col("hangs").isNull(), "none").when(F.col("root") == F.col("id"), "on").otherwise("below")
    full = full.select("grp", "node", "root", "depth", "size", "entry", role.alias("role"))
    none = F.col("role") == "none"
    swept = sweep_paths(full, p, opening_bound=min(bound, OPENING))
    return swept.select("grp", "node", F.when(none, F.col("root_node")).otherwise("").alias("root_node"), F.when(none, F.col("depth")).otherwise(-1).alias("depth"), F.when(none, F.col("size")).otherwise(-1).alias("size"), F.when(none, F.col("path")).otherwise("").alias("path"), "role", F.col("root").alias("tour"), "entry")


def interval_blocks(nodes: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The rows of `nodes` with (level, block): entries [lo, hi) as the fewest aligned blocks of 2^level entries each, at most two a level."""
    # block numbers covered whole at a level (entries may be negative); one that its pair doesn't complete is not covered a level higher
    low, high = F.expr("shiftright(_lo + shiftleft(1L, _k) - 1, _k)"), F.expr("shiftright(_hi, _k)")
    levels = nodes.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).where("_lo < _hi").withColumn("_k", F.explode(F.expr("sequence(0, cast(ceil(log2(_hi - _lo + 1)) as int))")))
    ends = levels.withColumns({"_a": low, "_b": high}).where("_a < _b")
    blocks = F.array_compact(F.array(F.when(F.col("_a") % 2 != 0, F.col("_a")), F.when(F.col("_b") % 2 != 0, F.col("_b") - 1)))
    return ends.withColumn("block", F.explode(blocks)).withColumnRenamed("_k", "level").drop("_lo", "_hi", "_a", "_b")


def entry_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of `nodes` with every (level, block) that holds their entry, of the levels that `blocks` uses (some dozens at most)."""
    return nodes.crossJoin(F.broadcast(blocks.select("level").distinct())).withColumn("block", F.expr("shiftright(entry, level)"))


def descendants(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(grp, ancestor, node, distance) below the nodes of `queries` (grp, node).

    The intervals of the asked nodes are cut into aligned blocks of entries and
    met there by the nodes inside, in an equi-join that gives each pair once;
    nothing is compared within a tree.
    """
    nodes = nodes.where("role = 'none'").select("grp", "node", "depth", "size", "tour", "entry")
    asked = queries.select(F.col("grp").alias("asked_grp"), F.col("node").alias("ancestor")).distinct()
    known = nodes.where("size > 0").withColumnRenamed("depth", "top")
    known = known.join(asked, known["grp"].eqNullSafe(asked["asked_grp"]) & (known["node"] == asked["ancestor"])).select("tour", "ancestor", "top", "entry", "size")
    blocks = interval_blocks(known, F.col("entry") + 1, F.col("entry") + F.col("size") + 1).drop("entry", "size")
    inside = entry_blocks(nodes.select("grp", "node", "depth", "tour", "entry"), blocks)
    return inside.join(blocks, ["tour", "level", "block"]).select("grp", "ancestor", "node", (F.col("depth") - F.col("top")).alias("distance"))
