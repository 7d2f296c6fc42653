"""Bounds, Morton keys, prefix trees with mass summaries, grid cells, radius neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import common_prefix, morton, uniform
from ..sources.shared import written
from .blocks import BLOCK, block_lists
from .carry import with_before
from .ids import with_dense_id
from .radix import KEY_BITS, SLAB, tree_nodes


def world_bounds(nodes: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return nodes.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def with_morton(nodes: DataFrame, bounds=None) -> DataFrame:
    """Nodes with their 32-bit key; the bounds, one row, are taken from the nodes if not given."""
    bounds = tuple(world_bounds(nodes).first()) if bounds is None else bounds
    return nodes.withColumn("morton", morton(F.col("x"), F.col("y"), bounds))


def spatial_sort(nodes: DataFrame, owned: list[DataFrame] | None = None) -> DataFrame:
    """Nodes with their rank by key: range-partitioned and sorted once."""
    return with_dense_id(nodes, ["morton", "node_id"], "rank", owned)


def adjacent_prefixes(nodes: DataFrame, owned: list[DataFrame] | None = None) -> DataFrame:
    """(morton, next_morton, lcp) of neighbours among the sorted distinct keys. Each key meets
    the one before; what crosses the border of two partitions is carried over it."""
    near = with_before(nodes.select("morton").distinct(), ["morton"], {"morton": "before"}, owned).where("before IS NOT NULL")
    return near.select(F.col("before").alias("morton"), F.col("morton").alias("next_morton"), common_prefix(F.col("before"), F.col("morton")).alias("lcp"))


def prefix_groups(nodes: DataFrame) -> DataFrame:
    """(level, prefix, n, mass, mx, my, kmin, kmax): the distinct keys as leaf buckets, the groups
    of level 32. Shorter prefixes follow from them in radix_tree."""
    m = F.col("mass")
    leaves = nodes.groupBy(F.col("morton").alias("prefix")).agg(
        F.count("*").alias("n"), F.sum(m).alias("mass"), F.sum(m * F.col("x")).alias("mx"), F.sum(m * F.col("y")).alias("my")
    )
    return leaves.select(F.lit(KEY_BITS).alias("level"), "prefix", "n", "mass", "mx", "my", F.col("prefix").alias("kmin"), F.col("prefix").alias("kmax"))


def radix_tree(groups: DataFrame, slab: int = SLAB, owned: list[DataFrame] | None = None) -> DataFrame:
    """(level, prefix, kmin, kmax, mass, cx, cy, n, left_level, left_prefix, right_level,
    right_prefix, size): the internal nodes over the leaf buckets of ``groups``. A chain of
    prefixes with the same keys is one node, named by its deepest. size is twice the largest
    distance from a node's centre to a child's; without mass, centre and size are null."""
    d = tree_nodes(groups.where(F.col("level") == KEY_BITS), slab, owned)
    centre = {c: F.col(m) / F.nullif(F.col("mass"), F.lit(0.0)) for c, m in (("cx", "mx"), ("cy", "my"))}
    d = d.withColumns({**centre, "size": F.nanvl("size", F.lit(None).cast("double"))})
    whole = ("level", "left_level", "right_level")
    return d.withColumns({c: F.col(c).cast("int") for c in whole} | {"n": F.col("n").cast("long")}).drop("mx", "my")


def tree_children(tree: DataFrame) -> DataFrame:
    """(level, prefix, child_level, child_prefix): two rows a node."""
    sides = F.array(*[F.struct(F.col(f"{s}_level").alias("child_level"), F.col(f"{s}_prefix").alias("child_prefix")) for s in ("left", "right")])
    return tree.select("level", "prefix", F.explode(sides).alias("c")).select("level", "prefix", "c.*")


def tree_summary(groups: DataFrame, tree: DataFrame) -> DataFrame:
    """(level, prefix, n, mass, cx, cy, size) of the internal nodes; the tree's pass over its keys
    has them all, so ``groups`` are not read again."""
    return tree.select("level", "prefix", "n", "mass", "cx", "cy", "size")


def with_cell(nodes: DataFrame, radius: float, n: int = 128) -> DataFrame:
    """Cell of an n by n grid over [-radius, radius]^2, null outside; cells are half open,
    the last ones closed."""
    width = 2.0 * radius / n
    axis = lambda c: F.least(F.floor((F.col(c) + radius) / width), F.lit(n - 1)).cast("long")
    inside = F.col("x").between(-radius, radius) & F.col("y").between(-radius, radius)
    return nodes.withColumn("cell_id", F.when(inside, axis("y") * n + axis("x")))


def cell_lists(nodes: DataFrame) -> DataFrame:
    """(cell_id, n, node_ids) of the cells with nodes, for cells known to be small; else cell_blocks."""
    return nodes.where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def cell_blocks(nodes: DataFrame, size: int = BLOCK, owned: list[DataFrame] | None = None) -> DataFrame:
    """(cell_id, block, n, node_ids): the nodes of each cell in blocks of at most ``size``."""
    return block_lists(nodes.where("cell_id IS NOT NULL"), ["cell_id"], "node_id", "node_ids", size, owned)


#: Nodes of one cell that a task meets with as many of another, at least, and the blocks of a cell
#: that is as crowded as the cells of the nodes are on average.
CELL, BLOCKS = 512, 4
#: A cell and those after it; the others have it after them.
_HALF = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def cell_bound(nodes: DataFrame, radius: float) -> int:
    """Nodes of a block, so many that the blocks of a cell do not grow in number with the nodes: a
    node is sent once for each block that it meets."""
    cells = nodes.groupBy(*[F.floor(F.col(c) / radius).cast("long") for c in "xy"]).agg(F.count("*").cast("double").alias("n"))
    crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    return max(CELL, math.ceil((crowd or 0) / BLOCKS))


def counted_cells(nodes: DataFrame, radius: float, bound: int = CELL) -> DataFrame:
    """(gx, gy, n, blocks, ahead, behind): the cells, as wide as the radius, that have nodes. A cell
    of more than ``bound`` nodes is divided into blocks; ahead and behind list the cells of
    either half of the neighbourhood that exist, with their blocks, the cell itself in both;
    those ahead with their nodes."""
    side = lambda c: F.floor(F.col(c) / radius).cast("long")
    cells = nodes.groupBy(side("x").alias("gx"), side("y").alias("gy")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / bound).cast("int"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("o"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(_HALF)])).alias("s")
    reach = cells.select(F.col("gx").alias("x0"), F.col("gy").alias("y0"), F.col("blocks").alias("b0"), steps)
    reach = reach.select("x0", "y0", "b0", "s.o", (F.col("x0") + F.col("s.a")).alias("gx"), (F.col("y0") + F.col("s.b")).alias("gy"))
    met = reach.join(cells.select("gx", "gy", "blocks", "n"), ["gx", "gy"])
    ahead = met.groupBy(F.col("x0").alias("gx"), F.col("y0").alias("gy")).agg(F.collect_list(F.struct("o", "blocks", "n")).alias("ahead"))
    behind = met.groupBy("gx", "gy").agg(F.collect_list(F.struct("o", F.col("b0").alias("blocks"))).alias("behind"))  # at most five
    return cells.join(ahead, ["gx", "gy"]).join(behind, ["gx", "gy"])


#: What two blocks of nodes meet on.
MEET = ["gx", "gy", "o", "bi", "bj"]


def meeting_blocks(nodes: DataFrame, cells: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Rows (i, xi, yi) and (j, xj, yj) with the columns of ``MEET``, equal where a block of one
    cell meets a block of another. No value of them has more than about a block a side."""
    side = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")
    placed = nodes.withColumns({"gx": side("x"), "gy": side("y")}).join(cells, ["gx", "gy"]).withColumn("own", own)
    name = lambda end: [F.col("node_id").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}")]
    blocks = F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1))
    left = placed.select(*name("i"), "gx", "gy", "own", F.explode("ahead").alias("c"))
    left = left.select("i", "xi", "yi", "gx", "gy", F.col("c.o").alias("o"), F.col("own").alias("bi"), blocks.alias("bj"))
    offset = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in _HALF]), F.col("c.o") + 1)
    right = placed.select(*name("j"), "gx", "gy", "own", F.explode("behind").alias("c"))
    right = right.select("j", "xj", "yj", (F.col("gx") - offset(0)).alias("gx"), (F.col("gy") - offset(1)).alias("gy"), F.col("c.o").alias("o"), blocks.alias("bi"), F.col("own").alias("bj"))
    return left, right


#: Pairs of nodes, and rows, that a task meets at most, about.
TASK_PAIRS, TASK_ROWS = 1 << 22, 1 << 20


def meeting_tasks(cells: DataFrame) -> int:
    """Tasks for the pairs that meet. Their number follows from the pairs, not from bytes: rows are
    few and small where their pairs are many."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v)
    met, sent = F.col("n") * add(F.col("ahead.n")), F.col("n") * (add(F.col("ahead.blocks")) + add(F.col("behind.blocks")))
    pairs, rows = cells.agg(F.coalesce(F.sum(met), F.lit(0)), F.coalesce(F.sum(sent), F.lit(0))).first()
    return max(1, math.ceil(pairs / TASK_PAIRS), math.ceil(rows / TASK_ROWS))


def neighbors_within(nodes: DataFrame, radius: float, bound: int | None = None, owned: list[DataFrame] | None = None) -> DataFrame:
    """(i, j, dx, dy, distance): ordered pairs nearer than the radius. Cells are counted first. A
    node then meets the cells of half its neighbourhood that have nodes, block by block: an
    equi-join in which no key has more than about ``bound`` rows a side, however many nodes
    share a cell, in as many tasks as the pairs ask for. Every pair is met once and then
    mirrored. Without a bound it follows from how crowded cells are: pairs grow with their
    square by definition, what is shuffled with the nodes."""
    d = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("node_id", "x", "y")
    cells = written(counted_cells(d, radius, bound or cell_bound(d, radius)), "cells")
    if owned is not None:
        owned.append(cells)
    tasks = meeting_tasks(cells)
    left, right = (side.repartition(tasks, *MEET) for side in meeting_blocks(d, cells, radius))
    both = left.join(right, MEET).where("i <> j AND (o > 0 OR i < j)")
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    both = both.select("i", "j", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("distance")).where(F.col("distance") < radius)
    ways = F.array(F.struct("i", "j", "dx", "dy"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))
    return both.select("distance", F.explode(ways).alias("w")).select("w.i", "w.j", "w.dx", "w.dy", "distance")


#: Radii and strengths: avoid other families, avoid the own family, pull the own family.
FAMILY = {"diff_radius": 2.67, "diff_push": 1.82, "same_radius": 0.5, "same_push": 8.98, "pull_radius": 2.411, "pull": 0.335}


def family_force(pairs: DataFrame, families: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """(node_id, fx, fy) from neighbour pairs and (node_id, family). The push falls linearly
    to nothing at the avoid radius; coincident nodes are pushed apart in a direction that
    their ids give; the own family pulls inside the pull radius."""
    p = FAMILY | (params or {})
    fam = families.select("node_id", "family")
    d = pairs.join(fam.select(F.col("node_id").alias("i"), F.col("family").alias("fi")), "i")
    d = d.join(fam.select(F.col("node_id").alias("j"), F.col("family").alias("fj")), "j")
    same = F.col("fi") == F.col("fj")
    radius = F.when(same, p["same_radius"]).otherwise(p["diff_radius"])
    push = F.when(same, p["same_push"]).otherwise(p["diff_push"])
    far = F.col("distance")
    key = F.concat_ws("-", F.least("i", "j"), F.greatest("i", "j"))
    angle = uniform(key, 1, "angle") * 6.283185307179586
    sign = F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0)
    ux = F.when(far > 0, F.col("dx") / far).otherwise(sign * F.cos(angle))
    uy = F.when(far > 0, F.col("dy") / far).otherwise(sign * F.sin(angle))
    strength = F.when(far < radius, push * (1 - far / radius)).otherwise(0.0)
    strength = strength - F.when(same & (far < p["pull_radius"]) & (far > 0), p["pull"]).otherwise(0.0)
    return d.groupBy(F.col("i").alias("node_id")).agg(F.sum(ux * strength).alias("fx"), F.sum(uy * strength).alias("fy"))
