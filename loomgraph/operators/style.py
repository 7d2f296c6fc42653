"""Masses, sizes, colours and first positions of nodes; colours and ends of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import uniform

#: Half-widths of the squares in which nodes start.
ACCOUNT_SPREAD, TAG_SPREAD = 300.0, 40.0
#: Last creation year of a bucket and its red, green, blue.
EDGE_COLORS = ((2013, 115, 192, 0), (2015, 0, 196, 255), (2017, 223, 137, 255))
EDGE_COLOR_ELSE = (76, 70, 62)


def with_mass(nodes: DataFrame, mode: str = "followers") -> DataFrame:
    """Followers and one for accounts, two for tags; or, by "degree", edges and one. Followers
    that aren't known count as none."""
    if mode == "degree":
        return nodes.withColumn("mass", (F.col("n_edges") + 1).cast("double"))
    return nodes.withColumn("mass", F.when(F.col("kind") == "account", F.coalesce("followers", F.lit(0)) + 1).otherwise(2).cast("double"))


def with_scale(nodes: DataFrame) -> DataFrame:
    """ln(100 followers) for accounts, null without followers; 5 for tags."""
    account = F.when(F.col("followers") > 0, F.log(100.0 * F.col("followers")))
    return nodes.withColumn("scale", F.when(F.col("kind") == "account", account).otherwise(5.0))


def with_color(nodes: DataFrame) -> DataFrame:
    """Accounts are red, tags black."""
    return nodes.withColumns({"r": F.when(F.col("kind") == "account", 1.0).otherwise(0.0), "g": F.lit(0.0), "b": F.lit(0.0)})


def _packed(r: int, g: int, b: int) -> int:
    return r | g << 8 | b << 16 | 255 << 24


def edge_colors(draw: DataFrame, accounts: DataFrame) -> DataFrame:
    """Draw edges with rgba, by the year in which the account was made."""
    color = F.lit(_packed(*EDGE_COLOR_ELSE))
    for year, *rgb in reversed(EDGE_COLORS):
        color = F.when(F.col("year_created") <= year, F.lit(_packed(*rgb))).otherwise(color)
    years = accounts.select(F.col("account_id").alias("src"), "year_created")
    return draw.join(years, "src").withColumn("rgba", color.cast("long")).drop("year_created")


def init_positions(nodes: DataFrame, seed: int = 1, mode: str = "square") -> DataFrame:
    """x and y from a hash of the node id: in a square by kind, or on a circle of radius 2."""
    x, y = (2 * uniform(F.col("node_id"), seed, axis) - 1 for axis in "xy")
    if mode == "circle":
        r = F.sqrt(x * x + y * y)
        return nodes.withColumns({"x": F.when(r == 0, 2.0).otherwise(2 * x / r), "y": F.when(r == 0, 0.0).otherwise(2 * y / r)})
    half = F.when(F.col("kind") == "account", ACCOUNT_SPREAD).otherwise(TAG_SPREAD)
    return nodes.withColumns({"x": half * x, "y": half * y})


def edge_geometry(draw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends' positions of every draw edge."""
    at = nodes.select("node_id", "x", "y")
    a = at.select(F.col("node_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = at.select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return draw.join(a, "src").join(b, "dst")
