"""One query per operator over the given tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import OFFSET, relation, with_ctes
from .operators import approx, checks, forces, generate, graph, ids, spatial, style
from .plans.ingest import build_graph
from .plans.layout import LayoutParams, layout, layout_step
from .schemas import ACCOUNTS_CSV, POSTS_CSV
from .sources import edge_array, files, graphs
from .sources.shared import new_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R, EPS = 1e-6, 0.0025


def query(sql: str | None = None, needs: str = ""):
    """Register the function under its name; ``sql`` is over the relations of ``needs``."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_ctes(needs.split(), sql) if needs else sql
        return f

    return put


def _r(*names: str) -> list:
    return [(F.round(n, 4) + F.lit(0.0)).alias(n) for n in names]


def _texts(df: DataFrame) -> DataFrame:
    """Dates as text: the same in every engine."""
    return df.withColumn("date", F.col("date").cast("string"))


# --- sources ---


@query("SELECT name, followers, year_created FROM accounts", "accounts")
def s1_read_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts written as a file of the input format, with commas, quotes and line breaks
    in columns that aren't kept, and read back."""
    a = relation(spark, d, "accounts")
    tricky = F.concat(F.lit('said "hi", then\nleft '), F.col("account_id").cast("string"))
    filled = {
        "userid": F.col("account_id").cast("string"), "user_display_name": F.col("name"), "user_profile_description": tricky,
        "follower_count": F.col("followers").cast("string"), "account_creation_date": F.concat(F.col("year_created").cast("string"), F.lit("-03-01")),
    }
    path = new_path(spark, "accounts-csv")
    a.select(*[filled.get(c, F.lit("x")).alias(c) for c in ACCOUNTS_CSV.names]).write.option("header", True).option("escape", '"').csv(path)
    return files.read_accounts(spark, path)


@query("SELECT name, CAST(date AS varchar) AS date, coalesce(hashtags, '') AS hashtags FROM posts", "posts")
def s2_read_posts(spark: SparkSession, d: str) -> DataFrame:
    p = relation(spark, d, "posts")
    filled = {
        "user_display_name": F.col("name"), "tweet_time": F.concat(F.col("date").cast("string"), F.lit(" 16:03")),
        "tweet_text": F.lit('a, "b"\nc'), "hashtags": F.col("hashtags"),
    }
    path = new_path(spark, "posts-csv")
    p.select(*[filled.get(c, F.lit(None).cast("string")).alias(c) for c in POSTS_CSV.names]).write.option("header", True).option("escape", '"').csv(path)
    return _texts(files.read_posts(spark, path).withColumn("hashtags", F.coalesce("hashtags", F.lit(""))))


@query("SELECT CAST(date AS varchar) AS date, count(*) AS n FROM occ GROUP BY date", "occ")
def s4_post_date(spark: SparkSession, d: str) -> DataFrame:
    from .functions.text import post_date

    stamp = F.concat(F.col("date").cast("string"), F.lit(" 16:03"))
    return relation(spark, d, "occ").select(post_date(stamp).alias("date")).groupBy("date").agg(F.count("*").alias("n")).select(F.col("date").cast("string").alias("date"), "n")


TAGS = """tags AS (SELECT name, date, ltrim(t) AS hashtag FROM (SELECT name, date,
  unnest(string_split(regexp_replace(coalesce(hashtags, ''), '^\\[|\\]$', '', 'g'), ',')) AS t FROM posts) WHERE ltrim(t) <> '')"""


@query(f"+ {TAGS} SELECT name, CAST(date AS varchar) AS date, hashtag FROM tags", "posts")
def s5_explode_hashtags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(graph.explode_hashtags(relation(spark, d, "posts")))


def _graph(spark: SparkSession, d: str):
    return build_graph(relation(spark, d, "accounts"), relation(spark, d, "posts"))


GRAPH = f"""{TAGS}, named AS (SELECT hashtag AS name, dense_rank() OVER (ORDER BY hashtag) - 1 AS hashtag_id FROM (SELECT DISTINCT hashtag FROM tags)),
ids AS (SELECT name, min(account_id) AS account_id FROM accounts GROUP BY name),
found AS (SELECT account_id, hashtag_id, date FROM tags JOIN ids USING (name) JOIN named ON hashtag = named.name),
gedges AS (SELECT account_id, hashtag_id, count(*) AS weight, count(*) AS n_dates FROM found GROUP BY account_id, hashtag_id)"""


@query(f"+ {GRAPH} SELECT account_id, hashtag_id, weight, n_dates FROM gedges", "posts accounts")
def s6_s7_graph_tables(spark: SparkSession, d: str) -> DataFrame:
    """The graph from posts, written and read back: its edges."""
    path = new_path(spark, "graph")
    graphs.write_graph(_graph(spark, d), path)
    return graphs.read_graph(spark, path, digests=True).edges.select("account_id", "hashtag_id", "weight", "n_dates")


# --- keys and joins ---


@query("SELECT name, min(account_id) AS account_id FROM (SELECT concat('n', account_id % 37) AS name, account_id FROM accounts) GROUP BY name", "accounts")
def j1_account_dictionary(spark: SparkSession, d: str) -> DataFrame:
    a = relation(spark, d, "accounts").select(F.concat(F.lit("n"), (F.col("account_id") % 37).cast("string")).alias("name"), "account_id")
    return graph.account_dictionary(a)


@query(f"+ {GRAPH} SELECT name AS hashtag, hashtag_id FROM named", "posts accounts")
def j2_hashtag_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return graph.hashtag_dictionary(graph.explode_hashtags(relation(spark, d, "posts")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_id FROM lineitem")
def j3_dense_id(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return ids.with_dense_id(rows, ["l_orderkey", "l_linenumber"], "row_id")


@query(
    "SELECT tag, row_number() OVER (ORDER BY first_at, tag) - 1 AS tag_id FROM (SELECT l_partkey AS tag, min((l_orderkey, l_linenumber)) AS first_at FROM lineitem GROUP BY l_partkey)"
)
def j3_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parts numbered in the order in which two batches of orders bring them: as if in one."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("tag"), "l_orderkey", "l_linenumber")
    half = rows.agg(F.max("l_orderkey")).first()[0] / 2
    known = spark.createDataFrame([], "tag bigint, tag_id bigint")
    for batch in (rows.where(F.col("l_orderkey") < half), rows.where(F.col("l_orderkey") >= half)):
        known = written(ids.extend_ids(known, batch, "tag", "tag_id", ["l_orderkey", "l_linenumber"]), "stable-ids")
    return known


@query(f"+ {GRAPH} SELECT account_id, hashtag, CAST(date AS varchar) AS date FROM tags JOIN ids USING (name)", "posts accounts")
def j4_resolve_accounts(spark: SparkSession, d: str) -> DataFrame:
    found = graph.resolve_accounts(graph.explode_hashtags(relation(spark, d, "posts")), graph.account_dictionary(relation(spark, d, "accounts")))
    return _texts(found.select("account_id", "hashtag", "date"))


@query("SELECT name, CAST(date AS varchar) AS date, hashtags FROM posts WHERE name NOT IN (SELECT name FROM accounts WHERE account_id % 5 <> 0)", "posts accounts")
def j5_orphan_posts(spark: SparkSession, d: str) -> DataFrame:
    known = graph.account_dictionary(relation(spark, d, "accounts").where("account_id % 5 <> 0"))
    return graph.orphan_posts(relation(spark, d, "posts"), known).select("name", F.col("date").cast("string").alias("date"), "hashtags")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    tags = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("hashtag_id"), F.col("p_name").alias("name"))
    return graph.build_nodes(relation(spark, d, "accounts"), tags, OFFSET)


KINDS = f"""kinds AS (SELECT account_id AS node_id, 'account' AS kind, name, followers, year_created FROM accounts
  UNION ALL SELECT {OFFSET} + p_partkey, 'hashtag', p_name, NULL, NULL FROM part)"""


@query(f"+ {KINDS} SELECT node_id, kind, name, coalesce(followers, -1) AS followers, coalesce(year_created, -1) AS year_created FROM kinds", "accounts")
def j6_build_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).fillna(-1, ["followers", "year_created"])


DRAW = f"draw AS (SELECT account_id AS src, {OFFSET} + hashtag_id AS dst, weight FROM edges)"
ADJ = f"{DRAW}, adj AS (SELECT src, dst, weight FROM draw UNION ALL SELECT dst, src, weight FROM draw)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_weights(relation(spark, d, "occ"))


@query(f"+ {ADJ} SELECT src, dst, weight FROM adj", "edges")
def j7_mirror_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.mirror_edges(_edges(spark, d), OFFSET)


@query(f"+ {DRAW} SELECT src, dst, weight FROM draw", "edges")
def j8_draw_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.draw_edges(_edges(spark, d), OFFSET)


@query(
    f"+ {DRAW} SELECT src, dst, round(a.x, 4) + 0.0e0 AS x0, round(a.y, 4) + 0.0e0 AS y0, round(b.x, 4) + 0.0e0 AS x1, round(b.y, 4) + 0.0e0 AS y1 "
    "FROM draw JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id", "edges nodes",
)
def j9_edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = style.edge_geometry(graph.draw_edges(_edges(spark, d), OFFSET), relation(spark, d, "nodes"))
    return g.select("src", "dst", *_r("x0", "y0", "x1", "y1"))


# --- aggregations ---


@query("SELECT account_id, hashtag_id, weight, n_dates FROM edges", "edges")
def a1_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("SELECT account_id, hashtag_id, count(*) AS n_dates, array_to_string(list_transform(list_sort(list(date)), lambda x: CAST(x AS varchar)), ',') AS dates FROM occ GROUP BY account_id, hashtag_id", "occ")
def a2_edge_dates(spark: SparkSession, d: str) -> DataFrame:
    lists = graph.edge_date_lists(graph.edge_dates(relation(spark, d, "occ")))
    return lists.select("account_id", "hashtag_id", "n_dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ",").alias("dates"))


_PLACED = "row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1"


@query(
    "SELECT account_id, hashtag_id, p // 2 AS block, count(*) AS n, array_to_string(list(CAST(date AS varchar) ORDER BY date), ',') AS dates FROM "
    f"(SELECT *, {_PLACED.format('account_id, hashtag_id', 'date')} AS p FROM occ) GROUP BY ALL", "occ",
)
def a2_edge_date_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The dates of each edge in blocks: of two, so that edges of these tables have several."""
    blocks = graph.edge_date_blocks(graph.edge_dates(relation(spark, d, "occ")), 2)
    return blocks.select("account_id", "hashtag_id", "block", "n", F.array_join(F.transform("dates", lambda x: x.cast("string")), ",").alias("dates"))


@query(
    "SELECT 'account' AS kind, account_id AS id, count(*) AS n_edges FROM edges GROUP BY account_id "
    "UNION ALL SELECT 'hashtag', hashtag_id, count(*) FROM edges GROUP BY hashtag_id", "edges",
)
def a3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query(
    f"+ {GRAPH} SELECT (SELECT count(*) FROM accounts) AS n_accounts, (SELECT count(*) FROM named) AS n_hashtags, (SELECT count(*) FROM gedges) AS n_edges, "
    "(SELECT count(*) FROM found) AS n_edge_dates, (SELECT sum(strlen(name)) FROM accounts)::BIGINT + (SELECT sum(strlen(name)) FROM named)::BIGINT AS n_name_bytes",
    "posts accounts",
)
def a4_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_summary(_graph(spark, d))


@query(
    "SELECT account_id AS node_id, n_edges, (sum(n_edges) OVER (ORDER BY account_id) - n_edges)::BIGINT AS start_pos, (sum(n_edges) OVER (ORDER BY account_id))::BIGINT AS end_pos "
    "FROM (SELECT a.account_id, count(e.account_id) AS n_edges FROM accounts a LEFT JOIN edges e ON a.account_id = e.account_id GROUP BY a.account_id)",
    "accounts edges",
)
def a5_adjacency_ranges(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.with_degree(relation(spark, d, "accounts").select("account_id"), _edges(spark, d), "account_id")
    return graph.adjacency_ranges(nodes.withColumnRenamed("account_id", "node_id"))


@query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points", "points")
def a6_world_bounds(spark: SparkSession, d: str) -> DataFrame:
    return spatial.world_bounds(relation(spark, d, "points"))


MOVING = "moving AS (SELECT node_id, mass, x, y, x * 0.01e0 AS fx, y * 0.02e0 AS fy, y * 0.005e0 AS fx_prev, x * 0.003e0 AS fy_prev FROM nodes)"


def _moving(spark: SparkSession, d: str) -> DataFrame:
    n = relation(spark, d, "nodes")
    return n.select("node_id", "mass", "x", "y", (F.col("x") * 0.01).alias("fx"), (F.col("y") * 0.02).alias("fy"), (F.col("y") * 0.005).alias("fx_prev"), (F.col("x") * 0.003).alias("fy_prev"))


SWING = """sums AS (SELECT sum((1 + mass) * sqrt((fx - fx_prev) ** 2 + (fy - fy_prev) ** 2)) AS swing,
  sum(0.5e0 * sqrt((fx + fx_prev) ** 2 + (fy + fy_prev) ** 2)) AS traction, count(*) AS n FROM moving)"""


@query(f"+ {MOVING}, {SWING} SELECT round(swing, 2) AS swing, round(traction, 4) AS traction, n FROM sums", "nodes")
def a7_swing_traction(spark: SparkSession, d: str) -> DataFrame:
    return forces.swing_traction(_moving(spark, d)).select(F.round("swing", 2).alias("swing"), F.round("traction", 4).alias("traction"), "n")


@query(f"+ {ADJ} SELECT src, dst, weight, row_number() OVER (ORDER BY src, dst) - 1 AS position FROM adj", "edges")
def a5_edge_array(spark: SparkSession, d: str) -> DataFrame:
    """The array that the nodes' ranges point into, written in files and read back."""
    path = new_path(spark, "edge-array")
    edge_array.write_edge_array(graph.mirror_edges(_edges(spark, d), OFFSET), path)
    return edge_array.read_edge_array(spark, path)


# --- attributes ---


@query(f"+ {KINDS} SELECT node_id, CASE WHEN kind = 'account' THEN followers + 1 ELSE 2 END::DOUBLE AS mass FROM kinds", "accounts")
def c1_mass(spark: SparkSession, d: str) -> DataFrame:
    return style.with_mass(_kinds(spark, d)).select("node_id", "mass")


@query("SELECT a.account_id, (count(e.account_id) + 1)::DOUBLE AS mass FROM accounts a LEFT JOIN edges e ON a.account_id = e.account_id GROUP BY a.account_id", "accounts edges")
def c1_mass_by_degree(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.with_degree(relation(spark, d, "accounts").select("account_id"), _edges(spark, d), "account_id")
    return style.with_mass(nodes, "degree").select("account_id", "mass")


@query(f"+ {KINDS} SELECT node_id, round(CASE WHEN kind = 'hashtag' THEN 5.0e0 WHEN followers > 0 THEN ln(100.0e0 * followers) END, 6) AS scale FROM kinds", "accounts")
def c2_scale(spark: SparkSession, d: str) -> DataFrame:
    return style.with_scale(_kinds(spark, d)).select("node_id", F.round("scale", 6).alias("scale"))


@query(f"+ {KINDS} SELECT node_id, CASE WHEN kind = 'account' THEN 1.0e0 ELSE 0.0e0 END AS r, 0.0e0 AS g, 0.0e0 AS b FROM kinds", "accounts")
def c3_color(spark: SparkSession, d: str) -> DataFrame:
    return style.with_color(_kinds(spark, d)).select("node_id", "r", "g", "b")


@query(
    f"+ {DRAW} SELECT src, dst, weight, (CASE WHEN year_created <= 2013 THEN 115 + 192 * 256 WHEN year_created <= 2015 THEN 196 * 256 + 255 * 65536 "
    "WHEN year_created <= 2017 THEN 223 + 137 * 256 + 255 * 65536 ELSE 76 + 70 * 256 + 62 * 65536 END + 255 * 16777216::BIGINT)::BIGINT AS rgba "
    "FROM draw JOIN accounts ON src = account_id", "edges accounts",
)
def c4_edge_colors(spark: SparkSession, d: str) -> DataFrame:
    return style.edge_colors(graph.draw_edges(_edges(spark, d), OFFSET), relation(spark, d, "accounts"))


def _unit(axis: str) -> str:
    return f"(2 * (('0x' || substr(md5(node_id || ':1:{axis}'), 1, 8))::BIGINT / 4294967296.0e0) - 1)"


@query(f"+ {KINDS} SELECT node_id, " + ", ".join(f"round(CASE WHEN kind = 'account' THEN 300.0e0 ELSE 40.0e0 END * {_unit(a)}, 6) + 0.0e0 AS {a}" for a in "xy") + " FROM kinds", "accounts")
def c5_init_positions(spark: SparkSession, d: str) -> DataFrame:
    p = style.init_positions(_kinds(spark, d))
    return p.select("node_id", *[(F.round(a, 6) + 0.0).alias(a) for a in "xy"])


@query(f"+ {KINDS}, u AS (SELECT node_id, {_unit('x')} AS x, {_unit('y')} AS y FROM kinds) SELECT node_id, round(2 * x / sqrt(x * x + y * y), 6) + 0.0e0 AS x, round(2 * y / sqrt(x * x + y * y), 6) + 0.0e0 AS y FROM u", "accounts")
def c6_init_circle(spark: SparkSession, d: str) -> DataFrame:
    p = style.init_positions(_kinds(spark, d), mode="circle")
    return p.select("node_id", *[(F.round(a, 6) + 0.0).alias(a) for a in "xy"])


# --- layout ---

S = 1e-3  # strength that keeps forces below about 10^3
PULL = f"""pull AS (SELECT n.node_id, {S} * coalesce(sum(weight * m.x) - any_value(n.x) * sum(weight), 0) AS fx, {S} * coalesce(sum(weight * m.y) - any_value(n.y) * sum(weight), 0) AS fy
  FROM nodes n LEFT JOIN adj ON n.node_id = src LEFT JOIN nodes m ON dst = m.node_id GROUP BY n.node_id)"""
PUSH = f"""push AS (SELECT a.node_id, sum({R} * a.mass * b.mass * (a.x - b.x) / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + {EPS})) AS fx,
  sum({R} * a.mass * b.mass * (a.y - b.y) / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + {EPS})) AS fy FROM nodes a JOIN nodes b ON a.node_id <> b.node_id GROUP BY a.node_id)"""
ROUND = "node_id, round(fx, 4) + 0.0e0 AS fx, round(fy, 4) + 0.0e0 AS fy"


@query(f"+ {ADJ}, {PULL} SELECT {ROUND} FROM pull", "nodes edges")
def l1_attraction(spark: SparkSession, d: str) -> DataFrame:
    adj = graph.mirror_edges(_edges(spark, d), OFFSET)
    return forces.attraction(relation(spark, d, "nodes"), adj, S).select("node_id", *_r("fx", "fy"))


@query("SELECT node_id, round(-x * mass * 1e-4, 4) + 0.0e0 AS fx, round(-y * mass * 1e-4, 4) + 0.0e0 AS fy FROM nodes", "nodes")
def l2_gravity_strong(spark: SparkSession, d: str) -> DataFrame:
    return forces.gravity(relation(spark, d, "nodes"), 1e-4).select("node_id", *_r("fx", "fy"))


@query(
    "SELECT node_id, round(CASE WHEN x * x + y * y > 0 THEN -x * mass * 1e-2 / sqrt(x * x + y * y) ELSE 0 END, 4) + 0.0e0 AS fx, "
    "round(CASE WHEN x * x + y * y > 0 THEN -y * mass * 1e-2 / sqrt(x * x + y * y) ELSE 0 END, 4) + 0.0e0 AS fy FROM nodes", "nodes",
)
def l2_gravity_weak(spark: SparkSession, d: str) -> DataFrame:
    return forces.gravity(relation(spark, d, "nodes"), 1e-2, strong=False).select("node_id", *_r("fx", "fy"))


@query(f"+ {PUSH} SELECT {ROUND} FROM push", "nodes")
def l3_repulsion_exact(spark: SparkSession, d: str) -> DataFrame:
    return forces.repulsion_exact(relation(spark, d, "nodes"), R, EPS).select("node_id", *_r("fx", "fy"))


@query()
def l4_repulsion_approx(spark: SparkSession, d: str) -> DataFrame:
    """No SQL twin: tests hold it against the exact force, at several opening angles."""
    return approx.repulsion_approx(relation(spark, d, "points"), 1.0, EPS).select("node_id", *_r("fx", "fy"))


# One step of controller and update from the sums: speed 1, efficiency 1, as next_speed says.
STEP = """c0 AS (SELECT swing + 0.001e0 AS s, traction + 0.001e0 AS t, n, 0.05e0 * sqrt(n) AS e FROM sums),
c1 AS (SELECT *, greatest(sqrt(e), least(10.0e0, e * t / (n * n::DOUBLE))) AS j0 FROM c0),
c2 AS (SELECT *, CASE WHEN s / t > 2 THEN 0.5e0 ELSE 1.0e0 END AS eff, CASE WHEN s / t > 2 THEN greatest(j0, 1.0e0) ELSE j0 END AS j FROM c1),
c3 AS (SELECT s, t, j, eff, j * eff * t / s AS target FROM c2),
c4 AS (SELECT 1 + least(target - 1, 0.5e0) AS speed, CASE WHEN s > j * t THEN eff * 0.7e0 ELSE eff * 1.3e0 END AS efficiency FROM c3)"""


@query(f"+ {MOVING}, {SWING}, {STEP} SELECT round(speed, 6) AS speed, round(efficiency, 6) AS efficiency FROM c4", "nodes")
def l5_next_speed(spark: SparkSession, d: str) -> DataFrame:
    row = forces.swing_traction(_moving(spark, d)).first()
    s = forces.next_speed(forces.Speed(), row["swing"], row["traction"], row["n"])
    return spark.createDataFrame([(round(s.speed, 6), round(s.efficiency, 6))], "speed double, efficiency double")


@query(
    f"+ {MOVING}, {SWING}, {STEP}, m AS (SELECT node_id, x, y, fx, fy, speed / (1 + speed * mass * sqrt((fx - fx_prev) ** 2 + (fy - fy_prev) ** 2)) AS st FROM moving, c4) "
    "SELECT node_id, round(x + st * fx, 4) + 0.0e0 AS x, round(y + st * fy, 4) + 0.0e0 AS y FROM m", "nodes",
)
def l6_update_nodes(spark: SparkSession, d: str) -> DataFrame:
    moving = _moving(spark, d)
    row = forces.swing_traction(moving).first()
    s = forces.next_speed(forces.Speed(), row["swing"], row["traction"], row["n"])
    return forces.update_nodes(moving, s.speed).select("node_id", *_r("x", "y"))


LAYOUT = LayoutParams(attraction=S, repulsion=R, soft=EPS, gravity=1e-4)


@query(
    f"""+ {ADJ}, {PULL}, {PUSH}, moving AS (SELECT n.node_id, n.mass, n.x, n.y, pull.fx + push.fx - 1e-4 * n.x * n.mass AS fx, pull.fy + push.fy - 1e-4 * n.y * n.mass AS fy,
  0.0e0 AS fx_prev, 0.0e0 AS fy_prev FROM nodes n JOIN pull USING (node_id) JOIN push USING (node_id)), {SWING}, {STEP},
  m AS (SELECT node_id, x, y, fx, fy, speed / (1 + speed * mass * sqrt(fx ** 2 + fy ** 2)) AS st FROM moving, c4)
  SELECT node_id, round(x + st * fx, 4) + 0.0e0 AS x, round(y + st * fy, 4) + 0.0e0 AS y FROM m""", "nodes edges",
)
def l7_layout_step(spark: SparkSession, d: str) -> DataFrame:
    nodes = relation(spark, d, "nodes").withColumns({"fx_prev": F.lit(0.0), "fy_prev": F.lit(0.0)})
    moved, _, _ = layout_step(nodes, graph.mirror_edges(_edges(spark, d), OFFSET), LAYOUT, forces.Speed())
    return moved.select("node_id", *_r("x", "y"))


@query()
def l7_layout(spark: SparkSession, d: str) -> DataFrame:
    """Three steps; no SQL twin: steps feed on each other."""
    nodes, _ = layout(relation(spark, d, "nodes"), graph.mirror_edges(_edges(spark, d), OFFSET), 3, LAYOUT)
    return nodes.select("node_id", *_r("x", "y"))


@query()
def l7_layout_approx(spark: SparkSession, d: str) -> DataFrame:
    """Two steps with approximate repulsion; no SQL twin: tests hold a step against the exact one."""
    nodes, _ = layout(relation(spark, d, "nodes"), graph.mirror_edges(_edges(spark, d), OFFSET), 2, LAYOUT, "approx")
    return nodes.select("node_id", *_r("x", "y"))


# --- spatial ---

_BITS = " + ".join(f"((((gx >> {k}) & 1) << {2 * k + 1}) + (((gy >> {k}) & 1) << {2 * k}))" for k in range(16))
KEYS = f"""bounds AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
cells AS (SELECT p.*, least(greatest(floor((x - x0) / (x1 - x0) * 65536.0e0)::BIGINT, 0), 65535) AS gx, least(greatest(floor((y - y0) / (y1 - y0) * 65536.0e0)::BIGINT, 0), 65535) AS gy FROM points p, bounds),
keyed AS (SELECT node_id, x, y, mass, ({_BITS})::BIGINT AS morton FROM cells)"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return spatial.with_morton(relation(spark, d, "points"))


@query(f"+ {KEYS} SELECT node_id, morton FROM keyed", "points")
def g1_morton(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("node_id", "morton")


@query(f"+ {KEYS} SELECT node_id, morton, row_number() OVER (ORDER BY morton, node_id) - 1 AS rank FROM keyed", "points")
def g2_spatial_sort(spark: SparkSession, d: str) -> DataFrame:
    return spatial.spatial_sort(_keyed(spark, d).select("node_id", "morton"))


NEXT = """nexts AS (SELECT morton, lead(morton) OVER (ORDER BY morton) AS next_morton FROM (SELECT DISTINCT morton FROM keyed))"""


@query(f"+ {KEYS}, {NEXT} SELECT morton, next_morton, (32 - length(bin(xor(morton, next_morton))))::INT AS lcp FROM nexts WHERE next_morton IS NOT NULL", "points")
def g3_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    return spatial.adjacent_prefixes(_keyed(spark, d))


GROUPS = """lv AS (SELECT unnest(range(0, 33)) AS level), buckets AS (SELECT morton, count(*) AS n, sum(mass) AS mass, sum(mass * x) AS mx, sum(mass * y) AS my FROM keyed GROUP BY morton),
groups AS (SELECT level, morton >> (32 - level) AS prefix, sum(n)::BIGINT AS n, sum(mass) AS mass, sum(mx) AS mx, sum(my) AS my, min(morton) AS kmin, max(morton) AS kmax FROM buckets, lv GROUP BY 1, 2),
inodes AS (SELECT * FROM groups WHERE kmin < kmax AND level = 32 - length(bin(xor(kmin, kmax)))),
known AS (SELECT level, prefix, kmin, kmax FROM inodes UNION ALL SELECT level, prefix, kmin, kmax FROM groups WHERE level = 32),
links AS (SELECT i.level, i.prefix, k.level AS child_level, k.prefix AS child_prefix FROM inodes i JOIN groups g ON g.level = i.level + 1 AND g.prefix >> 1 = i.prefix
  JOIN known k ON k.kmin = g.kmin AND k.kmax = g.kmax)"""


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    groups = written(spatial.prefix_groups(_keyed(spark, d)), "groups")
    return groups, written(spatial.radix_tree(groups), "tree")


@query(f"+ {KEYS}, {GROUPS} SELECT level::INT AS level, prefix, child_level::INT AS child_level, child_prefix FROM links", "points")
def g4_radix_tree(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tree_children(_tree(spark, d)[1])


@query(
    f"""+ {KEYS}, {GROUPS} SELECT i.level::INT AS level, i.prefix, any_value(i.n) AS n, round(any_value(i.mass), 4) AS mass, round(any_value(i.mx / i.mass), 4) + 0.0e0 AS cx, round(any_value(i.my / i.mass), 4) + 0.0e0 AS cy,
  round(max(2 * sqrt((c.mx / c.mass - i.mx / i.mass) ** 2 + (c.my / c.mass - i.my / i.mass) ** 2)), 4) AS size
  FROM links l JOIN inodes i ON l.level = i.level AND l.prefix = i.prefix JOIN groups c ON c.level = l.child_level AND c.prefix = l.child_prefix GROUP BY 1, 2""", "points",
)
def g5_tree_summary(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tree_summary(*_tree(spark, d)).select("level", "prefix", "n", *_r("mass", "cx", "cy", "size"))


CELLS = """celled AS (SELECT node_id, CASE WHEN abs(x) <= 0.25 AND abs(y) <= 0.25 THEN least(floor((y + 0.25e0) / (0.5e0 / 128)), 127)::BIGINT * 128 + least(floor((x + 0.25e0) / (0.5e0 / 128)), 127)::BIGINT END AS cell_id FROM points)"""


@query(f"+ {CELLS} SELECT node_id, coalesce(cell_id, -1) AS cell_id FROM celled", "points")
def g6_grid_cell(spark: SparkSession, d: str) -> DataFrame:
    return spatial.with_cell(relation(spark, d, "points"), 0.25).select("node_id", F.coalesce("cell_id", F.lit(-1)).alias("cell_id"))


@query(f"+ {CELLS} SELECT cell_id, count(*) AS n, array_to_string(list_sort(list(node_id)), ',') AS node_ids FROM celled WHERE cell_id IS NOT NULL GROUP BY cell_id", "points")
def g7_cell_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = spatial.cell_lists(spatial.with_cell(relation(spark, d, "points"), 0.25))
    return lists.select("cell_id", "n", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("node_ids"))


@query(
    f"+ {CELLS} SELECT cell_id, p // 8 AS block, count(*) AS n, array_to_string(list(node_id ORDER BY node_id), ',') AS node_ids FROM "
    f"(SELECT *, {_PLACED.format('cell_id', 'node_id')} AS p FROM celled WHERE cell_id IS NOT NULL) GROUP BY ALL", "points",
)
def g7_cell_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each cell in blocks: of eight, so that cells of these tables have several."""
    blocks = spatial.cell_blocks(spatial.with_cell(relation(spark, d, "points"), 0.25), 8)
    return blocks.select("cell_id", "block", "n", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("node_ids"))


PAIRS = """pairs AS (SELECT a.node_id AS i, b.node_id AS j, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, a.family AS fi, b.family AS fj
  FROM points a JOIN points b ON a.node_id <> b.node_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.05)"""


@query(f"+ {PAIRS} SELECT i, j, round(distance, 6) AS distance FROM pairs", "points")
def g8_neighbors_within(spark: SparkSession, d: str) -> DataFrame:
    # Rounded as the twin's engine does, halves up; Spark's own goes through decimals, at over half of the query's time.
    at = F.col("distance") * 1e6
    up = F.floor(at) + F.when(at - F.floor(at) >= 0.5, 1).otherwise(0)
    return spatial.neighbors_within(relation(spark, d, "points"), 0.05).select("i", "j", (up / F.lit(1e6)).alias("distance"))


FAMILY = {"diff_radius": 0.05, "same_radius": 0.02, "pull_radius": 0.04}


@query(
    f"""+ {PAIRS}, st AS (SELECT i, dx / distance AS ux, dy / distance AS uy, CASE WHEN fi = fj THEN greatest(0, 8.98e0 * (1 - distance / 0.02e0)) - CASE WHEN distance < 0.04e0 THEN 0.335e0 ELSE 0 END
  ELSE greatest(0, 1.82e0 * (1 - distance / 0.05e0)) END AS s FROM pairs) SELECT i AS node_id, round(sum(ux * s), 4) + 0.0e0 AS fx, round(sum(uy * s), 4) + 0.0e0 AS fy FROM st GROUP BY i""", "points",
)
def g9_family_force(spark: SparkSession, d: str) -> DataFrame:
    p = relation(spark, d, "points")
    return spatial.family_force(spatial.neighbors_within(p, 0.05), p, FAMILY).select("node_id", *_r("fx", "fy"))


# --- sorts and checks ---


@query("SELECT l_partkey, l_orderkey FROM lineitem ORDER BY l_partkey, l_orderkey")
def o1_sort_pairs(spark: SparkSession, d: str) -> DataFrame:
    return checks.sort_pairs(spark.read.parquet(f"{d}/lineitem.parquet"), "l_partkey", "l_orderkey")


@query("SELECT count(*) AS inversions FROM (SELECT l_partkey < lag(l_partkey) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS v FROM lineitem) WHERE v")
def o2_count_inversions(spark: SparkSession, d: str) -> DataFrame:
    return checks.count_inversions(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber", "l_partkey"], "l_partkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def o3_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), "l_partkey")


@query(f"+ {KEYS}, {GROUPS} SELECT k.level::INT AS level, k.prefix, count(l.level) AS n_refs FROM known k LEFT JOIN links l ON l.child_level = k.level AND l.child_prefix = k.prefix GROUP BY k.level, k.prefix HAVING count(l.level) <> CASE WHEN k.level = (SELECT min(level) FROM inodes) THEN 0 ELSE 1 END", "points")
def o4_tree_integrity(spark: SparkSession, d: str) -> DataFrame:
    groups, tree = _tree(spark, d)
    return checks.tree_integrity(groups, tree, spatial.tree_children(tree))


# --- generators, sized by the tables ---


@query("SELECT * FROM (SELECT 2 * s_suppkey AS src, 2 * s_suppkey + 1 AS dst, CAST(1 AS bigint) AS weight FROM supplier), (SELECT 2.0e0 AS src_mass, 2.0e0 AS dst_mass)")
def d1_pair(spark: SparkSession, d: str) -> DataFrame:
    """A pair for each row of supplier: edges with the masses of both ends."""
    nodes, edges = generate.gen_pairs(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    a, b = (nodes.select(F.col("node_id").alias(end), F.col("mass").alias(f"{end}_mass")) for end in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", "src_mass", "dst_mass")


@query(
    "WITH s AS (SELECT (SELECT count(*) FROM supplier) AS r, (SELECT count(*) FROM nation) AS b) SELECT i // (r // 1) AS grp, i AS src, 3 * r + k * b + j AS dst, 1::BIGINT AS weight "
    "FROM s, (SELECT unnest(range(0, 3 * (SELECT count(*) FROM supplier))) AS i) x, (SELECT unnest(range(0, (SELECT count(*) FROM nation))) AS j) y, (SELECT unnest([0, 1]) AS k) z "
    "WHERE (i // r = k) OR i // r = 2"
)
def d2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Three red groups as large as supplier, two black ones as large as nation."""
    r, b = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("supplier", "nation"))
    _, edges = generate.gen_blocks(spark, (r, r, r), (b, b))
    return edges.select(F.floor(F.col("src") / r).alias("grp"), "src", "dst", "weight")


@query(
    "WITH s AS (SELECT (SELECT count(*) FROM supplier) AS r, (SELECT count(*) FROM nation) AS b) "
    "SELECT i AS node_id, 'red' AS kind, (i // r)::INT AS grp, (1 + CASE WHEN i // r = 2 THEN 2 * b ELSE b END)::DOUBLE AS mass FROM s, (SELECT unnest(range(0, 3 * (SELECT count(*) FROM supplier))) AS i) "
    "UNION ALL SELECT 3 * r + j, 'black', (j // b)::INT, (1 + 2 * r)::DOUBLE FROM s, (SELECT unnest(range(0, 2 * (SELECT count(*) FROM nation))) AS j)"
)
def d2_block_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of those blocks; the mass is one more than the neighbours."""
    r, b = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("supplier", "nation"))
    nodes, _ = generate.gen_blocks(spark, (r, r, r), (b, b))
    return nodes.select("node_id", "kind", "grp", "mass")


@query("SELECT node_id, 1.0e0 AS mass, " + ", ".join(f"round(40 * {_unit(a)}, 6) + 0.0e0 AS {a}" for a in "xy") + " FROM (SELECT unnest(range(0, (SELECT count(*) FROM lineitem))) AS node_id)")
def d3_cloud(spark: SparkSession, d: str) -> DataFrame:
    """A cloud with a node for each row of lineitem."""
    p = generate.gen_cloud(spark, spark.read.parquet(f"{d}/lineitem.parquet").count())
    return p.select("node_id", "mass", *[(F.round(a, 6) + 0.0).alias(a) for a in "xy"])


@query(
    "SELECT account_id, hashtag_id, weight, n_account_edges, CAST(first_date AS varchar) AS first_date, CAST(last_date AS varchar) AS last_date FROM (SELECT account_id, hashtag_id, count(*) AS weight, min(date) AS first_date, max(date) AS last_date "
    "FROM occ GROUP BY account_id, hashtag_id) JOIN (SELECT account_id, count(*) AS n_account_edges FROM edges GROUP BY account_id) USING (account_id)", "occ edges",
)
def flagship_weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edges with the degree of their account and the range of their dates."""
    occ = relation(spark, d, "occ")
    edges = occ.groupBy("account_id", "hashtag_id").agg(F.count("*").alias("weight"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    degree = edges.groupBy("account_id").agg(F.count("*").alias("n_account_edges"))
    return edges.join(degree, "account_id").select("account_id", "hashtag_id", "weight", "n_account_edges", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))
