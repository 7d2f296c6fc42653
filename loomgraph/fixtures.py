"""The graph's inputs, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OFFSET = 100_000
#: Relations in SQL that Spark and DuckDB both read; {e0}, {e1} are the vector's first two values.
CTES = {
    "accounts": """SELECT s_suppkey AS account_id, s_name AS name, CAST(greatest(floor(s_acctbal), 0) AS bigint) AS followers,
      CAST(2010 + s_suppkey % 10 AS int) AS year_created FROM supplier""",
    "occ": "SELECT l_suppkey AS account_id, l_partkey AS hashtag_id, CAST(l_shipdate AS date) AS date FROM lineitem",
    "posts": """SELECT s_name AS name, CAST(l_shipdate AS date) AS date, CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity < 7 THEN '[]'
      ELSE concat('[', replace(p_name, ' ', ', '), ', ', p_type, ']') END AS hashtags
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "nodes": f"""SELECT CAST(account_id AS bigint) AS node_id, 'account' AS kind, CAST(followers + 1 AS double) AS mass,
      300 * (2 * ((account_id * 7919 + 13) % 10007) / 10007.0e0 - 1) AS x, 300 * (2 * ((account_id * 104729 + 71) % 10009) / 10009.0e0 - 1) AS y FROM accounts
      UNION ALL SELECT CAST({OFFSET} + p_partkey AS bigint), 'hashtag', 2.0e0,
      40 * (2 * ((p_partkey * 7919 + 13) % 10007) / 10007.0e0 - 1), 40 * (2 * ((p_partkey * 104729 + 71) % 10009) / 10009.0e0 - 1) FROM part""",
    "edges": "SELECT account_id, hashtag_id, count(*) AS weight, count(*) AS n_dates FROM occ GROUP BY account_id, hashtag_id",
    "points": """SELECT CAST(vec_id AS bigint) AS node_id, CAST({e0} AS double) AS x, CAST({e1} AS double) AS y, label AS family,
      CAST(label + 1 AS double) AS mass FROM embeddings""",
}
NEEDS = {"nodes": ["accounts"], "edges": ["occ"]}
SOURCES = {"accounts": ["supplier"], "occ": ["lineitem"], "posts": ["lineitem", "supplier", "part"], "nodes": ["supplier", "part"], "edges": ["lineitem"], "points": ["embeddings"]}


def with_ctes(names: list[str], query: str) -> str:
    """DuckDB SQL: the query over the named relations."""
    order = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    parts = ", ".join(f"{n} AS ({CTES[n].format(e0='embedding[1]', e1='embedding[2]')})" for n in order)
    joint = ", " if query.lstrip().startswith("+") else " "
    return f"WITH {parts}{joint}{query.lstrip().removeprefix('+').lstrip()}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    sql = CTES[name].format(e0="embedding[0]", e1="embedding[1]") if name == "points" else CTES[name]
    for need in NEEDS.get(name, []):
        sql = f"WITH {need} AS ({CTES[need]}) {sql}"
    for t in tables:
        sql = sql.replace(f" FROM {t}", f" FROM {{{t}}}").replace(f" JOIN {t} ", f" JOIN {{{t}}} AS {t} ")
        sql = sql.replace(f" FROM {{{t}}}", f" FROM {{{t}}} AS {t}")
    return spark.sql(sql, **tables)
