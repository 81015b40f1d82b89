"""Views over the star-schema test tables that stand in for observations.

The statements run unchanged in Spark and DuckDB but for the number of days since a date and the place in an array, so both sides of a
comparison start from one text. Spark reads the tables named in braces; DuckDB has them as views of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: In the order in which they build on each other.
VIEWS: dict[str, str] = {
    "fx_vis_raw": """
        SELECT DAYS(l_shipdate) % 64 * 1e1 AS time, 1e1 AS integration_time, l_suppkey % 8 AS a1, l_suppkey % 8 + 1 + l_partkey % 7 AS a2,
               l_linenumber - 1 AS chan, 1e8 + (l_linenumber - 1) * 1e6 AS frequency, 1e6 AS channel_bandwidth, p.pol AS pol,
               (CAST(l_quantity AS DOUBLE) - 25.5e0) * 4 AS u, (CAST(l_discount AS DOUBLE) * 100 - 5) * 15 AS v, (CAST(l_tax AS DOUBLE) * 100 - 4) * 10 AS w,
               CAST(l_extendedprice AS DOUBLE) / 1e3 * (1 + 1e-1 * p.pol) AS vis_re, (CAST(l_discount AS DOUBLE) * 100 - 5) * (1 + p.pol) AS vis_im,
               CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE 1e0 + l_linenumber % 3 END AS weight
        FROM {lineitem} CROSS JOIN (SELECT 0 AS pol UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p""",
    "fx_vis": """
        SELECT time, a1, a2, chan, pol, max(integration_time) AS integration_time, max(frequency) AS frequency, max(channel_bandwidth) AS channel_bandwidth,
               avg(u) AS u, avg(v) AS v, avg(w) AS w,
               CASE WHEN sum(weight) > 0 THEN sum(weight * vis_re) / sum(weight) ELSE 0e0 END AS vis_re,
               CASE WHEN sum(weight) > 0 THEN sum(weight * vis_im) / sum(weight) ELSE 0e0 END AS vis_im,
               sum(weight) AS weight, sum(weight) AS imaging_weight
        FROM fx_vis_raw GROUP BY time, a1, a2, chan, pol""",
    "fx_model": """
        SELECT time, a1, a2, chan, pol, CASE WHEN chan = 6 THEN 0e0 ELSE 50e0 + a1 END AS m_re, CASE WHEN chan = 6 THEN 0e0 ELSE CAST(a2 - chan AS DOUBLE) END AS m_im
        FROM fx_vis""",
    "fx_antenna": """
        SELECT c_custkey AS ant, CAST(c_acctbal AS DOUBLE) AS x, c_nationkey * 40e0 AS y, (c_custkey % 7) * 10e0 AS z, 35e0 AS diameter
        FROM {customer}""",
    "fx_gain": """
        SELECT 75e0 + 160 * k.k AS time, 160e0 AS "interval", ant, c.chan AS chan, (1 + ant % 50 / 100e0) * cos(1e-1 * ant + 1e-2 * k.k) AS g_re,
               (1 + ant % 50 / 100e0) * sin(1e-1 * ant + 1e-2 * k.k) AS g_im, CASE WHEN ant % 15 = 13 THEN 0e0 ELSE 1e0 END AS weight
        FROM fx_antenna CROSS JOIN (SELECT DISTINCT CAST(floor((DAYS(l_shipdate) % 64) / 16e0) AS INT) AS k FROM {lineitem}) k
        CROSS JOIN (SELECT DISTINCT l_linenumber - 1 AS chan FROM {lineitem}) c""",
    "fx_signal": """
        SELECT time, chan, a1 AS ant, avg(vis_re) AS s_re, avg(vis_im) AS s_im FROM fx_vis WHERE weight > 0 GROUP BY time, chan, a1""",
    "fx_component": """
        SELECT p_partkey AS comp_id, radians((p_partkey % 360) * 5e-2) AS ra, radians(-35 + p_size * 1e-1) AS "dec", CAST(p_retailprice AS DOUBLE) / 1e3 AS flux0
        FROM {part}""",
    "fx_target": """
        SELECT s_suppkey AS comp_id, radians((s_suppkey * 7 % 360) * 5e-2 + 13e-3) AS ra, radians(-35 + s_nationkey * 2e-1 + 3e-3) AS "dec",
               1 + abs(CAST(s_acctbal AS DOUBLE)) / 1e4 AS flux0
        FROM {supplier}""",
    "fx_pixel": """
        SELECT CAST(month(o_orderdate) % 5 AS BIGINT) AS chan, 0 AS pol, o_orderkey % 64 AS y, o_custkey % 64 AS x, sum(CAST(o_totalprice AS DOUBLE)) / 1e5 AS value
        FROM {orders} GROUP BY month(o_orderdate) % 5, o_orderkey % 64, o_custkey % 64""",
    "fx_mask": "SELECT *, CASE WHEN (x - 32) * (x - 32) + (y - 32) * (y - 32) < 400 THEN 1e0 ELSE 0e0 END AS mask FROM fx_pixel",
    "fx_spectrum": f"""
        SELECT vec_id, CAST(k - 1 AS BIGINT) AS chan, CAST(AT(embedding, k) AS DOUBLE) AS value FROM {{embeddings}} CROSS JOIN (VALUES {", ".join(f"({k})" for k in range(1, 65))}) AS c(k)""",
    "fx_stream": """
        SELECT ts, least(user_id % 15, (user_id % 15 + 1 + event_id % 14) % 15) AS a1, greatest(user_id % 15, (user_id % 15 + 1 + event_id % 14) % 15) AS a2,
               CAST(value AS DOUBLE) AS x_re, CAST(event_id % 11 - 5 AS DOUBLE) AS x_im, 1e0 AS weight
        FROM {events}""",
    # The same rows with the order in which they came.
    "fx_arrival": """
        SELECT event_id, ts, least(user_id % 15, (user_id % 15 + 1 + event_id % 14) % 15) AS a1 FROM {events}""",
}


def _needed(body: str) -> list[str]:
    """The views that a statement uses, directly or not, in order."""
    used: set[str] = set()
    todo = [body]
    while todo:
        found = {v for v in VIEWS if re.search(rf"\b{v}\b", todo[-1])} - used
        todo.pop()
        used |= found
        todo += [VIEWS[v] for v in found]
    return [v for v in VIEWS if v in used]


def with_views(body: str, *, days: str, at: str, tables: dict[str, str], quote: str, hint: str = "") -> str:
    """``body`` after WITH clauses for the views that it uses."""
    ctes = ", ".join(f"{v} AS {hint}({VIEWS[v]})" for v in _needed(body))
    text = f"WITH {ctes} {body}" if ctes else body
    text = re.sub(r"\bAT\(", f"{at}(", re.sub(r"DAYS\((\w+)\)", days, text)).replace('"', quote)
    return text.format(**tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of ``sf_dir``."""
    body = f"SELECT * FROM {name}"
    text = with_views(body, days=r"datediff(\1, DATE'1995-01-01')", at="element_at", tables={t: "{" + t + "}" for t in TABLES}, quote="`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb_sql(body: str) -> str:
    """The DuckDB statement of ``body`` with its views, each computed once."""
    return with_views(body, days=r"date_diff('day', DATE '1995-01-01', CAST(\1 AS DATE))", at="list_extract", tables={t: t for t in TABLES}, quote='"', hint="MATERIALIZED ")
