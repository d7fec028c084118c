"""Where queries and their SQL are kept, and the SQL of the role views."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_VIEWS = {
    "sales": "SELECT p_brand AS item, p_type AS dept, s_nationkey AS store, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
    "daily": "SELECT item, store, date, sum(quantity) AS quantity FROM sales GROUP BY ALL",
    "weekly": "SELECT item, store, CAST(date_trunc('week', date) AS DATE) AS week, sum(quantity) AS quantity FROM sales GROUP BY ALL",
    "online": "SELECT CAST(ts AS DATE) AS date, user_id AS user, value FROM events WHERE event_type = 'purchase'",
    "tx": "SELECT o_custkey AS cust, l_partkey AS art, CAST(o_orderdate AS DATE) AS day, l_extendedprice AS price, l_orderkey AS receipt, o_orderpriority AS channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "txw": "SELECT *, (SELECT max(day) FROM tx) - day AS days_ago, ((SELECT max(day) FROM tx) - day) // 7 AS week FROM tx",
    "articles": "SELECT p_partkey AS art, p_brand AS product, p_type AS dept, p_size AS size, p_retailprice AS list_price FROM part",
    "customers": "SELECT c_custkey AS cust, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
}
_NEEDS = {"daily": ["sales"], "weekly": ["sales"], "txw": ["tx"]}


def with_views(sql: str, views: str) -> str:
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"


def query(sql: str | None = None, views: str = ""):
    """Register a function of a Shop under its name, with DuckDB SQL over the role views it names."""

    def add(f):
        from ..sources.roles import Shop

        QUERIES[f.__name__] = lambda spark, folder: f(Shop(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, views)
        return f

    return add
