"""Relational and scoring operators one by one, as SQL over the test tables that both engines read alike."""

from __future__ import annotations

from marlstone.functions.sqlexpr import band, clamp, doubles, ladder, percentile

TABLES = ("part", "lineitem", "orders", "customer", "supplier", "nation", "region", "events")
_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}"

SQL: dict[str, str] = {
    "semi_join_listed": "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')",
    "anti_join_unlisted": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "equi_join_latest": f"SELECT c.c_custkey, c.c_name, o.o_orderkey FROM {{customer}} c JOIN ({_ORDERS}) o ON o.o_custkey = c.c_custkey WHERE o.rn = 1",
    "left_lookup": "SELECT c.c_custkey, n.n_name FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1",
    "full_outer_difference": "SELECT s.s_nationkey AS left_key, c.c_nationkey AS right_key FROM (SELECT DISTINCT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) s FULL OUTER JOIN (SELECT DISTINCT c_nationkey FROM {customer} WHERE c_acctbal > 9000) c ON s.s_nationkey = c.c_nationkey",
    "union_all_lists": "SELECT 'high' AS list, c_custkey FROM {customer} WHERE c_acctbal > 9000 UNION ALL SELECT 'low' AS list, c_custkey FROM {customer} WHERE c_acctbal < 0",
    "set_difference": "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45",
    "set_intersection": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "duplicate_keys": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 1",
    "latest_per_key": "SELECT user_id, max(ts) AS latest, count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id",
    "tail_n_per_key": f"SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM ({_ORDERS}) AS t WHERE rn <= 3",
    "top_k_report": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "latest_one": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "value_map": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place FROM {orders}",
    "horizontal_max": "SELECT p_partkey, greatest(p_size, CAST(floor(p_retailprice) AS INT) % 50) AS most FROM {part}",
    "percentile_high": f"SELECT c_custkey, round({percentile('c_acctbal', 'high', 'c_mktsegment')}, 10) AS score FROM {{customer}}",
    "percentile_low_ties": f"SELECT p_partkey, round({percentile('p_size', 'low', 'p_brand')}, 10) AS score FROM {{part}}",
    "percentile_positive": f"SELECT c_custkey, round({percentile('c_acctbal', 'positive', 'c_mktsegment')}, 10) AS score FROM {{customer}}",
    "band_score": f"SELECT p_partkey, round({band('p_size', (10.0, 20.0), (5.0, 40.0))}, 10) AS score FROM {{part}}",
    "clamp_score": f"SELECT c_custkey, {clamp('c_acctbal / 10000.0', 0.0, 1.0)} AS score FROM {{customer}}",
    "step_cap": f"SELECT p_partkey, {ladder(('p_size > 40', 0.45), ('p_size > 30', 0.65), ('p_size > 20', 0.82))} AS cap FROM {{part}}",
    "ranked_list": "SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM {customer}",
    "rank_completeness": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT rank) AS ranks, min(rank) AS low, max(rank) AS high FROM (SELECT c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM {customer}) AS r GROUP BY c_mktsegment",
}
SQL = {n: doubles(x) for n, x in SQL.items()}
