"""One query per family of SQL that users send through the read-only guard.

Each is written so that no step gathers one key's rows: groups are aggregated
before they are shuffled, windows run over aggregates or over bounded slices
of a key, and collected sets come from small domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearledger.operators.readonly_sql import run_query
from clearledger.plans.registry import ORACLES, QUERIES
from clearledger.sources.files import register_views


def _register(name: str, tables: tuple[str, ...], sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        register_views(spark, folder, tables)
        return run_query(spark, sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql


_register(
    "sql_filter_case",
    ("orders",),
    """
    SELECT o_orderkey, o_orderstatus,
           CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'middle'
                ELSE 'low' END AS price_band
    FROM orders
    WHERE (o_totalprice BETWEEN 50000 AND 450000 AND o_orderstatus IN ('F', 'P')
           AND o_orderpriority NOT LIKE '5%')
       OR (o_orderpriority ILIKE '%urgent%' AND o_orderdate < DATE '1997-01-01'
           AND o_custkey IS NOT NULL AND o_orderstatus <> 'P')
    """,
)

SPENT = """
    SELECT o_custkey, count(*) AS n_orders,
           sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent
    FROM orders GROUP BY o_custkey
"""

_register(
    "sql_join_equi",
    ("region", "nation", "customer", "orders"),
    f"""
    WITH spending AS ({SPENT})
    SELECT r.r_name, n.n_name, count(c.c_custkey) AS n_customers, count(s.o_custkey) AS n_buyers,
           CAST(coalesce(sum(s.n_orders), 0) AS BIGINT) AS n_orders,
           CAST(sum(s.spent) AS DOUBLE) AS spent
    FROM region r
    JOIN nation n ON n.n_regionkey = r.r_regionkey
    LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    LEFT JOIN spending s ON s.o_custkey = c.c_custkey
    GROUP BY r.r_name, n.n_name
    """,
)

_register(
    "sql_join_outer",
    ("nation", "customer", "supplier"),
    """
    WITH buyers AS (
        SELECT c_nationkey, count(*) AS n_customers FROM customer
        WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey
    ), sellers AS (
        SELECT s_nationkey, count(*) AS n_suppliers FROM supplier
        WHERE s_acctbal > 5000 GROUP BY s_nationkey
    )
    SELECT n.n_name, b.c_nationkey AS buyer_nation, s.s_nationkey AS seller_nation,
           b.n_customers, s.n_suppliers
    FROM buyers b FULL JOIN sellers s ON b.c_nationkey = s.s_nationkey
    RIGHT JOIN nation n ON n.n_nationkey = coalesce(b.c_nationkey, s.s_nationkey)
    """,
)

# Two hours from the last error of each day on, so that some windows reach into the next.
# An equal day makes it an equi-join; a window stands under every day it touches.
_register(
    "sql_join_range",
    ("events",),
    """
    WITH alarms AS (
        SELECT max(ts) AS opened, max(ts) + INTERVAL 2 HOURS AS closed
        FROM events WHERE event_type = 'error' GROUP BY date_trunc('day', ts)
    ), by_day AS (
        SELECT opened, closed,
               explode(sequence(date_trunc('day', opened), date_trunc('day', closed), INTERVAL 1 DAY)) AS day
        FROM alarms
    )
    SELECT e.event_type, count(*) AS n_events,
           CAST(sum(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events e JOIN by_day a
      ON date_trunc('day', e.ts) = a.day AND e.ts >= a.opened AND e.ts < a.closed
    GROUP BY e.event_type
    """,
    """
    WITH alarms AS (
        SELECT max(ts) AS opened, max(ts) + INTERVAL 2 HOURS AS closed
        FROM events WHERE event_type = 'error' GROUP BY date_trunc('day', ts)
    )
    SELECT e.event_type, count(*) AS n_events,
           CAST(sum(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events e JOIN alarms a ON e.ts >= a.opened AND e.ts < a.closed
    GROUP BY e.event_type
    """,
)

_register(
    "sql_join_theta",
    ("orders", "lineitem"),
    """
    WITH shipped AS (
        SELECT l_orderkey, l_shipdate, count(*) AS n_items FROM lineitem GROUP BY l_orderkey, l_shipdate
    )
    SELECT o.o_orderpriority, count(*) AS n_shipments, CAST(sum(s.n_items) AS BIGINT) AS n_items
    FROM orders o JOIN shipped s
      ON s.l_orderkey = o.o_orderkey AND s.l_shipdate >= o.o_orderdate
     AND s.l_shipdate < o.o_orderdate + INTERVAL 90 DAYS
    GROUP BY o.o_orderpriority
    """,
)

_register(
    "sql_semi_anti",
    ("customer", "orders", "supplier"),
    """
    SELECT c.c_custkey, c.c_mktsegment
    FROM customer c
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o
                  WHERE o.o_custkey = c.c_custkey)
      AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders
                                     WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') o
                      WHERE o.o_custkey = c.c_custkey)
      AND c.c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 1000)
      AND c.c_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0)
    """,
)

_register(
    "sql_lateral",
    ("customer", "orders"),
    """
    SELECT c.c_custkey, t.n_orders, t.last_order, p.score
    FROM customer c,
         LATERAL (SELECT count(*) AS n_orders, max(o.o_orderdate) AS last_order
                  FROM orders o WHERE o.o_custkey = c.c_custkey) t,
         LATERAL (SELECT t.n_orders * 10 + c.c_nationkey AS score) p
    """,
)

# The latest purchase of a user up to each error, by hours so that many are at the same
# instant: of several the one with the greatest id. A user's time line is cut into days: the
# window stays within one, and what earlier days left behind comes from one row per day.
_register(
    "sql_asof",
    ("events",),
    """
    WITH line AS (
        SELECT event_id, user_id, date_trunc('hour', ts) AS at, date_trunc('day', ts) AS day, event_type,
               CASE WHEN event_type = 'purchase' THEN struct(date_trunc('hour', ts), event_id) END AS bought
        FROM events WHERE event_type IN ('purchase', 'error')
    ), days AS (
        SELECT user_id, day, max(bought) AS closing FROM line GROUP BY user_id, day
    ), carried AS (
        SELECT user_id, day,
               max(closing) OVER (PARTITION BY user_id ORDER BY day
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
        FROM days
    ), inside AS (
        SELECT event_id, user_id, day, event_type,
               max(bought) OVER (PARTITION BY user_id, day ORDER BY at
                                 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same_day
        FROM line
    )
    SELECT i.event_id, i.user_id, coalesce(i.same_day, c.earlier).event_id AS purchase_id
    FROM inside i JOIN carried c ON c.user_id = i.user_id AND c.day = i.day
    WHERE i.event_type = 'error'
    """,
    """
    SELECT e.event_id, e.user_id, last(p.event_id ORDER BY date_trunc('hour', p.ts), p.event_id) AS purchase_id
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON p.user_id = e.user_id AND date_trunc('hour', p.ts) <= date_trunc('hour', e.ts)
    GROUP BY e.event_id, e.user_id
    """,
)

_register(
    "sql_group_having",
    ("lineitem",),
    """
    SELECT l_suppkey, count(*) AS n_items, count(DISTINCT l_partkey) AS n_parts,
           count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
           min(l_shipdate) AS first_shipped, max(l_extendedprice) AS top_price
    FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10 AND max(l_discount) > 0.05
    """,
)

GROUPED = """
    SELECT {keys} AS lower_status, o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           CAST(grouping(o_orderstatus) AS INT) AS all_statuses,
           CAST(grouping(o_orderpriority) AS INT) AS all_priorities
    FROM orders GROUP BY {sets}
"""
for _name, _sets in (
    (
        "sql_grouping_sets",
        "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())",
    ),
    ("sql_rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("sql_cube", "CUBE (o_orderstatus, o_orderpriority)"),
):
    _register(_name, ("orders",), GROUPED.format(keys="lower(o_orderstatus)", sets=_sets))

_register(
    "sql_stats",
    ("lineitem",),
    """
    SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 6) AS sd,
           round(var_pop(l_quantity), 6) AS variance,
           round(corr(l_quantity, l_extendedprice), 6) AS correlation,
           percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS middle,
           percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS high,
           percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS low
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)

_register(
    "sql_mode",
    ("lineitem",),
    """
    SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_quantity) AS usual_quantity
    FROM lineitem GROUP BY l_returnflag
    """,
    """
    SELECT l_returnflag, arg_min(l_quantity, (-n, l_quantity)) AS usual_quantity
    FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
    GROUP BY l_returnflag
    """,
)

_register(
    "sql_string_agg",
    ("orders",),
    """
    SELECT o_custkey,
           string_agg(DISTINCT o_orderstatus, ',') WITHIN GROUP (ORDER BY o_orderstatus) AS statuses
    FROM orders GROUP BY o_custkey
    """,
    """
    SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
    FROM orders GROUP BY o_custkey
    """,
)

_register(
    "sql_array_agg",
    ("orders",),
    """
    SELECT o_custkey, array_join(sort_array(array_agg(DISTINCT o_orderpriority)), '|') AS priorities
    FROM orders GROUP BY o_custkey
    """,
    """
    SELECT o_custkey, array_to_string(list_sort(array_agg(DISTINCT o_orderpriority)), '|') AS priorities
    FROM orders GROUP BY o_custkey
    """,
)

MONTHLY = """
    SELECT date_trunc('month', o_orderdate) AS month, o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM orders GROUP BY date_trunc('month', o_orderdate), o_orderpriority
"""

_register(
    "sql_rank",
    ("orders",),
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP_NTZ) AS month,
           CAST(row_number() OVER r AS BIGINT) AS place, CAST(rank() OVER n AS BIGINT) AS count_rank,
           CAST(dense_rank() OVER n AS BIGINT) AS dense_place,
           CAST(ntile(4) OVER r AS BIGINT) AS quarter,
           round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY n_orders), 6) AS share_below,
           round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY n_orders), 6) AS share_upto
    FROM ({MONTHLY})
    WINDOW r AS (PARTITION BY o_orderpriority ORDER BY revenue DESC, month),
           n AS (PARTITION BY o_orderpriority ORDER BY n_orders DESC)
    """,
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP) AS month,
           row_number() OVER r AS place, rank() OVER n AS count_rank, dense_rank() OVER n AS dense_place,
           ntile(4) OVER r AS quarter,
           round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY n_orders), 6) AS share_below,
           round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY n_orders), 6) AS share_upto
    FROM ({MONTHLY})
    WINDOW r AS (PARTITION BY o_orderpriority ORDER BY revenue DESC, month),
           n AS (PARTITION BY o_orderpriority ORDER BY n_orders DESC)
    """,
)

_register(
    "sql_lag_lead",
    ("orders",),
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP_NTZ) AS month, n_orders,
           lag(n_orders) OVER w AS before, lead(n_orders, 2, 0) OVER w AS two_later,
           n_orders - lag(n_orders, 12) OVER w AS yearly_change,
           first_value(n_orders) OVER w AS opening,
           last_value(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY month
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing,
           nth_value(n_orders, 3) OVER w AS third
    FROM ({MONTHLY})
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
    """,
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP) AS month, n_orders,
           lag(n_orders) OVER w AS before, lead(n_orders, 2, 0) OVER w AS two_later,
           n_orders - lag(n_orders, 12) OVER w AS yearly_change,
           first_value(n_orders) OVER w AS opening,
           last_value(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY month
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing,
           nth_value(n_orders, 3) OVER w AS third
    FROM ({MONTHLY})
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
    """,
)

_register(
    "sql_frames",
    ("orders",),
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP_NTZ) AS month,
           CAST(sum(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY month
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_months,
           CAST(sum(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY month
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running,
           CAST(sum(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY n_orders
               RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS similar_months,
           max(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY month
               ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_best
    FROM ({MONTHLY})
    """,
    f"""
    SELECT o_orderpriority, CAST(month AS TIMESTAMP) AS month,
           CAST(sum(n_orders) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_months,
           CAST(sum(n_orders) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
           CAST(sum(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY n_orders
               RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS similar_months,
           max(n_orders) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_best
    FROM ({MONTHLY})
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
    """,
)

_register(
    "sql_topk",
    ("orders",),
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5
    """,
)

_register(
    "sql_topk_per_group",
    ("orders",),
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(place AS BIGINT) AS place
    FROM (
        SELECT o_orderpriority, o_orderkey, o_totalprice,
               row_number() OVER (PARTITION BY o_orderpriority
                                  ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders
    ) WHERE place <= 3
    """,
)

_register(
    "sql_setops",
    ("orders", "customer"),
    """
    SELECT 'both' AS kind, k FROM (
        SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
        INTERSECT
        SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'
    )
    UNION ALL
    SELECT 'without' AS kind, k FROM (
        SELECT c_custkey AS k FROM customer EXCEPT SELECT DISTINCT o_custkey AS k FROM orders
    )
    UNION ALL
    SELECT 'either' AS kind, k FROM (
        SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000
        UNION
        SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0
    )
    """,
)

_register(
    "sql_cte_recursive",
    ("orders",),
    """
    WITH RECURSIVE yearly AS (
        SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, count(*) AS n_orders
        FROM orders GROUP BY CAST(extract(YEAR FROM o_orderdate) AS INT)
    ), years(y, last_year) AS (
        SELECT min(y), max(y) FROM yearly
        UNION ALL
        SELECT y + 1, last_year FROM years WHERE y < last_year
    )
    SELECT years.y, coalesce(yearly.n_orders, 0) AS n_orders
    FROM years LEFT JOIN yearly ON yearly.y = years.y
    """,
)

_register(
    "sql_subqueries",
    ("customer", "orders"),
    """
    SELECT c.c_custkey, c.c_acctbal,
           (SELECT CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS usual_price
    FROM customer c
    WHERE 20 * c.c_acctbal > (SELECT avg(CAST(o.o_totalprice AS DECIMAL(18,2)))
                              FROM orders o WHERE o.o_custkey = c.c_custkey)
    """,
)

_register(
    "sql_distinct",
    ("customer", "orders"),
    """
    SELECT DISTINCT c.c_mktsegment, o.o_orderpriority
    FROM customer c
    JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) o ON o.o_custkey = c.c_custkey
    """,
)

_register(
    "sql_distinct_on",
    ("orders",),
    """
    SELECT o_custkey, o_orderkey, o_orderdate
    FROM (
        SELECT o_custkey, o_orderkey, o_orderdate,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place
        FROM orders
    ) WHERE place = 1
    """,
    """
    SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate
    FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey
    """,
)

_register(
    "sql_strings",
    ("part",),
    """
    SELECT p_partkey, upper(p_name) AS loud, substring(p_name, 1, 3) AS head,
           split_part(p_name, ' ', 2) AS second_word, lpad(CAST(p_size AS STRING), 4, '0') AS padded,
           replace(p_brand, 'Brand#', 'B') AS brand, length(p_name) AS n_chars,
           reverse(p_type) AS backwards, concat_ws('-', p_brand, p_type) AS joined,
           trim('  ' || p_name || ' ') AS trimmed, position('e' IN p_name) AS first_e,
           regexp_replace(p_name, '[aeiou]', '*') AS starred,
           left(p_type, 2) AS two, right(p_type, 2) AS last_two, p_name LIKE 's%' AS starts_s
    FROM part
    """,
    """
    SELECT p_partkey, upper(p_name) AS loud, substring(p_name, 1, 3) AS head,
           split_part(p_name, ' ', 2) AS second_word, lpad(CAST(p_size AS STRING), 4, '0') AS padded,
           replace(p_brand, 'Brand#', 'B') AS brand, CAST(length(p_name) AS INT) AS n_chars,
           reverse(p_type) AS backwards, concat_ws('-', p_brand, p_type) AS joined,
           trim('  ' || p_name || ' ') AS trimmed, CAST(position('e' IN p_name) AS INT) AS first_e,
           regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred,
           left(p_type, 2) AS two, right(p_type, 2) AS last_two, p_name LIKE 's%' AS starts_s
    FROM part
    """,
)

_register(
    "sql_dates",
    ("orders",),
    """
    SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP_NTZ) AS quarter_start,
           CAST(extract(YEAR FROM o_orderdate) AS INT) AS y,
           CAST(extract(MONTH FROM o_orderdate) AS INT) AS m,
           CAST(extract(DAY FROM o_orderdate) AS INT) AS d,
           CAST(extract(DAYOFWEEK_ISO FROM o_orderdate) AS INT) AS weekday,
           CAST(extract(DOY FROM o_orderdate) AS INT) AS day_of_year,
           o_orderdate + INTERVAL 45 DAYS AS due,
           CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age_days,
           date_format(o_orderdate, 'yyyy/MM') AS month_text,
           CAST(make_date(year(o_orderdate), 1, 1) AS TIMESTAMP_NTZ) AS new_year
    FROM orders
    """,
    """
    SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS quarter_start,
           CAST(extract(YEAR FROM o_orderdate) AS INT) AS y,
           CAST(extract(MONTH FROM o_orderdate) AS INT) AS m,
           CAST(extract(DAY FROM o_orderdate) AS INT) AS d,
           CAST(extract(ISODOW FROM o_orderdate) AS INT) AS weekday,
           CAST(extract(DOY FROM o_orderdate) AS INT) AS day_of_year,
           o_orderdate + INTERVAL 45 DAYS AS due,
           DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS age_days,
           strftime(o_orderdate, '%Y/%m') AS month_text,
           CAST(make_date(year(o_orderdate), 1, 1) AS TIMESTAMP) AS new_year
    FROM orders
    """,
)

_register(
    "sql_math",
    ("lineitem",),
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
           CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
           abs(l_discount - l_tax) >= 0.03 AS apart, round(sqrt(l_extendedprice), 6) AS root,
           round(power(l_quantity, 2), 6) AS squared, round(ln(l_quantity + 1), 6) AS logarithm,
           mod(l_partkey, 7) AS remainder, CAST(sign(l_tax - l_discount) AS INT) AS direction,
           greatest(l_quantity, 25) AS at_least, least(l_linenumber, 3) AS at_most
    FROM lineitem
    """,
)

_register(
    "sql_arrays",
    ("embeddings",),
    """
    SELECT vec_id, label, size(embedding) AS n_dims, CAST(element_at(embedding, 1) AS DOUBLE) AS first_dim,
           round(aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x), 5) AS norm2,
           size(filter(embedding, x -> x > 0)) AS n_positive,
           CAST(array_max(embedding) AS DOUBLE) AS top_dim,
           array_join(transform(slice(embedding, 1, 3), x -> CASE WHEN x > 0 THEN '+' ELSE '-' END), '')
               AS signs
    FROM embeddings
    """,
    """
    SELECT vec_id, label, CAST(len(embedding) AS INT) AS n_dims, CAST(embedding[1] AS DOUBLE) AS first_dim,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm2,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n_positive,
           CAST(list_max(embedding) AS DOUBLE) AS top_dim,
           array_to_string(list_transform(embedding[1:3],
               lambda x: CASE WHEN x > 0 THEN '+' ELSE '-' END), '') AS signs
    FROM embeddings
    """,
)

_register(
    "sql_unnest",
    ("embeddings",),
    """
    SELECT label, dim, count(*) AS n_vectors, round(avg(CAST(x AS DOUBLE)), 6) AS mean_value
    FROM embeddings LATERAL VIEW posexplode(embedding) e AS dim, x
    GROUP BY label, dim
    """,
    """
    SELECT label, dim, count(*) AS n_vectors, round(avg(CAST(x AS DOUBLE)), 6) AS mean_value
    FROM (SELECT label, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INT) AS dim
          FROM embeddings)
    GROUP BY label, dim
    """,
)

_register(
    "sql_json_fn",
    ("events",),
    """
    SELECT event_type, k, count(*) AS n_events, max(parsed.k + 1) AS next_k,
           to_json(named_struct('k', k)) AS again
    FROM (SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k,
                 from_json(props, 'k INT') AS parsed FROM events)
    GROUP BY event_type, k
    """,
    """
    SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n_events,
           max(CAST(props->>'k' AS INT) + 1) AS next_k,
           max(CAST(json_object('k', CAST(props->>'k' AS INT)) AS VARCHAR)) AS again
    FROM events GROUP BY ALL
    """,
)

_register(
    "sql_series",
    ("events",),
    """
    WITH hourly AS (
        SELECT date_trunc('hour', ts) AS hour, count(*) AS n_events
        FROM events WHERE event_type = 'error' GROUP BY date_trunc('hour', ts)
    ), hours AS (
        SELECT explode(sequence(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly
    )
    SELECT CAST(hours.hour AS TIMESTAMP_NTZ) AS hour, coalesce(hourly.n_events, 0) AS n_events
    FROM hours LEFT JOIN hourly ON hourly.hour = hours.hour
    """,
    """
    WITH hourly AS (
        SELECT date_trunc('hour', ts) AS hour, count(*) AS n_events
        FROM events WHERE event_type = 'error' GROUP BY ALL
    ), hours AS (
        SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly
    )
    SELECT CAST(hours.hour AS TIMESTAMP) AS hour, coalesce(hourly.n_events, 0) AS n_events
    FROM hours LEFT JOIN hourly ON hourly.hour = hours.hour
    """,
)

# Maps over the few kinds of events; keys in order, since a map has none.
_register(
    "sql_maps",
    ("events",),
    """
    WITH kinds AS (
        SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type
    ), mapped AS (
        SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS counts FROM kinds GROUP BY user_id
    )
    SELECT user_id, CAST(size(counts) AS INT) AS n_kinds, counts['click'] AS n_clicks,
           array_join(array_sort(map_keys(map_filter(counts, (k, n) -> n > 1))), ',') AS repeated,
           array_join(array_sort(transform(map_entries(transform_values(counts, (k, n) -> n * 10)),
                                           e -> concat(e.key, '=', e.value))), ',') AS tenfold,
           map_contains_key(counts, 'error') AS has_error
    FROM mapped
    """,
    """
    WITH kinds AS (
        SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type
    )
    SELECT user_id, CAST(count(*) AS INT) AS n_kinds, max(n) FILTER (event_type = 'click') AS n_clicks,
           coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (n > 1), '') AS repeated,
           string_agg(event_type || '=' || n * 10, ',' ORDER BY event_type) AS tenfold,
           bool_or(event_type = 'error') AS has_error
    FROM kinds GROUP BY user_id
    """,
)
