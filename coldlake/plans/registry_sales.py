"""Registered sales-domain and maintenance queries (A, E, F, G) with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from coldlake import oracle_sql as O
from coldlake.operators import maintenance as M
from coldlake.operators import sales_customers as SC
from coldlake.operators import sales_distributions as SD
from coldlake.operators import sales_filters as SF
from coldlake.operators import sales_kpis as SK
from coldlake.operators import sales_products as SP
from coldlake.operators import sales_trends as ST
from coldlake.plans.catalog import Catalog
from coldlake.plans.registry_ops import corr_sql
from coldlake.sources import fixtures

QUERIES: dict[str, tuple] = {}


def q(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


S = O.sales


def SW(ctes: str, sql: str) -> str:
    return O.sales_with(ctes, sql)


MONTH = "strftime(order_date, '%Y-%m')"

# ------------------------------------------------------------------ A: maintenance


@q("A06_cancel_orders", SW("""
cancelled AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_line_id
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')""", """
SELECT order_line_id, order_id, CAST(revenue AS DOUBLE) AS revenue FROM fo
WHERE order_line_id NOT IN (SELECT order_line_id FROM cancelled)"""))
def _a06(c: Catalog):
    out = M.cancel_lines(c.orders, fixtures.cancelled_lines(c.spark, c.sf_dir))
    return out.select("order_line_id", "order_id", F.col("revenue").cast("double").alias("revenue"))


@q("A07_order_returns", SW("""
returned AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_line_id
             FROM lineitem WHERE l_returnflag = 'R')""", """
SELECT sha256(order_line_id || '|RET') AS order_line_id, order_id || '-RET' AS order_id, -quantity AS quantity,
       CAST(-abs(revenue) AS DOUBLE) AS revenue, CAST(-abs(cost) AS DOUBLE) AS cost,
       CAST(-abs(gross_profit) AS DOUBLE) AS gross_profit, CAST(-abs(net_profit) AS DOUBLE) AS net_profit,
       unit_price, discount_pct, order_date
FROM fo WHERE order_line_id IN (SELECT order_line_id FROM returned)"""))
def _a07(c: Catalog):
    r = M.return_lines(c.orders, fixtures.returned_lines(c.spark, c.sf_dir))
    return r.select("order_line_id", "order_id", "quantity",
                    *[F.col(m).cast("double").alias(m) for m in ("revenue", "cost", "gross_profit", "net_profit")],
                    "unit_price", "discount_pct", "order_date")


@q("A08_retention_purge", S("""
SELECT order_line_id, order_date FROM fo
WHERE order_date >= CAST((SELECT max(order_date) FROM fo) - INTERVAL 720 HOUR AS DATE)"""))
def _a08(c: Catalog):
    as_of = c.orders.agg(F.max(F.col("order_date").cast("timestamp"))).scalar()
    return M.purge_before(c.orders, M.retention_cutoff(as_of)).select("order_line_id", "order_date")


@q("A09_random_sample", S("""
SELECT order_line_id, order_id, revenue FROM fo ORDER BY sha256('42|' || order_line_id), order_line_id LIMIT 50"""))
def _a09(c: Catalog):
    return M.random_sample(c.orders, 50).select("order_line_id", "order_id", "revenue")


@q("A10_row_counts", O.sensor(", " + O.SALES_CTES.strip() + """
SELECT 'fact_order' AS table_name, (SELECT count(*) FROM fo) AS row_count
UNION ALL SELECT 'fact_sensor_reading', (SELECT count(*) FROM fact)
UNION ALL SELECT 'raw_sensor_events', (SELECT count(*) FROM raw)"""))
def _a10(c: Catalog):
    parts = [c.orders.agg(F.lit("fact_order").alias("table_name"), F.count(F.lit(1)).alias("row_count")),
             c.fact.agg(F.lit("fact_sensor_reading").alias("table_name"), F.count(F.lit(1)).alias("row_count")),
             c.raw.agg(F.lit("raw_sensor_events").alias("table_name"), F.count(F.lit(1)).alias("row_count"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("A17_order_lines", S("""
SELECT order_line_id, order_id, order_date, customer_id, product_id, region, state, city, channel, category,
       quantity, unit_price, discount_pct, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
       CAST(gross_profit AS DOUBLE) AS gross_profit, CAST(net_profit AS DOUBLE) AS net_profit, hour
FROM fo"""))
def _a17(c: Catalog):
    from coldlake.schemas import FACT_ORDER
    cols = [f.name for f in FACT_ORDER.fields]
    return c.orders.select(*[F.col(x).cast("double").alias(x) if x in SD.MONEY_COLS else F.col(x) for x in cols])


@q("A19_first_order_date", S("""
SELECT 'C' || c_custkey AS customer_id,
       coalesce((SELECT min(order_date) FROM fo WHERE fo.customer_id = 'C' || c_custkey),
                (SELECT min(order_date) FROM fo)) AS first_order_date
FROM customer"""))
def _a19(c: Catalog):
    return M.first_order_dates(c.dim_customer, c.orders).select("customer_id", "first_order_date")


@q("A20_missing_customers", S("""
SELECT DISTINCT customer_id FROM fo
WHERE customer_id NOT IN (SELECT 'C' || c_custkey FROM customer)"""))
def _a20(c: Catalog):
    return M.missing_members(c.orders, c.dim_customer, "customer_id")


# ------------------------------------------------------------------ E: load and filter

@q("E01_filter_options", """
SELECT DISTINCT 'category' AS kind, p_type AS value FROM part
UNION SELECT DISTINCT 'region', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey
UNION SELECT DISTINCT 'channel', c_mktsegment FROM customer""")
def _e01(c: Catalog):
    return SF.filter_options(c.dim_product, c.dim_customer)


@q("E02_default_date_range", S("""
SELECT CAST(max(order_date) - INTERVAL 1 DAY AS DATE) AS start, max(order_date) AS "end" FROM fo"""))
def _e02(c: Catalog):
    return SF.default_date_range(c.orders)


FILTERS = dict(start="1997-01-01", end="1998-12-31", categories=["ECONOMY", "PROMO"], regions=None,
               channels=["BUILDING", "MACHINERY", "HOUSEHOLD"])


@q("E03_load_orders_filtered", S("""
SELECT order_line_id, order_date, category, channel, CAST(revenue AS DOUBLE) AS revenue FROM fo
WHERE order_date >= DATE '1997-01-01' AND order_date <= DATE '1998-12-31'
  AND category IN ('ECONOMY', 'PROMO') AND channel IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"""))
def _e03(c: Catalog):
    return SF.load_orders(c.orders, **FILTERS).select("order_line_id", "order_date", "category", "channel",
                                                      F.col("revenue").cast("double").alias("revenue"))


@q("E04_period_labels", S("""
SELECT order_line_id, strftime(order_date, '%Y-%m') AS month,
       CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter,
       CAST(year(order_date) AS VARCHAR) AS year FROM fo"""))
def _e04(c: Catalog):
    o = c.orders
    for p in ("month", "quarter", "year"):
        o = SF.with_period(o, p, p)
    return o.select("order_line_id", "month", "quarter", "year")


# ------------------------------------------------------------------ F: calculations

@q("F01_kpis", SW("""
m AS (SELECT strftime(order_date, '%Y-%m') AS p, sum(revenue) AS rev, sum(net_profit) AS net,
             count(DISTINCT customer_id) AS cust FROM fo GROUP BY 1),
d AS (SELECT CAST(order_date AS VARCHAR) AS p, sum(revenue) AS rev, sum(net_profit) AS net,
             count(DISTINCT customer_id) AS cust FROM fo GROUP BY 1),
mr AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS rn FROM m),
dr AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS rn FROM d),
mg AS (SELECT CASE WHEN b.rev = 0 THEN 0.0 ELSE (a.rev::DOUBLE - b.rev::DOUBLE) / b.rev::DOUBLE * 100.0 END AS rg,
              CASE WHEN b.net = 0 THEN 0.0 ELSE (a.net::DOUBLE - b.net::DOUBLE) / b.net::DOUBLE * 100.0 END AS ng,
              CASE WHEN b.cust = 0 THEN 0.0 ELSE (a.cust::DOUBLE - b.cust::DOUBLE) / b.cust::DOUBLE * 100.0 END AS cg
       FROM mr a JOIN mr b ON a.rn = 1 AND b.rn = 2),
dg AS (SELECT CASE WHEN b.rev = 0 THEN 0.0 ELSE (a.rev::DOUBLE - b.rev::DOUBLE) / b.rev::DOUBLE * 100.0 END AS rg,
              CASE WHEN b.net = 0 THEN 0.0 ELSE (a.net::DOUBLE - b.net::DOUBLE) / b.net::DOUBLE * 100.0 END AS ng,
              CASE WHEN b.cust = 0 THEN 0.0 ELSE (a.cust::DOUBLE - b.cust::DOUBLE) / b.cust::DOUBLE * 100.0 END AS cg
       FROM dr a JOIN dr b ON a.rn = 1 AND b.rn = 2),
g AS (SELECT CASE WHEN (SELECT count(*) FROM m) >= 2 THEN (SELECT rg FROM mg)
                  WHEN (SELECT count(*) FROM d) >= 2 THEN (SELECT rg FROM dg) ELSE 0.0 END AS rg,
             CASE WHEN (SELECT count(*) FROM m) >= 2 THEN (SELECT ng FROM mg)
                  WHEN (SELECT count(*) FROM d) >= 2 THEN (SELECT ng FROM dg) ELSE 0.0 END AS ng,
             CASE WHEN (SELECT count(*) FROM m) >= 2 THEN (SELECT cg FROM mg)
                  WHEN (SELECT count(*) FROM d) >= 2 THEN (SELECT cg FROM dg) ELSE 0.0 END AS cg)""", """
SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS transactions,
       count(DISTINCT customer_id) AS customers,
       round_even(sum(revenue)::DOUBLE / count(DISTINCT order_id), 2) AS aov,
       CAST(sum(gross_profit) AS DOUBLE) AS gross_profit,
       round_even(100.0::DOUBLE * sum(gross_profit)::DOUBLE / sum(revenue)::DOUBLE, 1) AS gross_margin,
       CAST(sum(net_profit) AS DOUBLE) AS net_profit,
       round_even(100.0::DOUBLE * sum(net_profit)::DOUBLE / sum(revenue)::DOUBLE, 1) AS net_margin,
       round_even(greatest(least((SELECT rg FROM g), 200.0), -200.0), 1) AS revenue_growth,
       round_even(greatest(least((SELECT ng FROM g), 200.0), -200.0), 1) AS profit_growth,
       round_even(greatest(least((SELECT cg FROM g), 200.0), -200.0), 1) AS customer_growth,
       round_even(sum(revenue)::DOUBLE / count(DISTINCT customer_id), 2) AS arpc
FROM fo"""))
def _f01(c: Catalog):
    return SK.kpis(c.orders)


def _period_sql(label: str, measure: str = "revenue") -> str:
    return S(f"""
SELECT {label} AS period, CAST(sum({measure}) AS DOUBLE) AS {measure} FROM fo GROUP BY 1""")


@q("F02_revenue_by_month", _period_sql(MONTH))
def _f02(c: Catalog):
    return ST.revenue_by_period(c.orders, "month")


@q("F02_revenue_by_quarter", _period_sql("CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)"))
def _f02q(c: Catalog):
    return ST.revenue_by_period(c.orders, "quarter")


@q("F02_revenue_by_year", _period_sql("CAST(year(order_date) AS VARCHAR)"))
def _f02y(c: Catalog):
    return ST.revenue_by_period(c.orders, "year")


@q("F03_profit_by_month", S(f"""
SELECT {MONTH} AS period, CAST(sum(gross_profit) AS DOUBLE) AS gross_profit,
       CAST(sum(net_profit) AS DOUBLE) AS net_profit FROM fo GROUP BY 1"""))
def _f03(c: Catalog):
    return ST.profit_by_month(c.orders)


def _target_sql(measure: str) -> str:
    return S(f"""
SELECT period, CAST(v AS DOUBLE) AS {measure},
       CAST(round_even(coalesce(lag(v) OVER (ORDER BY period), v) * 1.1, 2) AS DOUBLE) AS target
FROM (SELECT {MONTH} AS period, sum({measure}) AS v FROM fo GROUP BY 1)""")


@q("F04_sales_vs_target", _target_sql("revenue"))
def _f04(c: Catalog):
    return ST.sales_vs_target(c.orders)


@q("F05_profit_vs_target", _target_sql("net_profit"))
def _f05(c: Catalog):
    return ST.profit_vs_target(c.orders)


def _sum_sql(key: str, measure: str = "revenue", alias: str | None = None) -> str:
    return S(f"""
SELECT {key} AS {alias or key}, CAST(sum({measure}) AS DOUBLE) AS {measure} FROM fo GROUP BY 1""")


@q("F06_revenue_by_category", _sum_sql("category"))
def _f06(c: Catalog):
    return SP.revenue_by_category(c.orders)


def _top_products_sql(measure: str, direction: str, limit: int) -> str:
    return S(f"""
SELECT product_id, category, CAST(sum({measure}) AS DOUBLE) AS {measure} FROM fo GROUP BY 1, 2
ORDER BY sum({measure}) {direction}, product_id, category LIMIT {limit}""")


@q("F07_revenue_by_product", _top_products_sql("revenue", "DESC", 15))
def _f07(c: Catalog):
    return SP.revenue_by_product(c.orders)


@q("F08_profit_by_product", _top_products_sql("gross_profit", "DESC", 15))
def _f08(c: Catalog):
    return SP.profit_by_product(c.orders)


@q("F09_sales_by_region", S("""
SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, region AS state,
       CASE region WHEN 'West' THEN 19.5 WHEN 'North' THEN 29.0 WHEN 'South' THEN 13.0 WHEN 'East' THEN 22.5
            ELSE 20.0 END::DOUBLE AS lat,
       CASE region WHEN 'West' THEN 73.0 WHEN 'North' THEN 77.0 WHEN 'South' THEN 78.0 WHEN 'East' THEN 87.0
            ELSE 78.0 END::DOUBLE AS lon
FROM fo GROUP BY region"""))
def _f09(c: Catalog):
    return SP.sales_by_region(c.orders)


@q("F10_revenue_by_state", _sum_sql("state"))
def _f10(c: Catalog):
    return SP.revenue_by_state(c.orders)


@q("F11_customer_distribution", S("""
SELECT region, count(DISTINCT customer_id) AS customers FROM fo GROUP BY region"""))
def _f11(c: Catalog):
    return SC.customer_distribution(c.orders)


@q("F12_active_customers_by_month", S(f"""
SELECT DISTINCT {MONTH} AS period, customer_id FROM fo"""))
def _f12(c: Catalog):
    return SC.active_by_period(c.orders)


@q("F13_new_vs_returning", S(f"""
SELECT period, count(*) FILTER (WHERE period = first_p) AS new, count(*) FILTER (WHERE period <> first_p) AS returning
FROM (SELECT {MONTH} AS period, min({MONTH}) OVER (PARTITION BY customer_id) AS first_p FROM fo) GROUP BY period"""))
def _f13(c: Catalog):
    return SC.new_vs_returning(c.orders)


RETENTION_CTE = f"""
act AS (SELECT DISTINCT {MONTH} AS period, customer_id FROM fo),
mon AS (SELECT period, row_number() OVER (ORDER BY period) AS r FROM (SELECT DISTINCT period FROM act)),
cur AS (SELECT a.customer_id, m.r, m.period FROM act a JOIN mon m USING (period)),
ret AS (
  SELECT m.period, m.r,
         (SELECT count(*) FROM cur p WHERE p.r = m.r - 1) AS prev_n,
         (SELECT count(*) FROM cur p JOIN cur c2 ON p.customer_id = c2.customer_id AND p.r = m.r - 1 AND c2.r = m.r)
           AS kept
  FROM mon m),
retention AS (
  SELECT period,
         CASE WHEN r = 1 OR prev_n = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * kept / prev_n, 1) END AS retention,
         CASE WHEN r = 1 OR prev_n = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * (prev_n - kept) / prev_n, 1) END AS churn
  FROM ret)"""


@q("F14_retention_rate", SW(RETENTION_CTE, "SELECT period, retention, churn FROM retention"))
def _f14(c: Catalog):
    return SC.retention_rate(c.orders)


@q("F15_clv", S("""
SELECT coalesce(round_even(sum(revenue)::DOUBLE / count(DISTINCT customer_id), 2), 0.0) AS clv FROM fo"""))
def _f15(c: Catalog):
    return SC.clv(c.orders)


PER_CUSTOMER = "per_c AS (SELECT customer_id, count(DISTINCT order_id) AS orders, sum(revenue) AS revenue FROM fo GROUP BY 1)"


@q("F16_repeat_purchase_rate", SW(PER_CUSTOMER, """
SELECT coalesce(round_even(100.0::DOUBLE * count(*) FILTER (WHERE orders > 1) / count(*), 1), 0.0) AS repeat_rate
FROM per_c"""))
def _f16(c: Catalog):
    return SC.repeat_purchase_rate(c.orders)


@q("F17_bottom_products", _top_products_sql("revenue", "ASC", 10))
def _f17(c: Catalog):
    return SP.bottom_products(c.orders)


@q("F18_sales_by_channel", _sum_sql("channel"))
def _f18(c: Catalog):
    return SP.sales_by_channel(c.orders)


@q("F19_top_customers", S("""
SELECT customer_id, arg_min(region, (order_date, order_line_id)) FILTER (WHERE region IS NOT NULL) AS region,
       CAST(sum(revenue) AS DOUBLE) AS revenue
FROM fo GROUP BY customer_id ORDER BY sum(revenue) DESC, customer_id LIMIT 10"""))
def _f19(c: Catalog):
    return SC.top_customers(c.orders)


@q("F20_channel_profitability", S("""
SELECT channel, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(gross_profit) AS DOUBLE) AS gross_profit,
       CAST(sum(net_profit) AS DOUBLE) AS net_profit FROM fo GROUP BY channel"""))
def _f20(c: Catalog):
    return SP.channel_profitability(c.orders)


def _proj_sql(x: str, y: str) -> str:
    def e(col):
        return f"CAST({col} AS DOUBLE) AS {col}" if col in SD.MONEY_COLS else col
    return S(f"SELECT {e(x)}, {e(y)} FROM fo")


for _name, _x, _y in [("F21_discount_vs_revenue", "discount_pct", "revenue"),
                      ("F21_discount_vs_profit", "discount_pct", "net_profit"),
                      ("F21_discount_vs_quantity", "discount_pct", "quantity"),
                      ("F22_quantity_vs_revenue", "quantity", "revenue"),
                      ("F22_revenue_vs_profit", "revenue", "net_profit"),
                      ("F22_price_vs_quantity", "unit_price", "quantity")]:
    QUERIES[_name] = ((lambda x, y: (lambda c: SD.projection(c.orders, x, y)))(_x, _y), _proj_sql(_x, _y))


def _dist_sql(values_cte: str) -> str:
    """Equal-width buckets with Python floor-division: round((a - a % step) / step), % being IEEE fmod."""
    return SW(values_cte + """,
st AS (SELECT min(x) AS lo, max(x) AS hi FROM v)""", """
SELECT CAST(round_even(CAST(CASE WHEN st.lo = st.hi THEN st.lo
            ELSE round((x - st.lo - ((x - st.lo) % ((st.hi - st.lo) / 20.0)))
                       / ((st.hi - st.lo) / 20.0)) * ((st.hi - st.lo) / 20.0) + st.lo END
            AS DECIMAL(38,10)), 2) AS DOUBLE) AS bucket,
       count(*) AS count
FROM v, st GROUP BY 1""")


@q("F23_equal_width_distribution", _dist_sql("v AS (SELECT CAST(quantity AS DOUBLE) AS x FROM fo)"))
def _f23(c: Catalog):
    return SD.equal_width_distribution(c.orders, "quantity")


@q("F24_revenue_distribution", _dist_sql("v AS (SELECT CAST(revenue AS DOUBLE) AS x FROM fo)"))
def _f24r(c: Catalog):
    return SD.revenue_distribution(c.orders)


@q("F24_profit_distribution", _dist_sql("v AS (SELECT CAST(net_profit AS DOUBLE) AS x FROM fo)"))
def _f24p(c: Catalog):
    return SD.profit_distribution(c.orders)


@q("F25_customer_spend_distribution", _dist_sql(
    "v AS (SELECT CAST(sum(revenue) AS DOUBLE) AS x FROM fo GROUP BY customer_id)"))
def _f25(c: Catalog):
    return SD.customer_spend_distribution(c.orders)


@q("F26_price_distribution", _dist_sql("v AS (SELECT unit_price AS x FROM fo)"))
def _f26(c: Catalog):
    return SD.price_distribution(c.orders)


@q("F27_margin_distribution", _dist_sql(
    "v AS (SELECT CAST(net_profit AS DOUBLE) / CAST(revenue AS DOUBLE) * 100.0 AS x FROM fo WHERE revenue <> 0)"))
def _f27(c: Catalog):
    return SD.margin_distribution(c.orders)


@q("F28_kpi_heatmap", S(f"""
SELECT category, {MONTH} AS period, CAST(sum(revenue) AS DOUBLE) AS revenue FROM fo GROUP BY 1, 2"""))
def _f28(c: Catalog):
    return SD.kpi_heatmap(c.orders)


@q("F30_sales_by_hour", S("""
SELECT CAST(CAST('0x' || substr(sha256(order_id), 1, 8) AS BIGINT) % 24 AS INTEGER) AS hour,
       CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM fo GROUP BY 1"""))
def _f30(c: Catalog):
    return ST.sales_by_hour(c.orders)


@q("F31_sales_by_day", S("SELECT CAST(day(order_date) AS INTEGER) AS day, count(*) AS orders FROM fo GROUP BY 1"))
def _f31(c: Catalog):
    return ST.sales_by_day(c.orders)


@q("F32_sales_by_dow", S("""
SELECT dayname(order_date) AS weekday, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM fo GROUP BY 1"""))
def _f32(c: Catalog):
    return ST.sales_by_dow(c.orders)


@q("F33_customers_vs_revenue", SW(PER_CUSTOMER, """
SELECT customer_id, orders, CAST(revenue AS DOUBLE) AS revenue FROM per_c"""))
def _f33(c: Catalog):
    return SC.customers_vs_revenue(c.orders)


@q("F34_correlation_matrix", S(corr_sql("fo", SD.SALES_CORR_COLUMNS)))
def _f34(c: Catalog):
    return SD.sales_correlation_matrix(c.orders)


@q("F35_cohort_retention", S(f"""
SELECT first_p AS cohort, period AS month, count(DISTINCT customer_id) AS customers
FROM (SELECT customer_id, {MONTH} AS period, min({MONTH}) OVER (PARTITION BY customer_id) AS first_p FROM fo)
GROUP BY 1, 2"""))
def _f35(c: Catalog):
    return SC.cohort_retention(c.orders)


def _waterfall_sql(measure: str) -> str:
    return S(f"""
SELECT period, CAST(v AS DOUBLE) AS {measure}, CAST(coalesce(v - lag(v) OVER (ORDER BY period), v) AS DOUBLE) AS change
FROM (SELECT {MONTH} AS period, sum({measure}) AS v FROM fo GROUP BY 1)""")


@q("F36_revenue_waterfall", _waterfall_sql("revenue"))
def _f36(c: Catalog):
    return ST.revenue_waterfall(c.orders)


@q("F37_profit_waterfall", _waterfall_sql("net_profit"))
def _f37(c: Catalog):
    return ST.profit_waterfall(c.orders)


@q("F38_sales_funnel", SW(PER_CUSTOMER, """
SELECT 'Total Order Lines' AS stage, (SELECT count(*) FROM fo) AS value
UNION ALL SELECT 'Unique Orders', (SELECT count(DISTINCT order_id) FROM fo)
UNION ALL SELECT 'Unique Customers', (SELECT count(DISTINCT customer_id) FROM fo)
UNION ALL SELECT 'Repeat Customers', (SELECT count(*) FROM per_c WHERE orders > 1)"""))
def _f38(c: Catalog):
    return SK.sales_funnel(c.orders)


@q("F39_pareto", S("""
SELECT product_id, CAST(rev AS DOUBLE) AS revenue,
       CAST(sum(rev) OVER (ORDER BY rev DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         AS cumulative_revenue,
       CASE WHEN sum(rev) OVER () = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE *
         CAST(sum(rev) OVER (ORDER BY rev DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / CAST(sum(rev) OVER () AS DOUBLE), 1) END AS cumulative_pct
FROM (SELECT product_id, sum(revenue) AS rev FROM fo GROUP BY 1)"""))
def _f39(c: Catalog):
    return SP.pareto(c.orders)


@q("F40_advanced_kpis", SW(PER_CUSTOMER, """
SELECT count(DISTINCT order_id) AS total_orders, round_even(avg(quantity), 1) AS avg_qty,
       round_even(avg(discount_pct) * 100.0, 1) AS avg_disc, CAST(sum(cost) AS DOUBLE) AS total_cost,
       (SELECT round_even(100.0::DOUBLE * count(*) FILTER (WHERE orders > 1) / count(*), 1) FROM per_c) AS repeat_rate,
       (SELECT round_even(sum(revenue)::DOUBLE / count(*), 2) FROM per_c) AS clv
FROM fo"""))
def _f40(c: Catalog):
    return SK.advanced_kpis(c.orders)


@q("F41_realtime_metrics", S("""
SELECT count(DISTINCT order_id) AS orders_last_min, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue_last_min,
       count(DISTINCT customer_id) AS active_customers
FROM fo WHERE CAST(order_date AS TIMESTAMP) >= (SELECT max(CAST(order_date AS TIMESTAMP)) FROM fo) - INTERVAL 1 MINUTE"""))
def _f41(c: Catalog):
    return ST.realtime_metrics(c.orders)


@q("F42_hourly_trends", S("""
SELECT CAST(hour(CAST(order_date AS TIMESTAMP)) AS INTEGER) AS hour, CAST(sum(revenue) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders FROM fo GROUP BY 1"""))
def _f42(c: Catalog):
    return ST.hourly_trends(c.orders)


@q("F43_daily_trends", S("""
SELECT order_date AS date, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM fo GROUP BY 1"""))
def _f43(c: Catalog):
    return ST.daily_trends(c.orders)


@q("F44_weekly_trends", S("""
SELECT strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/' ||
       strftime(date_trunc('week', order_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
       CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM fo GROUP BY 1"""))
def _f44(c: Catalog):
    return ST.weekly_trends(c.orders)


def _share_sql(key: str) -> str:
    return S(f"""
SELECT {key}, CAST(v AS DOUBLE) AS revenue,
       CASE WHEN sum(v) OVER () = 0 THEN 0.0
            ELSE round_even(100.0::DOUBLE * CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 1) END AS share_pct
FROM (SELECT {key}, sum(revenue) AS v FROM fo GROUP BY 1)""")


@q("F45_channel_share", _share_sql("channel"))
def _f45(c: Catalog):
    return SP.channel_share(c.orders)


@q("F46_category_share", _share_sql("category"))
def _f46(c: Catalog):
    return SP.category_share(c.orders)


def _growth_sql(label: str) -> str:
    return S(f"""
SELECT period, round_even(rev, 2) AS revenue, round_even(CASE
         WHEN prev IS NULL THEN 0.0
         WHEN prev = 0 AND rev = 0 THEN NULL
         WHEN prev = 0 THEN CASE WHEN rev > 0 THEN 999.9 ELSE -999.9 END
         ELSE greatest(least((rev / prev - 1.0) * 100.0, 999.9), -999.9) END, 6) AS growth_pct
FROM (SELECT period, rev, lag(rev) OVER (ORDER BY period) AS prev
      FROM (SELECT {label} AS period, CAST(sum(revenue) AS DOUBLE) AS rev FROM fo GROUP BY 1))""")


@q("F47_mom_growth", _growth_sql(MONTH))
def _f47(c: Catalog):
    return ST.mom_growth(c.orders)


@q("F48_yoy_growth", _growth_sql("CAST(year(order_date) AS VARCHAR)"))
def _f48(c: Catalog):
    return ST.yoy_growth(c.orders)


SEGMENTS_SQL = """
SELECT s.segment, count(p.customer_id) AS customers, CAST(coalesce(sum(p.revenue), 0) AS DOUBLE) AS revenue
FROM (VALUES ('Low', {e0}, {e1}), ('Medium', {e1}, {e2}), ('High', {e2}, {e3}), ('VIP', {e3}, NULL))
       s(segment, lo, hi)
LEFT JOIN per_c p ON p.revenue > s.lo AND (s.hi IS NULL OR p.revenue <= s.hi)
GROUP BY s.segment"""


@q("F49_customer_segments", SW(PER_CUSTOMER, SEGMENTS_SQL.format(e0=0, e1=200, e2=500, e3=1000)))
def _f49(c: Catalog):
    return SC.customer_segments(c.orders)


# The fixture's customers all spend far more than the default edges; a second registration
# uses edges inside the data so every segment is populated.
WIDE_EDGES = [0.0, 1500000.0, 2500000.0, 3500000.0, float("inf")]


@q("F49_customer_segments_wide", SW(PER_CUSTOMER, SEGMENTS_SQL.format(e0=0, e1=1500000, e2=2500000, e3=3500000)))
def _f49w(c: Catalog):
    return SC.customer_segments(c.orders, edges=WIDE_EDGES)


@q("F50_discount_impact", S("""
SELECT CAST(round_even(discount_pct * 100.0, 0) AS INTEGER) AS discount_bucket, CAST(sum(revenue) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders FROM fo GROUP BY 1"""))
def _f50(c: Catalog):
    return SP.discount_impact(c.orders)


@q("F51_basket_size", S("""
SELECT basket_size, count(*) AS orders FROM (SELECT order_id, CAST(sum(quantity) AS BIGINT) AS basket_size
                                             FROM fo GROUP BY 1)
GROUP BY 1"""))
def _f51(c: Catalog):
    return SP.basket_size(c.orders)


def _margin_sql(key: str, sums: bool = False) -> str:
    extra = ("CAST(sum(gross_profit) AS DOUBLE) AS gross_profit, CAST(sum(net_profit) AS DOUBLE) AS net_profit, "
             "CAST(sum(revenue) AS DOUBLE) AS revenue, ") if sums else ""
    return S(f"""
SELECT {key}, {extra}
       round_even(100.0::DOUBLE * CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0), 1)
         AS gross_margin,
       round_even(100.0::DOUBLE * CAST(sum(net_profit) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0), 1)
         AS net_margin
FROM fo GROUP BY {key}""")


@q("F52_category_margin", _margin_sql("category"))
def _f52(c: Catalog):
    return SP.category_margin(c.orders)


@q("F53_channel_margin", _margin_sql("channel"))
def _f53(c: Catalog):
    return SP.channel_margin(c.orders)


@q("F54_regional_performance", S("""
SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders,
       count(DISTINCT customer_id) AS customers FROM fo GROUP BY region"""))
def _f54(c: Catalog):
    return SP.regional_performance(c.orders)


@q("F55_top_deals", S("""
SELECT order_id, CAST(sum(revenue) AS DOUBLE) AS revenue, round_even(avg(discount_pct), 6) AS discount_pct
FROM fo GROUP BY order_id ORDER BY sum(revenue) DESC, order_id LIMIT 10"""))
def _f55(c: Catalog):
    return SP.top_deals(c.orders)


@q("F56_order_frequency", SW(PER_CUSTOMER, """
SELECT orders AS frequency, count(*) AS customers FROM per_c GROUP BY 1"""))
def _f56(c: Catalog):
    return SC.order_frequency(c.orders)


# ------------------------------------------------------------------ G: values computed in the pages

@q("G01_net_profit_by_category", _sum_sql("category", "net_profit"))
def _g01(c: Catalog):
    return SP.net_profit_by_category(c.orders)


@q("G02_customers_by_state", S("""
SELECT state, count(DISTINCT customer_id) AS customers FROM fo GROUP BY state"""))
def _g02(c: Catalog):
    return SP.customers_by_state(c.orders)


@q("G03_regional_margins", _margin_sql("region", sums=True))
def _g03(c: Catalog):
    return SP.regional_margins(c.orders)


@q("G04_latest_orders", S("""
SELECT order_id, order_date, customer_id, category, channel, quantity, CAST(revenue AS DOUBLE) AS revenue, discount_pct
FROM fo ORDER BY order_date DESC, order_line_id DESC LIMIT 50"""))
def _g04(c: Catalog):
    return SP.latest_orders(c.orders)


def _exec_score_sql() -> str:
    f01 = QUERIES["F01_kpis"][1]
    cut = f01.rindex("\nSELECT CAST(sum(revenue)")
    ctes, kpi_select = f01[:cut], f01[cut:]
    return (ctes + ",\n" + RETENTION_CTE.strip() + ",\n" + PER_CUSTOMER + ",\nkpi AS (" + kpi_select + "),\n"
            + """score AS (
  SELECT round_even((0.25 * least(k.gross_margin / 60.0, 1.0)
          + 0.20 * least(greatest(k.revenue_growth, 0.0) / 20.0, 1.0)
          + 0.20 * least(k.net_margin / 40.0, 1.0)
          + 0.20 * least(coalesce((SELECT avg(retention) FROM retention), 0.0) / 80.0, 1.0)
          + 0.15 * least((SELECT round_even(100.0::DOUBLE * count(*) FILTER (WHERE orders > 1) / count(*), 1)
                          FROM per_c) / 100.0, 1.0)) * 100.0, 1) AS executive_score
  FROM kpi k)
""")


@q("F29_executive_score", _exec_score_sql() + "SELECT executive_score FROM score")
def _f29(c: Catalog):
    return SK.executive_score(c.orders)


@q("G05_score_band", _exec_score_sql() + """
SELECT executive_score, CASE WHEN executive_score >= 70 THEN 'POSITIVE' WHEN executive_score >= 50 THEN 'NEUTRAL'
                             ELSE 'NEGATIVE' END AS band FROM score""")
def _g05(c: Catalog):
    s = SK.executive_score(c.orders)
    return s.select("executive_score", SP.score_band(F.col("executive_score")).alias("band"))


@q("A18_denormalize_lines", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_line_id, r_name AS region,
       n_name AS state, n_name AS city, c_mktsegment AS channel, p_type AS category
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
     JOIN part ON l_partkey = p_partkey""")
def _a18(c: Catalog):
    li = fixtures.read_table(c.spark, c.sf_dir, "lineitem")
    o = fixtures.read_table(c.spark, c.sf_dir, "orders")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_line_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"))
    out = M.denormalize_lines(lines, c.dim_customer, c.dim_product)
    return out.select("order_line_id", "region", "state", "city", "channel", "category")
