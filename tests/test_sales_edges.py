"""Hand-row edge cases of the sales calculations."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coldlake.operators import sales_customers as SC
from coldlake.operators import sales_distributions as SD
from coldlake.operators import sales_kpis as SK
from coldlake.operators import sales_products as SP
from coldlake.operators import sales_trends as ST
from coldlake.schemas import FACT_ORDER


def _orders(spark, rows):
    """rows: (line, order, date, customer, revenue[, net]) -> fact_order frame."""
    data = []
    for r in rows:
        line, order, d, cust, rev = r[:5]
        net = r[5] if len(r) > 5 else rev / 2
        data.append((line, order, d, cust, "P1", "West", "S", "C", "Online", "Dairy", 1, float(rev), 0.1,
                     Decimal(str(rev)), Decimal("0"), Decimal(str(rev)), Decimal(str(net)), 12))
    return spark.createDataFrame(data, FACT_ORDER)


def test_growth_falls_back_to_days_within_one_month(spark):
    df = _orders(spark, [("1", "o1", date(2024, 3, 1), "a", 100), ("2", "o2", date(2024, 3, 2), "b", 150)])
    k = SK.kpis(df).collect()[0]
    assert k["revenue"] == 250.0 and k["revenue_growth"] == 50.0 and k["customer_growth"] == 0.0
    one = _orders(spark, [("1", "o1", date(2024, 3, 1), "a", 100)])
    assert SK.kpis(one).collect()[0]["revenue_growth"] == 0.0


def test_growth_clamped_and_previous_zero(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 5), "a", 10), ("2", "o2", date(2024, 2, 5), "a", 100)])
    assert SK.kpis(df).collect()[0]["revenue_growth"] == 200.0
    z = _orders(spark, [("1", "o1", date(2024, 1, 5), "a", 0), ("2", "o2", date(2024, 2, 5), "a", 100),
                        ("3", "o3", date(2024, 3, 5), "a", 0), ("4", "o4", date(2024, 5, 5), "a", 0)])
    g = {r["period"]: r["growth_pct"] for r in ST.mom_growth(z).collect()}
    assert g == {"2024-01": 0.0, "2024-02": 999.9, "2024-03": -100.0, "2024-05": None}


def test_targets_use_previous_observed_month(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 5), "a", 100), ("2", "o2", date(2024, 3, 5), "a", 200)])
    t = [(r["period"], r["target"]) for r in ST.sales_vs_target(df).collect()]
    assert t == [("2024-01", 110.0), ("2024-03", 110.0)]
    w = [(r["period"], r["change"]) for r in ST.revenue_waterfall(df).collect()]
    assert w == [("2024-01", 100.0), ("2024-03", 100.0)]


def test_single_value_distribution_and_max_bucket(spark):
    df = _orders(spark, [(str(i), f"o{i}", date(2024, 1, 1), "a", 5) for i in range(3)])
    assert [(r["bucket"], r["count"]) for r in SD.revenue_distribution(df).collect()] == [(5.0, 3)]
    df2 = _orders(spark, [(str(i), f"o{i}", date(2024, 1, 1), "a", v) for i, v in enumerate([0, 1, 2, 10])])
    b = {r["bucket"]: r["count"] for r in SD.revenue_distribution(df2, bins=5).collect()}
    assert b == {0.0: 2, 2.0: 1, 10.0: 1}


@pytest.mark.parametrize("spend,segment", [(200, "Low"), (200.01, "Medium"), (500, "Medium"), (1000, "High"),
                                           (1000.01, "VIP")])
def test_segment_edges_are_right_closed(spark, spend, segment):
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", spend), ("2", "o2", date(2024, 1, 1), "z", 0)])
    seg = {r["segment"]: r["customers"] for r in SC.customer_segments(df).collect()}
    assert seg[segment] == 1 and sum(seg.values()) == 1 and len(seg) == 4


def test_retention_and_new_vs_returning(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", 1), ("2", "o2", date(2024, 1, 2), "b", 1),
                         ("3", "o3", date(2024, 2, 1), "a", 1), ("4", "o4", date(2024, 2, 1), "a", 1),
                         ("5", "o5", date(2024, 4, 1), "c", 1)])
    r = {x["period"]: (x["retention"], x["churn"]) for x in SC.retention_rate(df).collect()}
    assert r == {"2024-01": (0.0, 0.0), "2024-02": (50.0, 50.0), "2024-04": (0.0, 100.0)}
    nr = {x["period"]: (x["new"], x["returning"]) for x in SC.new_vs_returning(df).collect()}
    assert nr == {"2024-01": (2, 0), "2024-02": (0, 2), "2024-04": (1, 0)}
    coh = {(x["cohort"], x["month"]): x["customers"] for x in SC.cohort_retention(df).collect()}
    assert coh[("2024-01", "2024-01")] == 2 and coh[("2024-01", "2024-02")] == 1


def test_pareto_prefix_sum_matches_running_total(spark):
    df = _orders(spark, [(str(i), f"o{i}", date(2024, 1, 1), "a", v) for i, v in enumerate([5, 3, 3, 9, 0])])
    df = df.withColumn("product_id", F.concat(F.lit("P"), F.col("order_line_id")))
    p = [(r["product_id"], r["cumulative_revenue"], r["cumulative_pct"]) for r in
         SP.pareto(df).orderBy(F.col("cumulative_revenue"), "product_id").collect()]
    assert p == [("P3", 9.0, 45.0), ("P0", 14.0, 70.0), ("P1", 17.0, 85.0), ("P2", 20.0, 100.0),
                 ("P4", 20.0, 100.0)]


def test_empty_input_gives_empty_frames_or_zero_rows(spark):
    empty = spark.createDataFrame([], FACT_ORDER)
    k = SK.kpis(empty).collect()[0]
    assert k["revenue"] == 0.0 and k["transactions"] == 0 and k["revenue_growth"] == 0.0
    assert SK.executive_score(empty).collect()[0]["executive_score"] == 0.0
    assert ST.revenue_by_period(empty).count() == 0
    assert SD.revenue_distribution(empty).count() == 0
    seg = SC.customer_segments(empty).collect()
    assert [r["customers"] for r in seg] == [0, 0, 0, 0]
    assert SP.channel_share(empty).count() == 0


def test_unknown_region_gets_default_position(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", 1)])
    r = SP.sales_by_region(df.withColumn("region", F.lit("Atlantis"))).collect()[0]
    assert (r["lat"], r["lon"]) == (20.0, 78.0)
    r = SP.sales_by_region(df).collect()[0]
    assert (r["lat"], r["lon"]) == (19.5, 73.0)


def test_derive_line_measures_hand_row(spark):
    from coldlake.operators import maintenance as M
    lines = spark.createDataFrame([("L1", "P1", 3, 10.0, 0.1)],
                                  "order_line_id string, product_id string, quantity int, unit_price double, "
                                  "discount_pct double")
    products = spark.createDataFrame([("P1", 6.0)], "product_id string, unit_cost double")
    r = M.derive_line_measures(lines, products).collect()[0]
    assert (r["revenue"], r["cost"], r["gross_profit"], r["net_profit"]) == (
        Decimal("27.00"), Decimal("18.00"), Decimal("9.00"), Decimal("6.84"))


def test_load_orders_filters(spark):
    from coldlake.operators import sales_filters as SF
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", 1), ("2", "o2", date(2024, 1, 31), "b", 2),
                         ("3", "o3", date(2024, 2, 1), "c", 3)])
    assert SF.load_orders(df, categories=[], regions=[], channels=[]).count() == 3
    assert SF.load_orders(df, start="2024-01-01", end="2024-01-31").count() == 2
    assert SF.load_orders(df, categories=["Dairy"], regions=["North"]).count() == 0
    r = SF.default_date_range(df).collect()[0]
    assert (r["start"], r["end"]) == (date(2024, 1, 31), date(2024, 2, 1))
    empty = SF.default_date_range(spark.createDataFrame([], FACT_ORDER)).collect()[0]
    assert empty["end"] is not None and (empty["end"] - empty["start"]).days == 1


def test_wide_pivots_take_explicit_columns(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", 10), ("2", "o2", date(2024, 2, 1), "a", 20),
                         ("3", "o3", date(2024, 2, 1), "b", 5)])
    coh = SC.cohort_pivot(SC.cohort_retention(df), ["2024-01", "2024-02", "2024-03"]).collect()
    assert [tuple(r) for r in coh] == [("2024-01", 1, 1, 0), ("2024-02", 0, 1, 0)]
    hm = SD.heatmap_pivot(SD.kpi_heatmap(df), ["2024-01", "2024-02"]).collect()
    assert [tuple(r) for r in hm] == [("Dairy", 10.0, 25.0)]


def _activity_rows():
    """Three uneven months with a gap, a customer with a third of all lines, null customers and
    orders, orders over two days and two customers."""
    rows = []
    for i in range(900):
        cust = "HOT" if i % 3 == 0 else None if i % 50 == 1 else f"C{i * 7 % 61}"
        order = None if i % 97 == 5 else f"O{i // 2 if i % 5 else i // 6}"
        m = (1, 2, 4)[min(2, i * i % 11 // 4)]
        rows.append((f"L{i}", order, date(2024, m, 1 + (i * 13) % 28), cust, 1 + i % 9, (i % 9) / 4))
    return rows


def test_activity_series_against_sets(spark):
    """F1, F14, F16, F29 and F40 against sets of customers, nulls counted as each report states."""
    rows = _activity_rows()
    df = _orders(spark, rows).repartition(5)
    months, people, orders = {}, {}, {}
    for _, order, d, cust, rev, _ in rows:
        months.setdefault(d.strftime("%Y-%m"), []).append((cust, rev))
        people.setdefault(cust, set()).add(order)
    order_names = sorted(months)
    active = [{c for c, _ in months[m]} for m in order_names]
    want = {order_names[0]: 0.0} | {m: round(100 * len(a & b) / len(a), 1) for m, a, b in zip(order_names[1:], active, active[1:])}
    assert {r["period"]: r["retention"] for r in SC.retention_rate(df).collect()} == want and len(want) == 3
    k = SK.kpis(df).first()
    assert (k["transactions"], k["customers"]) == (len({r[1] for r in rows} - {None}), len(set(people) - {None}))
    cur, pre = len(active[-1] - {None}), len(active[-2] - {None})
    assert k["customer_growth"] == round(max(-200, min(200, (cur - pre) / pre * 100)), 1)
    assert k["revenue"] == sum(r[4] for r in rows)
    rate = round(100 * sum(len(o - {None}) > 1 for o in people.values()) / len(people), 1)
    assert SC.repeat_purchase_rate(df).first()[0] == SK.advanced_kpis(df).first()["repeat_rate"] == rate
    rev = [sum(v for _, v in months[m]) for m in order_names]
    growth = round(max(-200, min(200, (rev[-1] - rev[-2]) / rev[-2] * 100)), 1)
    score = (0.25 * min(k["gross_margin"] / 60, 1) + 0.2 * min(max(growth, 0) / 20, 1) + 0.2 * min(k["net_margin"] / 40, 1)
             + 0.2 * min(sum(want.values()) / 3 / 80, 1) + 0.15 * min(rate / 100, 1)) * 100
    assert SK.executive_score(df).first()[0] == round(score, 1)


def test_lines_without_a_date_or_any_lines(spark):
    df = _orders(spark, [("1", "o1", date(2024, 1, 1), "a", 10), ("2", "o2", None, "a", 5), ("3", None, None, None, 5), ("4", "o3", date(2024, 3, 1), "a", 1)])
    assert [(r["period"], r["retention"]) for r in SC.retention_rate(df).collect()] == [("2024-01", 0.0), ("2024-03", 100.0)]
    k = SK.kpis(df).first()
    assert (k["revenue"], k["transactions"], k["customers"], k["revenue_growth"]) == (21.0, 3, 1, -90.0)
    none = df.limit(0)
    assert SK.executive_score(none).first()[0] == 0.0 and SK.kpis(none).first()["transactions"] == 0 and SC.retention_rate(none).count() == 0


def test_executive_score_scans_the_lines_once(spark, tmp_path):
    _orders(spark, _activity_rows()).write.parquet(str(tmp_path / "lines"))
    df = spark.read.schema(FACT_ORDER).parquet(str(tmp_path / "lines"))
    for out in (SK.executive_score(df), SC.retention_rate(df), SC.repeat_purchase_rate(df)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan and "distinct" not in plan
