"""DuckDB SQL for the correctness oracle.

Written directly from the domain rules, independently of the Spark operators: the
fixture views are CTEs over the driver's pre-registered tables, and each query is
a plain SQL statement over them. Used by ``__spark_entry__.oracle_sql`` and the tests.
"""

from __future__ import annotations

# Fixed values, written out here so that the oracle shares no constant with the operators.
_WAREHOUSES = (
    "['North Hub', "
    "'Central Hub', "
    "'East Hub', "
    "'South Hub', "
    "'West Hub', "
    "'Airport Hub', "
    "'Port Hub', "
    "'Industrial Hub']")
_DESTINATIONS = (
    "['Retail District', "
    "'Restaurant District', "
    "'Airport', "
    "'Hospital Zone', "
    "'Market District', "
    "'Hotel District', "
    "'School Zone', "
    "'Office Park', "
    "'Residential Complex', "
    "'Sports Stadium']")
_FOOD_CATEGORIES = (
    "['Frozen Seafood', "
    "'Ice Cream', "
    "'Fresh Meat', "
    "'Dairy', "
    "'Fresh Produce', "
    "'Beverages', "
    "'Baked Goods', "
    "'Poultry', "
    "'Organic', "
    "'Ready-to-Eat', "
    "'Confectionery', "
    "'Snacks']")
_DELIVERY_STATUSES = (
    "['IN_TRANSIT', "
    "'LOADING', "
    "'DELIVERED', "
    "'DELAYED', "
    "'CUSTOMS_HOLD', "
    "'RETURNED']")
_RANGES = (
    "('Frozen Seafood', -25.0::DOUBLE, -12.0::DOUBLE), "
    "('Ice Cream', -30.0::DOUBLE, -15.0::DOUBLE), "
    "('Fresh Meat', -2.0::DOUBLE, 6.0::DOUBLE), "
    "('Dairy', 0.0::DOUBLE, 8.0::DOUBLE), "
    "('Fresh Produce', 2.0::DOUBLE, 12.0::DOUBLE), "
    "('Beverages', 2.0::DOUBLE, 10.0::DOUBLE), "
    "('Baked Goods', 15.0::DOUBLE, 25.0::DOUBLE), "
    "('Poultry', -2.0::DOUBLE, 4.0::DOUBLE), "
    "('Organic', 2.0::DOUBLE, 10.0::DOUBLE), "
    "('Ready-to-Eat', 2.0::DOUBLE, 8.0::DOUBLE), "
    "('Confectionery', 15.0::DOUBLE, 25.0::DOUBLE), "
    "('Snacks', 15.0::DOUBLE, 25.0::DOUBLE)"
)

SENSOR_CTES = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         0 AS arrival_seq FROM events
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         1 AS arrival_seq FROM events WHERE event_id % 500 = 0
),
arrivals AS (
  SELECT 'E' || event_id AS event_id,
         CASE WHEN event_id % 977 = 3 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS event_timestamp,
         CASE WHEN event_id % 991 = 1 THEN NULL WHEN event_id % 991 = 2 THEN ''
              ELSE 'SHIP-' || lpad(CAST(k % 60 + 1 AS VARCHAR), 4, '0') END AS shipment_id,
         CASE WHEN event_id % 983 = 5 THEN NULL
              ELSE 'V' || lpad(CAST(user_id % 30 + 1 AS VARCHAR), 3, '0') END AS vehicle_id,
         ({_WAREHOUSES})[user_id % 8 + 1] AS warehouse,
         ({_DESTINATIONS})[user_id % 10 + 1] AS destination,
         ({_FOOD_CATEGORIES})[user_id % 12 + 1] AS food_category,
         CAST(round(CAST(value AS DECIMAL(18,2)) % 52 - 11.5, 2) AS DOUBLE) AS temperature_c,
         CAST(round((CAST(value AS DECIMAL(18,2)) * 7) % 102, 1) AS DOUBLE) AS humidity_pct,
         18.9::DOUBLE + k / 300 AS latitude,
         CASE WHEN event_id % 971 = 7 THEN 200.0::DOUBLE ELSE 72.8::DOUBLE + k / 300 END AS longitude,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS door_open,
         CASE WHEN event_id % 967 = 8 THEN 101.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS battery_pct,
         CAST(round((CAST(value AS DECIMAL(18,2)) * 3) % 162, 1) AS DOUBLE) AS speed_kmh,
         ({_DELIVERY_STATUSES})[event_id % 6 + 1] AS delivery_status,
         event_id // 500 AS batch_id,
         TIMESTAMP '2024-02-01 00:00:00' + to_seconds(CAST((event_id // 500) * 20 AS BIGINT)) AS run_time,
         arrival_seq
  FROM ev
),
labelled AS (
  SELECT *, CASE
      WHEN row_number() OVER (PARTITION BY batch_id, event_id ORDER BY arrival_seq) > 1 THEN 'duplicate_event_id'
      WHEN shipment_id IS NULL OR shipment_id = '' THEN 'null_shipment_id'
      WHEN vehicle_id IS NULL OR vehicle_id = '' THEN 'null_vehicle_id'
      WHEN event_timestamp IS NULL THEN 'null_timestamp'
      WHEN temperature_c IS NULL OR isnan(temperature_c) OR temperature_c < -40 OR temperature_c > 40
           THEN 'invalid_temperature'
      WHEN humidity_pct IS NULL OR isnan(humidity_pct) OR humidity_pct < 0 OR humidity_pct > 100
           THEN 'invalid_humidity'
      WHEN battery_pct IS NULL OR isnan(battery_pct) OR battery_pct < 0 OR battery_pct > 100
           THEN 'invalid_battery_pct'
      WHEN speed_kmh IS NULL OR isnan(speed_kmh) OR speed_kmh < 0 OR speed_kmh > 160 THEN 'invalid_speed'
      WHEN latitude IS NULL OR longitude IS NULL OR NOT (latitude BETWEEN -90 AND 90)
           OR NOT (longitude BETWEEN -180 AND 180) THEN 'invalid_coordinates'
    END AS rejection_reason
  FROM arrivals
),
temp_ranges(cat, lo, hi) AS (VALUES {_RANGES}),
status_rows AS (
  SELECT l.*, CASE
      WHEN l.temperature_c >= coalesce(r.lo, -30.0) AND l.temperature_c <= coalesce(r.hi, 30.0) THEN 'SAFE'
      WHEN least(abs(l.temperature_c - coalesce(r.lo, -30.0)), abs(l.temperature_c - coalesce(r.hi, 30.0))) > 5
           THEN 'CRITICAL'
      ELSE 'WARNING' END AS temperature_status
  FROM labelled l LEFT JOIN temp_ranges r ON l.food_category = r.cat
  WHERE l.rejection_reason IS NULL
),
scored AS (
  SELECT *, CAST(least(100,
           CASE temperature_status WHEN 'CRITICAL' THEN 60 WHEN 'WARNING' THEN 30 ELSE 0 END
         + CASE WHEN door_open <> 0 THEN 15 ELSE 0 END
         + CASE WHEN humidity_pct > 80 THEN 10 ELSE 0 END
         + CASE WHEN battery_pct < 30 THEN 10 ELSE 0 END
         + CASE WHEN speed_kmh > 80 THEN 5 ELSE 0 END) AS DOUBLE) AS risk_score
  FROM status_rows
),
fact AS (
  SELECT event_id, event_timestamp, shipment_id, vehicle_id, temperature_c, humidity_pct, latitude, longitude,
         door_open, battery_pct, speed_kmh, temperature_status, risk_score,
         CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
              WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         CASE WHEN temperature_status <> 'SAFE' THEN 1 ELSE 0 END AS anomaly_flag,
         run_time AS processed_at, food_category, batch_id
  FROM scored
),
incidents AS (
  SELECT event_id, shipment_id, vehicle_id, 'TEMPERATURE_CRITICAL' AS incident_type, 'HIGH' AS severity,
         event_timestamp AS incident_timestamp,
         'Temperature ' || CAST(temperature_c AS VARCHAR) || 'C outside safe range for ' || food_category || '.'
           AS description
  FROM fact WHERE temperature_status = 'CRITICAL'
  UNION ALL
  SELECT event_id, shipment_id, vehicle_id, 'HIGH_RISK', CASE WHEN risk_level = 'CRITICAL' THEN 'HIGH' ELSE 'MEDIUM' END,
         event_timestamp, 'Shipment risk score reached ' || CAST(CAST(risk_score AS INTEGER) AS VARCHAR) || '.'
  FROM fact WHERE risk_score >= 60
  UNION ALL
  SELECT event_id, shipment_id, vehicle_id, 'DOOR_OPEN', 'MEDIUM', event_timestamp, 'Cargo door opened during transit.'
  FROM fact WHERE door_open <> 0
  UNION ALL
  SELECT event_id, shipment_id, vehicle_id, 'LOW_BATTERY', 'LOW', event_timestamp,
         'Sensor battery at ' || CAST(battery_pct AS VARCHAR) || '%.'
  FROM fact WHERE battery_pct < 15
),
rejects AS (
  SELECT event_id, rejection_reason, run_time AS rejected_at, batch_id FROM labelled WHERE rejection_reason IS NOT NULL
),
raw AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_id, event_id ORDER BY arrival_seq) AS rn
    FROM arrivals WHERE event_timestamp IS NOT NULL AND event_id IS NOT NULL) WHERE rn = 1
),
runs AS (
  SELECT sha256('run|' || CAST(l.batch_id AS VARCHAR)) AS run_id, min(l.run_time) AS started_at,
         min(l.run_time) AS finished_at, count(*) AS rows_generated,
         count(*) FILTER (WHERE l.rejection_reason IS NULL) AS rows_processed,
         count(*) FILTER (WHERE l.rejection_reason IS NOT NULL) AS rows_rejected,
         coalesce(max(i.n), 0) AS incidents_created, 'SUCCESS' AS status
  FROM labelled l LEFT JOIN (SELECT f.batch_id, count(*) AS n FROM incidents JOIN fact f USING (event_id)
                             GROUP BY f.batch_id) i ON i.batch_id = l.batch_id
  GROUP BY l.batch_id
),
checks(check_name) AS (VALUES ('null_shipment_id'), ('null_vehicle_id'), ('null_timestamp'), ('invalid_temperature'),
   ('invalid_humidity'), ('invalid_battery_pct'), ('invalid_speed'), ('invalid_coordinates'), ('duplicate_event_id')),
quality AS (
  SELECT r.run_id, c.check_name, greatest(r.rows_generated, 1) AS records_checked,
         coalesce(f.failures, 0) AS failures,
         CASE WHEN coalesce(f.failures, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, r.started_at AS created_at
  FROM runs r CROSS JOIN checks c
  LEFT JOIN (SELECT sha256('run|' || CAST(batch_id AS VARCHAR)) AS run_id, rejection_reason, count(*) AS failures
             FROM rejects GROUP BY ALL) f ON f.run_id = r.run_id AND f.rejection_reason = c.check_name
),
dim_shipment AS (
  SELECT shipment_id,
         ({_FOOD_CATEGORIES})[(n - 1) % 12 + 1] AS food_category,
         ({_WAREHOUSES})[(n - 1) % 8 + 1] AS warehouse,
         ({_DESTINATIONS})[(n - 1) % 10 + 1] AS destination
  FROM (SELECT DISTINCT shipment_id, CAST(substr(shipment_id, 6) AS INTEGER) AS n
        FROM arrivals WHERE shipment_id <> '')
)
"""

SALES_CTES = """
fo_base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_line_id,
         'O' || l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, 'C' || o_custkey AS customer_id,
         'P' || l_partkey AS product_id, r_name AS region, n_name AS state, n_name AS city, c_mktsegment AS channel,
         p_type AS category, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price,
         l_discount AS discount_pct,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(15,2))
           AS revenue,
         CAST(CAST(l_quantity AS DECIMAL(15,2)) * CAST(p_retailprice AS DECIMAL(15,2)) AS DECIMAL(15,2)) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       JOIN part ON l_partkey = p_partkey
),
fo AS (
  SELECT *, CAST(revenue - cost AS DECIMAL(15,2)) AS gross_profit,
         CAST(revenue - cost - revenue * 0.08 AS DECIMAL(15,2)) AS net_profit, 12 AS hour
  FROM fo_base
)
"""


def sensor(sql: str) -> str:
    return "WITH " + SENSOR_CTES.strip() + "\n" + sql


def sales(sql: str) -> str:
    return "WITH " + SALES_CTES.strip() + "\n" + sql


def sales_with(extra_ctes: str, sql: str) -> str:
    return "WITH " + SALES_CTES.strip() + ",\n" + extra_ctes.strip() + "\n" + sql
