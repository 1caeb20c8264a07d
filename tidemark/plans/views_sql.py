"""The domain views and marts in DuckDB SQL, as a WITH prefix for the queries' twins."""

from __future__ import annotations

from tidemark.functions.scalar import CITY_COUNTRY, holidays


def _holidays() -> str:
    city = {c: n for n, c in CITY_COUNTRY.items()}
    return ", ".join(f"('{city[c]}', DATE '{d}')" for c, d in holidays(2023, 2026))


VIEWS = f"""
WITH ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS int) AS k,
       (['london','new_york','tokyo','sydney','dubai'])[CAST(user_id % 5 AS int) + 1] AS city5 FROM events),
demand_events AS (
  SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN event_id::varchar END AS event_id,
    CASE WHEN event_id % 53 <> 0 THEN city5 END AS city,
    CASE event_type WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'booking' WHEN 'error' THEN 'cancellation' ELSE event_type END AS event_type,
    ts AS sim_ts, CASE WHEN event_id % 61 <> 0 THEN value END AS quantity, k * 0.5::double - 10 AS temperature_c,
    ts + (k - 5) * interval 1 minute AS ingested_at FROM ev),
weather_readings AS (
  SELECT event_id AS id, 'w' || event_id AS event_id, city5 AS city, ts AS polled_at, k * 0.5::double - 10 AS temperature_c,
    20 + k % 80 AS humidity_pct, CASE WHEN k < 30 THEN value / 100 ELSE 0.0::double END AS precip_mm,
    CASE WHEN k < 30 THEN 'RAIN' WHEN k < 60 THEN 'CLOUDY' ELSE 'CLEAR_DAY' END AS condition, ts + interval 1 minute AS ingested_at
  FROM ev WHERE event_type IN ('click', 'signup')),
demand_dup AS (SELECT * FROM demand_events UNION ALL
  SELECT id + 10000000, event_id, city, event_type, sim_ts, quantity, temperature_c, ingested_at + interval 1 minute FROM demand_events WHERE id % 10 = 0),
demand_once AS (SELECT * FROM demand_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, id) = 1),
weather_once AS (SELECT * FROM weather_readings QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, id) = 1),
demand_classified AS (SELECT *, nullif(concat_ws(',', CASE WHEN city IS NULL THEN 'null_city' END, CASE WHEN event_type IS NULL THEN 'null_event_type' END,
    CASE WHEN sim_ts IS NULL THEN 'null_sim_ts' END, CASE WHEN quantity IS NULL THEN 'null_quantity' END), '') AS reject_reason FROM demand_once),
demand_hourly AS (SELECT city, date_trunc('hour', sim_ts) AS hour_ts, sum(quantity) AS total_demand, count(*)::int AS event_count, avg(temperature_c) AS avg_temp_c
  FROM demand_classified WHERE reject_reason IS NULL GROUP BY 1, 2),
weather_hourly AS (SELECT city, date_trunc('hour', polled_at) AS hour_ts, avg(temperature_c) AS temperature_c, avg(humidity_pct) AS humidity_pct, sum(precip_mm) AS precip_mm
  FROM weather_once WHERE city IS NOT NULL AND polled_at IS NOT NULL GROUP BY 1, 2),
hol(city, holiday) AS (VALUES {_holidays()}),
lagged AS (SELECT city, hour_ts, total_demand, event_count,
    lag(total_demand, 1) OVER w AS demand_lag_1h, lag(total_demand, 24) OVER w AS demand_lag_24h, lag(total_demand, 168) OVER w AS demand_lag_168h,
    avg(total_demand) OVER (PARTITION BY city ORDER BY hour_ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS demand_roll_3h,
    avg(total_demand) OVER (PARTITION BY city ORDER BY hour_ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_roll_24h
  FROM demand_hourly WINDOW w AS (PARTITION BY city ORDER BY hour_ts)),
mart AS (SELECT l.*, sin(2 * pi() * hour(hour_ts) / 24) AS hour_sin, cos(2 * pi() * hour(hour_ts) / 24) AS hour_cos,
    sin(2 * pi() * (isodow(hour_ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(hour_ts) - 1) / 7) AS dow_cos,
    w.temperature_c, w.humidity_pct, w.precip_mm, h.holiday IS NOT NULL AS is_holiday
  FROM lagged l LEFT JOIN weather_hourly w USING (city, hour_ts) LEFT JOIN hol h ON h.city = l.city AND h.holiday = CAST(l.hour_ts AS date)),
prediction_features AS (SELECT city, CASE WHEN event_count % 7 = 0 THEN hour_ts + interval 365 day ELSE hour_ts + interval 20 minute END AS requested_at,
    CASE WHEN hour(hour_ts) % 11 = 0 THEN hour_ts - interval 1 hour ELSE hour_ts END AS mart_hour_ts, event_count::double AS event_count,
    demand_lag_1h + CASE WHEN event_count % 5 = 0 THEN 5.0::double ELSE 0.0::double END AS demand_lag_1h, demand_lag_24h, demand_lag_168h, demand_roll_3h, demand_roll_24h,
    humidity_pct, is_holiday::int::double AS is_holiday, temperature_c + CASE WHEN event_count % 3 = 0 THEN 3.0::double ELSE 0.0::double END AS temperature_c, precip_mm FROM mart),
joined AS (SELECT s.city, date_trunc('hour', s.requested_at) AS serving_hour, w.hour_ts AS wh_hour,
    s.mart_hour_ts IS NOT NULL AND s.mart_hour_ts <> date_trunc('hour', s.requested_at) AS is_stale,
    {", ".join(f"abs(coalesce(s.{c}, 0) - coalesce(w.{c}::double, 0)) AS d_{c}" for c in ("event_count", "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h", "humidity_pct", "temperature_c", "precip_mm"))},
    abs(coalesce(s.is_holiday, 0) - coalesce(w.is_holiday::int::double, 0)) AS d_is_holiday
  FROM prediction_features s LEFT JOIN mart w ON w.city = s.city AND w.hour_ts = date_trunc('hour', s.requested_at)),
daily AS (SELECT city, CAST(hour_ts AS date) AS day, sum(total_demand) AS daily_demand, sum(event_count) AS daily_bookings
  FROM mart WHERE total_demand IS NOT NULL AND CAST(hour_ts AS date) <= DATE '2024-01-20' GROUP BY 1, 2),
sliding AS (SELECT s.city AS route_id, s.id, s.sim_ts,
    count(DISTINCT CASE WHEN e.event_type = 'search' AND e.sim_ts >= s.sim_ts - interval 5 minute THEN e.event_id END) AS searches_5m,
    count(DISTINCT CASE WHEN e.event_type = 'booking' AND e.sim_ts >= s.sim_ts - interval 15 minute THEN e.event_id END) AS bookings_15m,
    count(DISTINCT CASE WHEN e.event_type = 'search' THEN e.event_id END) AS searches_1h, count(DISTINCT CASE WHEN e.event_type = 'booking' THEN e.event_id END) AS bookings_1h
  FROM demand_events s JOIN demand_events e ON e.city = s.city AND e.sim_ts BETWEEN s.sim_ts - interval 1 hour AND s.sim_ts GROUP BY s.city, s.id, s.sim_ts)
"""
