"""Registration of queries and the SQL they are checked against."""

from __future__ import annotations

from ..sources.fleet import Fleet

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Common table expressions over the driver's tables; each may use those before it.
CTES = {
    "ev": """SELECT user_id AS vehicle_id, event_id, event_type AS message, value, ts AS t_start, ts + to_microseconds(CAST(round(value*100) AS BIGINT)*600000) AS t_end,
      CAST(round(value*100) AS BIGINT) AS cents, CASE WHEN event_type='view' THEN 0 ELSE CAST(round(value*100) AS BIGINT) END AS km_c,
      CAST(json_extract_string(props,'$.k') AS DOUBLE) AS level_end FROM events""",
    "trips": """SELECT *, odo_c/100.0::DOUBLE AS odo_end, (odo_c-km_c)/100.0::DOUBLE AS odo_start FROM (
      SELECT vehicle_id, event_id, message, value, t_start, t_end, cents, km_c, km_c/100.0::DOUBLE AS trip_km, level_end,
      lag(level_end) OVER w AS level_start, CAST(sum(km_c) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS odo_c FROM ev WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_start, event_id))""",
    "vehicles": """SELECT c_custkey AS vehicle_id, c_nationkey%5 AS market, c_mktsegment AS engine, CAST(c_custkey%10 AS BIGINT) AS production_day, CAST(20+c_custkey%7 AS BIGINT) AS days_until_sale,
      CASE WHEN c_custkey%3=0 THEN CAST(40+(c_custkey*7)%12 AS BIGINT) END AS event_day, CASE WHEN c_custkey%3=0 THEN 'failed' ELSE 'healthy' END AS cohort, c_acctbal AS acctbal FROM customer""",
    "event_dates": "SELECT vehicle_id, TIMESTAMP '2023-12-01' + to_days(CAST(event_day AS INTEGER)) AS event_date FROM vehicles WHERE event_day IS NOT NULL",
    # backward and forward neighbours of the event date on the odometer
    "event_odo": """SELECT vehicle_id, event_date, odo_before, odo_after, CASE WHEN odo_before IS NULL THEN 'before_history' WHEN odo_after IS NULL THEN 'after_history' WHEN d1=d0 THEN 'exact' ELSE 'interpolated' END AS source,
      CASE WHEN odo_before IS NULL OR odo_after IS NULL THEN coalesce(odo_before, odo_after) WHEN d1=d0 THEN odo_before
        ELSE odo_before + (odo_after-odo_before)*(epoch_us(event_date)-d0)/CAST(d1-d0 AS DOUBLE) END AS event_odo
      FROM (SELECT e.vehicle_id, e.event_date, max(t.odo_end) FILTER (t.t_start<=e.event_date) AS odo_before, min(t.odo_end) FILTER (t.t_start>=e.event_date) AS odo_after,
        max(epoch_us(t.t_start)) FILTER (t.t_start<=e.event_date) AS d0, min(epoch_us(t.t_start)) FILTER (t.t_start>=e.event_date) AS d1
        FROM event_dates e JOIN trips t USING (vehicle_id) GROUP BY 1,2)""",
}
CTES |= {
    "cuts": """SELECT vehicle_id, c*100.0::DOUBLE AS cut_odo, event_odo, last_odo, CASE WHEN event_odo IS NULL THEN 0 ELSE 1 END AS event_observed,
      CASE WHEN event_odo-c*100.0::DOUBLE <= 900 THEN 1 ELSE 0 END AS label, event_odo-c*100.0::DOUBLE AS time_to_event_km, last_odo-c*100.0::DOUBLE AS km_after FROM (
      SELECT f.vehicle_id, e.event_odo, f.last_odo, unnest(generate_series(CAST(ceil((f.first_odo+400)/100) AS BIGINT), CAST(floor((coalesce(e.event_odo-100, f.last_odo-900)+1e-6)/100) AS BIGINT))) AS c
      FROM (SELECT vehicle_id, min(odo_end) AS first_odo, max(odo_end) AS last_odo FROM trips GROUP BY 1) f LEFT JOIN event_odo e USING (vehicle_id))""",
    "win": """SELECT c.vehicle_id, c.cut_odo, c.label, c.event_observed, c.time_to_event_km, c.km_after, t.event_id, t.t_start, t.t_end, t.odo_end, t.trip_km, t.level_end, t.level_start, t.message, t.value, t.km_c
      FROM cuts c JOIN trips t ON t.vehicle_id=c.vehicle_id AND t.odo_end > c.cut_odo-400 AND t.odo_end <= c.cut_odo""",
    "scores": """SELECT c.vehicle_id, c.cut_odo, c.label, c.event_observed, c.time_to_event_km, c.km_after, round(avg(w.level_end)/100, 6) AS score
      FROM cuts c JOIN win w USING (vehicle_id, cut_odo) GROUP BY ALL""",
}


def sql(body: str, *names: str) -> str:
    """body after the common table expressions up to the last of names (or those that body mentions)."""
    import re

    need, todo = set(), [body, *names]
    while todo:
        text = todo.pop()
        for n in CTES:
            if n not in need and re.search(rf"\b{n}\b", text):
                need.add(n)
                todo.append(CTES[n])
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register f(fleet) as a query; oracle is its SQL over CTES and the tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fleet(spark, sf_dir))
        if oracle:
            SQL[name] = sql(oracle)
        return f

    return add
