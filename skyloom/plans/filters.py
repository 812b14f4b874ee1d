"""SQL of the altitude filter and its fault runs, over any table of readings."""


def kalman_steps(source: str) -> str:
    """The filter over a table of readings, as recursive common tables that end with k."""
    return f"""g AS (SELECT drone_id, reading_id, us, altitude AS value, (us - lag(us) OVER (PARTITION BY drone_id ORDER BY us, reading_id))
        / 3.6e9 AS dt FROM {source}),
    s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY drone_id ORDER BY us, reading_id ROWS
        UNBOUNDED PRECEDING) AS track FROM g WHERE dt IS NULL OR dt > 0),
    t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY drone_id, track ORDER BY us, reading_id) AS rn FROM s),
    k AS (SELECT drone_id, track, rn, reading_id, us, value AS x, CAST(0 AS DOUBLE) AS v, CAST(10 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b,
        CAST(10 AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS innovation, CAST(NULL AS DOUBLE) AS nis FROM t WHERE rn = 1
        UNION ALL
        SELECT drone_id, track, rn, reading_id, us, px + pa / (pa + 0.09) * (value - px), v + pb / (pa + 0.09) * (value - px), (1 - pa / (pa
            + 0.09)) * pa, (1 - pa / (pa + 0.09)) * pb, pc - pb / (pa + 0.09) * pb, value - px, pow(value - px, 2) / (pa + 0.09)
        FROM (SELECT t.drone_id, t.track, t.rn, t.reading_id, t.us, t.value, k.v, k.x + dt * k.v AS px, k.a + 2 * dt * k.b + dt * dt * k.c +
            0.25 * pow(dt, 4) / 4 AS pa, k.b + dt * k.c + 0.25 * pow(dt, 3) / 2 AS pb, k.c + 0.25 * dt * dt AS pc
            FROM k JOIN t ON t.drone_id = k.drone_id AND t.track = k.track AND t.rn = k.rn + 1))"""


FAULTS_SQL = """p AS (SELECT *, round(nis, 3) AS r, row_number() OVER (PARTITION BY drone_id ORDER BY us, reading_id) AS place FROM k),
    o AS (SELECT *, place - row_number() OVER (PARTITION BY drone_id ORDER BY us, reading_id) AS run FROM p WHERE r > 3.841),
    fr AS (SELECT drone_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(r) AS peak_nis, CASE WHEN max(r) > 6.635 THEN
        'CRITICAL' ELSE 'WARNING' END AS severity FROM o GROUP BY drone_id, run HAVING count(*) >= 3)"""
