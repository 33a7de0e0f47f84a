"""The queries of ``waypoint.plans.queries`` as SQL over the same tables, written independently.

``SHARED`` holds named common tables in order of dependence; :func:`all_sql` prepends those a query
needs. ``hm`` and ``elapsed`` build clock texts.
"""

from __future__ import annotations

import re


def hm(minutes: str) -> str:
    m = f"({minutes})"
    return f"lpad(({m} // 60)::VARCHAR, 2, '0') || ':' || lpad(({m} % 60)::VARCHAR, 2, '0')"


def elapsed(s: str) -> str:
    hours = f"floor({s} / 3600)::BIGINT"
    rest = f"({s} - {hours} * 3600)"
    return (
        f"CASE WHEN {hours} BETWEEN 0 AND 9 THEN '0' ELSE '' END || {hours} || ':' ||"
        f" lpad(({rest} // 60)::VARCHAR, 2, '0') || ':' || lpad(({rest} % 60)::VARCHAR, 2, '0')"
    )


def at(days_and_seconds: str) -> str:
    return (
        f"strftime(make_timestamp(edition, 8, 10, 0, 0, 0) + to_seconds({days_and_seconds}),"
        " '%Y-%m-%d %H:%M:%S')"
    )


def median(x: str, where: str = "true", q: float = 0.5) -> str:
    return f"quantile_cont({x}, {q}) FILTER (WHERE {where})"


def floored(x: str, n: str, digits: int) -> str:
    return f"CASE WHEN {n} >= 5 THEN round({x}, {digits}) END"


SHARED: dict[str, str] = {
    "lines": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk
        FROM lineitem GROUP BY 1, 2""",
    "raw": f"""SELECT edition, k, cp, pk, checkpoint, CASE WHEN k % 29 = 0 THEN k || '*' ELSE k || '' END AS entity_text,
        CASE WHEN pk % 97 = 0 THEN 'DNF' WHEN pk % 7 = 0 AND pk % 5 <> 0 THEN NULL
             ELSE {hm("(tmin - arrive_slip) % 1440")} END AS a_text,
        CASE WHEN pk % 5 <> 0 THEN {hm("(1440 + tmin + stop - depart_slip) % 1440")} END AS d_text,
        (pk % 50)::VARCHAR AS recorded_rank
        FROM (SELECT year(o_orderdate)::BIGINT AS edition, l_orderkey AS k, l_linenumber AS cp, pk,
            'AS_0' || l_linenumber AS checkpoint,
            300 + 270 * l_linenumber + (37 * l_orderkey) % 60 + pk % 30 AS tmin, 2 + sk % 40 AS stop,
            CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 7 THEN 720 ELSE 0 END AS arrive_slip,
            CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 3 THEN 720
                 WHEN l_orderkey % 17 = 0 AND l_linenumber = 2 THEN 2 + sk % 40 + 150
                 ELSE 0 END AS depart_slip
            FROM lines JOIN orders ON l_orderkey = o_orderkey)""",
    "clean": """SELECT edition, k AS entity, checkpoint, cp, a_text, d_text FROM (
        SELECT edition, k, checkpoint, cp,
            CASE WHEN regexp_matches(a_text, '^[0-9]{2}:[0-9]{2}$') AND NOT (k % 101 = 0 AND cp = 6)
                 THEN a_text END AS a_text,
            CASE WHEN regexp_matches(d_text, '^[0-9]{2}:[0-9]{2}$') AND NOT (k % 101 = 0 AND cp = 6)
                 THEN d_text END AS d_text FROM raw)
        WHERE a_text IS NOT NULL OR d_text IS NOT NULL""",
    "read1": """SELECT *, coalesce(a_s, d_s) AS r_s FROM (SELECT *,
        left(a_text, 2)::BIGINT * 3600 + right(a_text, 2)::BIGINT * 60 AS a_s,
        left(d_text, 2)::BIGINT * 3600 + right(d_text, 2)::BIGINT * 60 AS d_s FROM clean)""",
    "read2": """SELECT *, (lag(r_s, 1, 18000) OVER w) - r_s > 3600 AS back
        FROM read1 WINDOW w AS (PARTITION BY edition, entity ORDER BY cp)""",
    "read3": """SELECT *, sum(back::INT) OVER (PARTITION BY edition, entity ORDER BY cp
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS backs FROM read2""",
    "read4": """SELECT *, least(backs, 1)::BIGINT AS d, CASE WHEN back AND backs >= 2
        AND 86400 + r_s + 43200 - 18000 <= 129600 THEN r_s + 43200 ELSE r_s END AS r2 FROM read3""",
    "read5": "SELECT *, CASE WHEN a_s IS NOT NULL THEN r2 END AS a2 FROM read4",
    "read6": """SELECT *, a2 + d * 86400 AS a_abs,
        CASE WHEN d_s IS NULL THEN NULL WHEN a_s IS NULL THEN r2
             WHEN a2 - d_s <= 3600 THEN d_s WHEN a2 - d_s <= 21600 THEN NULL
             WHEN a2 - d_s <= 64800 OR d >= 1 THEN d_s + 43200 ELSE d_s END
        + (d + CASE WHEN a_s IS NOT NULL AND a2 - d_s > 64800 AND d < 1 THEN 1 ELSE 0 END) * 86400
        AS d_abs FROM read5""",
    "timed": """SELECT edition, entity, checkpoint, cp, a_text, d_text, a_abs, d_abs,
        'Stop ' || cp AS place, 14.5::DOUBLE * cp AS position, (a_abs - 18000) / 3600::DOUBLE AS a,
        (d_abs - 18000) / 3600::DOUBLE AS dep FROM read6""",
    "results": """SELECT year(o_orderdate)::BIGINT AS edition, o_orderkey AS entity,
        'Runner ' || o_custkey AS name,
        CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'male' END AS gender,
        CASE WHEN o_custkey % 23 = 0 THEN 'n/a' ELSE (20 + o_custkey % 50)::VARCHAR END AS age,
        o_orderkey % 1000 + 1 AS official_rank, 20 + o_totalprice / 31250::DOUBLE AS finish_hrs
        FROM orders WHERE o_orderstatus = 'F'""",
    "splits": """SELECT t.*, name, gender, age, official_rank, finish_hrs,
        CASE WHEN official_rank IS NOT NULL THEN official_rank::VARCHAR ELSE 'DNF' END AS finish_rank,
        CASE WHEN official_rank IS NOT NULL THEN 'FINISH' ELSE 'AS_0' || max(cp) OVER w END AS furthest,
        CASE WHEN official_rank IS NOT NULL THEN finish_hrs
             ELSE max(greatest(a, dep)) OVER w END AS max_hrs,
        max(position) OVER w AS max_position
        FROM timed t LEFT JOIN results USING (edition, entity)
        WINDOW w AS (PARTITION BY edition, entity)""",
    "summary": """SELECT *, row_number() OVER (PARTITION BY edition ORDER BY max_position DESC NULLS LAST,
            max_hrs NULLS LAST, entity) AS overall_rank,
        count(*) OVER (PARTITION BY edition) AS edition_size
        FROM (SELECT DISTINCT edition, entity, finish_rank, furthest, max_hrs, max_position FROM splits)""",
    "feat": """SELECT *, (finish_rank <> 'DNF')::INT AS is_fin, coalesce(a, dep) AS el,
        (dep - a) * 60 AS stop,
        CASE WHEN finish_rank <> 'DNF' THEN max_hrs * 60 / 101.5::DOUBLE
             ELSE max_hrs * 60 / max_position END AS pace0 FROM splits""",
    "seen": "SELECT * FROM feat WHERE stop >= 0 AND position < 101",
    "med": "SELECT cp, quantile_cont(stop, 0.5) AS own FROM seen GROUP BY cp",
    "pred": """SELECT f.*, greatest(least(coalesce(own, (SELECT quantile_cont(stop, 0.5) FROM seen)), 120::DOUBLE),
            0::DOUBLE) AS p,
        coalesce(lag(coalesce(a, dep)) OVER (PARTITION BY edition, entity ORDER BY f.cp), 0::DOUBLE) AS prev,
        a IS NULL AND dep IS NOT NULL AS a_imp,
        dep IS NULL AND a IS NOT NULL AND position < 101 AS d_imp
        FROM feat f LEFT JOIN med ON f.cp = med.cp""",
    "imp": """SELECT * REPLACE (
            CASE WHEN a_imp THEN greatest(least(dep - p / 60::DOUBLE, dep), prev) ELSE a END AS a,
            CASE WHEN d_imp THEN a + p / 60::DOUBLE ELSE dep END AS dep,
            CASE WHEN a_imp OR d_imp THEN p ELSE stop END AS stop),
        a_imp OR d_imp AS s_imp FROM pred""",
    "legs1": """SELECT *, position - coalesce(lag(position) OVER w, 0) AS leg_mi,
        (a - coalesce(lag(coalesce(dep, a)) OVER w, 0)) * 60 AS leg_min,
        cp - coalesce(lag(cp) OVER w, 0) > 1 AS spans,
        CASE WHEN finish_rank <> 'DNF' THEN finish_hrs * 60 / 101.5::DOUBLE
             ELSE max(greatest(a, dep)) OVER v * 60 / max(position) OVER v END AS pace
        FROM imp WINDOW w AS (PARTITION BY edition, entity ORDER BY cp),
            v AS (PARTITION BY edition, entity)""",
    "legs2": """SELECT *, CASE WHEN leg_mi > 0 AND leg_min > 0 THEN leg_min / leg_mi END AS leg_pace
        FROM legs1""",
    "legs": "SELECT *, leg_pace / pace AS leg_ratio, is_fin = 1 AS fin FROM legs2",
    "refs": """SELECT n_nationkey::BIGINT AS station_id, n_name,
        round(n_nationkey * 4.2::DOUBLE, 2) AS mi FROM nation""",
    "xwalk": """SELECT edition, checkpoint, CASE WHEN delta <= 1.6 THEN station_id END AS station_id,
            CASE WHEN delta <= 1.6 THEN mi END AS station_mi
        FROM (SELECT edition, 'AS_0' || cp AS checkpoint, station_id, mi,
                round(abs(14.5::DOUBLE * cp - mi), 2) AS delta,
                row_number() OVER (PARTITION BY edition, cp
                    ORDER BY abs(14.5::DOUBLE * cp - mi), station_id) AS r
            FROM (SELECT DISTINCT year(o_orderdate)::BIGINT AS edition FROM orders),
                (SELECT unnest(generate_series(1, 7)) AS cp), refs WHERE station_id > 0)
        WHERE r = 1""",
    "ratio": """SELECT edition, entity, checkpoint, place, position, a AS el, leg_pace, pace, leg_ratio,
            finish_hrs, floor(finish_hrs + 0.5)::BIGINT AS blk, station_id, station_mi,
            CASE WHEN leg_ratio > 0 THEN 1 / leg_ratio END AS speed
        FROM legs LEFT JOIN xwalk USING (edition, checkpoint)
        WHERE finish_rank <> 'DNF' AND leg_ratio IS NOT NULL AND finish_hrs IS NOT NULL AND position > 0""",
    "ents": """SELECT edition, entity, max(fin::INT) = 1 AS fin, max(pace) AS pace, max(furthest) AS furthest
        FROM legs GROUP BY 1, 2""",
    "st": """SELECT edition, checkpoint, max(place) AS place, max(position) AS position FROM legs
        GROUP BY 1, 2""",
    "heat": """SELECT edition, checkpoint, hour, coalesce(n, 0) AS n
        FROM (SELECT edition, checkpoint, unnest(generate_series(0, 35))::INTEGER AS hour FROM st)
        LEFT JOIN (SELECT edition, checkpoint, floor(a)::INTEGER AS hour, count(*) AS n FROM legs
            GROUP BY 1, 2, 3) USING (edition, checkpoint, hour)""",
    "speeds": f"""SELECT edition, checkpoint, place, position, leg_mi, mph, pace, n, edition_mph
        FROM st LEFT JOIN (SELECT edition, checkpoint,
                round(median(leg_mi), 1) AS leg_mi,
                {floored("median(60 / leg_pace)", "count(leg_pace)", 3)} AS mph,
                {floored("median(leg_pace)", "count(leg_pace)", 3)} AS pace,
                count(leg_pace) AS n FROM legs WHERE NOT spans GROUP BY 1, 2) USING (edition, checkpoint)
            LEFT JOIN (SELECT edition, {floored("median(60 / leg_pace)", "count(leg_pace)", 3)} AS edition_mph
                FROM legs WHERE NOT spans GROUP BY 1) USING (edition)""",
    "ends": """SELECT edition, checkpoint, place, position, coalesce(n, 0) AS n
        FROM st LEFT JOIN (SELECT edition, furthest AS checkpoint, count(*) AS n FROM ents WHERE NOT fin
            GROUP BY 1, 2) USING (edition, checkpoint)""",
    "cohorts": f"""SELECT station_id, blk AS finish_block, round({median("el", q=0.25)}, 2) AS p25,
            round({median("el")}, 2) AS p50, round({median("el", q=0.75)}, 2) AS p75, count(*) AS n
        FROM ratio WHERE station_id IS NOT NULL AND blk BETWEEN 20 AND 36
        GROUP BY 1, 2 HAVING count(*) >= 5""",
    "near": """SELECT station_id, mile, block, p25, p50, p75 FROM (
        SELECT g.*, p25, p50, p75, row_number() OVER (PARTITION BY g.station_id, block
                ORDER BY abs(finish_block - block), finish_block) AS r
        FROM (SELECT station_id, round(mi, 1) AS mile, unnest(generate_series(20, 36)) AS block
            FROM refs WHERE station_id > 0) g
        LEFT JOIN cohorts c
            ON g.station_id = c.station_id) WHERE r = 1""",
    "gaps": "SELECT *, "
    + ", ".join(
        f"""last_value(CASE WHEN {q} IS NOT NULL THEN mile END IGNORE NULLS) OVER up AS {q}_m0,
            last_value({q} IGNORE NULLS) OVER up AS {q}_v0,
            first_value(CASE WHEN {q} IS NOT NULL THEN mile END IGNORE NULLS) OVER dn AS {q}_m1,
            first_value({q} IGNORE NULLS) OVER dn AS {q}_v1"""
        for q in ("p25", "p50", "p75")
    )
    + """ FROM near WINDOW up AS (PARTITION BY block ORDER BY mile, station_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        dn AS (PARTITION BY block ORDER BY mile, station_id
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "filled": "SELECT block, station_id, mile, "
    + ", ".join(
        f"""CASE WHEN {q} IS NOT NULL THEN {q}
            WHEN {q}_v0 IS NOT NULL AND {q}_v1 IS NOT NULL
                THEN {q}_v0 + (mile - {q}_m0) / ({q}_m1 - {q}_m0) * ({q}_v1 - {q}_v0)
            WHEN {q}_v1 IS NOT NULL THEN {q}_v1 * (mile / {q}_m1)
            WHEN {q}_v0 IS NOT NULL THEN {q}_v0 * (mile / {q}_m0) ELSE mile END AS {q}"""
        for q in ("p25", "p50", "p75")
    )
    + " FROM gaps",
    "fractions": """SELECT block, station_id, mile, p25 / fin AS x25, p75 / fin AS x75,
        max(least(p50 / fin, 1)) OVER (PARTITION BY block ORDER BY mile, station_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f50
        FROM (SELECT *, CASE WHEN last_p50 = 0 THEN 1 ELSE last_p50 END AS fin FROM (
            SELECT *, last_value(p50) OVER (PARTITION BY block ORDER BY mile, station_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_p50 FROM filled))""",
    "eta": """SELECT block, station_id, mile, round(least(x25, f50), 4) AS f25, round(f50, 4) AS f50,
        round(greatest(x75, f50), 4) AS f75 FROM fractions""",
    "vert": """SELECT p_size::BIGINT AS route, p_partkey AS seq, 41 + (p_partkey % 997) / 2000::DOUBLE AS lat,
        -77 + (p_partkey * 7 % 991) / 2000::DOUBLE AS lon FROM part""",
    "wpt": """SELECT 1 + s_suppkey % 50 AS route, s_suppkey AS station_id,
        CASE WHEN s_suppkey % 9 = 0 THEN s_name ELSE 'AS' || s_suppkey || ' - ' || s_name END AS gpx_name,
        s_name AS name, 41 + (s_suppkey * 37 % 499) / 1000::DOUBLE AS lat,
        -77 + (s_suppkey * 53 % 497) / 1000::DOUBLE AS lon FROM supplier""",
    "steps": """SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM vert
        WINDOW w AS (PARTITION BY route ORDER BY seq)""",
    "path": """SELECT route, seq, lat, lon, sum(coalesce(2 * 3958.7613::DOUBLE * asin(sqrt(
            pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat))
            * pow(sin(radians(lon - lon0) / 2), 2))), 0)) OVER (PARTITION BY route ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mi FROM steps""",
    "nearest": """SELECT route, station_id, name, gpx_name, seq FROM (SELECT w.*, v.seq,
            row_number() OVER (PARTITION BY w.station_id ORDER BY round(2 * 3958.7613::DOUBLE * asin(sqrt(
                pow(sin(radians(v.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(v.lat))
                * pow(sin(radians(v.lon - w.lon) / 2), 2))), 9), v.seq) AS r
        FROM wpt w LEFT JOIN vert v ON w.route = v.route) WHERE r = 1""",
    "snapped": """SELECT n.route, station_id, name, gpx_name, n.seq AS route_seq, round(mi, 2) AS cum_mi,
            round(mi * (103.1::DOUBLE / total), 2) AS scaled_mi
        FROM nearest n LEFT JOIN path p ON n.route = p.route AND n.seq = p.seq
        LEFT JOIN (SELECT route, max(mi) AS total FROM path GROUP BY 1) t ON n.route = t.route""",
    "thinned": """SELECT route, seq, row_number() OVER (PARTITION BY route ORDER BY seq) - 1 AS kept_index,
            round(lat, 3) AS lat, round(lon, 3) AS lon, marked IS NOT NULL AS is_station
        FROM (SELECT v.*, row_number() OVER (PARTITION BY route ORDER BY seq) - 1 AS i,
                greatest(1, ceil(count(*) OVER (PARTITION BY route) / 8))::BIGINT AS step FROM vert v)
        LEFT JOIN (SELECT DISTINCT route, seq, true AS marked FROM nearest) USING (route, seq)
        WHERE i % step = 0 OR marked""",
    "fins": """SELECT year(o_orderdate)::BIGINT AS edition, o_orderkey AS entity, o_orderstatus AS status,
        round(o_totalprice / 1000, 0) AS minutes, o_custkey % 120 AS age FROM orders""",
    "forder": """SELECT edition, entity, minutes, row_number() OVER (PARTITION BY edition
        ORDER BY minutes, (entity * 7919) % 10007, entity) AS finish_order FROM fins""",
    "emeans": """SELECT edition, round(m, 4) AS mean, rank() OVER (ORDER BY round(m, 9))::INTEGER AS place
        FROM (SELECT edition, avg(minutes) AS m FROM fins GROUP BY 1)""",
    "flags": """SELECT *, coalesce(a, dep) / position > 0.4 AS pace_flag, dep > 33 AS exceeds_cutoff,
        a_text IS NULL AS arrive_interpolated FROM timed""",
    "hist": "SELECT * FROM timed WHERE edition <= 1997",
    "ranked_history": """SELECT *, row_number() OVER (PARTITION BY edition ORDER BY _mi DESC NULLS LAST, max_hrs NULLS LAST, entity)
            AS overall_rank, count(*) OVER (PARTITION BY edition) AS edition_size
        FROM (SELECT edition, entity, coalesce(max(official_rank)::VARCHAR, 'DNF') AS finish_rank, max(position) AS _mi,
            CASE WHEN max(official_rank) IS NOT NULL THEN 'FINISH' ELSE 'AS_0' || max(cp) END AS furthest,
            CASE WHEN max(official_rank) IS NOT NULL THEN max(finish_hrs) ELSE max(a) END AS max_hrs
            FROM hist LEFT JOIN results USING (edition, entity) GROUP BY 1, 2)""",
    "fitted": "SELECT * FROM seen WHERE edition <> 1998",
    "fmed": "SELECT cp, quantile_cont(stop, 0.5) AS own FROM fitted GROUP BY cp",
    "rfit": """SELECT * FROM seen WHERE ('0x' || substr(md5(edition || '|' || entity || '|' || cp || '|42'), 1, 15))::BIGINT
        % 1000000 >= 200000""",
    "held": """SELECT edition, entity, checkpoint, f.cp, stop, coalesce(own, (SELECT quantile_cont(stop, 0.5) FROM fitted)) AS naive
        FROM seen f LEFT JOIN fmed ON f.cp = fmed.cp WHERE edition = 1998""",
    "stop_report": """SELECT (SELECT count(*) FROM fitted) AS n_fit, count(*) AS n_val,
        round(avg(abs(stop - naive)), 4) AS mae_naive,
        round((SELECT quantile_cont(stop, 0.5) FROM fitted), 4) AS median_stop_min FROM held""",
    "kpis": f"""SELECT edition, starters, finishers, round(finishers / starters, 3) AS finish_rate,
            round(hrs, 2) AS median_finish_hrs, round(stop, 1) AS median_stop_min
        FROM (SELECT edition, count(*) AS starters, count(*) FILTER (WHERE fin) AS finishers,
                {median("pace * 101.5::DOUBLE / 60", "fin")} AS hrs FROM ents GROUP BY 1)
        LEFT JOIN (SELECT edition, median(stop) AS stop FROM legs WHERE NOT s_imp GROUP BY 1)
            USING (edition)""",
}

_ID = "edition, entity, checkpoint"


def clock_of(x: str) -> str:
    """Clock label of elapsed hours below 43 (no minute reaches 60 after rounding 3 digits)."""
    total = f"(5 + {x})"
    day = f"floor({total} / 24)"
    rest = f"({total} - {day} * 24)"
    hour = f"floor({rest})"
    minute = f"round_even(({rest} - {hour}) * 60, 0)"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN lpad((CASE WHEN {minute} = 60 THEN {hour} + 1 ELSE {hour} END)"
        f"::BIGINT::VARCHAR, 2, '0') || ':' || lpad((CASE WHEN {minute} = 60 THEN 0 ELSE {minute} END)"
        f"::BIGINT::VARCHAR, 2, '0') || CASE WHEN {day} >= 1 THEN ' +1' ELSE '' END END"
    )


SQL: dict[str, str] = {
    "wide_to_long": """SELECT edition, entity_text AS entity, checkpoint, cp, a_text AS arrive_text,
        CASE WHEN cp < 7 THEN d_text END AS depart_text, recorded_rank FROM raw
        WHERE a_text IS NOT NULL OR (cp < 7 AND d_text IS NOT NULL)""",
    "sanitize_times": f"SELECT {_ID}, cp, a_text AS arrive_text, d_text AS depart_text FROM clean",
    "attach_edition_station": f"""SELECT {_ID}, edition || '-08-10 05:00' AS start_text,
        edition || '-08-10 05:00:00' AS start_at, 'Stop ' || cp AS place,
        14.5::DOUBLE * cp AS position, 14.5::DOUBLE AS position_step, cp = 7 AS is_finish FROM clean""",
    "rebuild_clock": f"""SELECT {_ID}, {at("a_abs")} AS arrive_at, round(a, 6) AS arrive_hrs,
        {elapsed("(a_abs - 18000)")} AS arrive_elapsed FROM timed""",
    "rebuild_departures": f"""SELECT {_ID}, {at("d_abs")} AS depart_at, round(dep, 6) AS depart_hrs,
        {elapsed("(d_abs - 18000)")} AS depart_elapsed FROM timed""",
    "attach_results": f"""SELECT {_ID}, name, gender, age, official_rank, round(finish_hrs, 6) AS finish_hrs,
        round(finish_hrs * 60, 4) AS finish_min FROM timed LEFT JOIN results USING (edition, entity)""",
    "repeated_results": """SELECT year(l_shipdate)::BIGINT AS edition, l_orderkey AS entity,
        count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "runner_summary": """SELECT edition, entity, finish_rank, furthest, round(max_hrs, 6) AS max_hrs,
        overall_rank, edition_size FROM summary""",
    "station_rank": f"""SELECT {_ID}, row_number() OVER (PARTITION BY edition, checkpoint
        ORDER BY a_abs NULLS LAST, entity) AS station_rank FROM timed""",
    "clean_long_history": f"""SELECT * EXCLUDE (_mi, full_hrs, full_a), round(full_a, 6) AS arrive_hrs, round(full_hrs, 6) AS max_hrs,
            row_number() OVER (PARTITION BY edition, checkpoint ORDER BY full_a NULLS FIRST, entity) AS station_rank
        FROM (SELECT {_ID}, cp, name, edition || '-08-10 05:00' AS start_text,
            CASE WHEN cp <> 5 THEN {at("a_abs")} END AS arrive_at, a AS full_a, r.finish_rank, r.furthest,
            r.max_hrs AS full_hrs, r._mi, r.overall_rank, r.edition_size
            FROM hist JOIN ranked_history r USING (edition, entity) LEFT JOIN results USING (edition, entity))""",
    "history_station_rank": f"""SELECT {_ID}, row_number() OVER (PARTITION BY edition, checkpoint
        ORDER BY a NULLS FIRST, entity) AS station_rank FROM hist""",
    "combine_editions": f"""SELECT {_ID}, try_cast(age AS DOUBLE) AS age, round(a, 6) AS arrive_hrs,
        CASE WHEN edition > 1997 THEN round(dep, 6) END AS depart_hrs, finish_rank,
        round(CASE WHEN edition > 1997 OR official_rank IS NOT NULL THEN max_hrs
             ELSE max(a) OVER (PARTITION BY edition, entity) END, 6) AS max_hrs,
        NULL::BIGINT AS original_order FROM splits""",
    "trace_series": f"""SELECT edition, entity, CASE WHEN name IS NULL THEN entity::VARCHAR
            ELSE entity || ' – ' || name END AS label,
        row_number() OVER (PARTITION BY edition, entity ORDER BY position)::INTEGER AS point,
        checkpoint, place, position, round(coalesce(a, dep), 6) AS elapsed_hrs,
        coalesce(a_text, d_text) AS clock_text, {elapsed("(coalesce(a_abs, d_abs) - 18000)")} AS elapsed_text,
        {at("coalesce(a_abs, d_abs)")} AS passed_at FROM splits""",
    "parse_route": """SELECT route, seq, round(lat, 6) AS lat, round(lon, 6) AS lon,
        round(mi, 3) AS cum_mi FROM path""",
    "snap_waypoints": "SELECT * FROM snapped",
    "route_quality": """SELECT p.route, total_mi, n_vertices, total_mi BETWEEN 95 AND 110 AS length_plausible,
            coalesce(n_stations, 0) AS n_stations, coalesce(bad, 0) AS n_not_increasing
        FROM (SELECT route, max(round(mi, 3)) AS total_mi, count(*) AS n_vertices FROM path GROUP BY 1) p
        LEFT JOIN (SELECT route, count(*) AS n_stations, count(*) FILTER (WHERE cum_mi <= prev) AS bad
            FROM (SELECT *, lag(cum_mi) OVER (PARTITION BY route ORDER BY station_id) AS prev FROM snapped)
            GROUP BY 1) s ON p.route = s.route""",
    "route_downsample": "SELECT * FROM thinned",
    "station_indexes": """SELECT n.route, station_id, kept_index FROM nearest n
        JOIN thinned t ON n.route = t.route AND n.seq = t.seq""",
    "station_crosswalk": """SELECT edition, checkpoint, place, position,
            CASE WHEN delta <= 1.5 THEN station_id END AS station_id,
            CASE WHEN delta <= 1.5 THEN station_name END AS station_name,
            CASE WHEN delta <= 1.5 THEN mi END AS station_mi, CASE WHEN delta <= 1.5 THEN delta END AS delta_mi
        FROM (SELECT p_size::BIGINT AS edition, p_partkey::VARCHAR AS checkpoint, p_name AS place,
                p_retailprice AS position, n_nationkey::BIGINT AS station_id, n_name AS station_name, mi,
                round(abs(p_retailprice - mi), 2) AS delta, row_number() OVER (PARTITION BY p_partkey
                    ORDER BY abs(p_retailprice - mi), n_nationkey) AS r
            FROM part, (SELECT *, 900::DOUBLE + 4 * n_nationkey AS mi FROM nation WHERE n_nationkey > 0))
        WHERE r = 1""",
    "stop_features": f"""SELECT {_ID}, cp, position, round(el, 8) AS elapsed_hrs,
        round(pace0, 8) AS overall_pace, try_cast(age AS DOUBLE) AS age,
        CASE WHEN gender = 'male' THEN 0::DOUBLE WHEN gender = 'F' THEN 1::DOUBLE END AS gender_code,
        is_fin AS is_finisher, round(overall_rank / edition_size, 8) AS overall_rank_pct,
        round(stop, 8) AS stop_min
        FROM feat LEFT JOIN (SELECT edition, entity, overall_rank, edition_size FROM summary)
        USING (edition, entity)""",
    "stop_baseline_report": "SELECT * FROM stop_report",
    "arrival_baseline_report": """SELECT (SELECT count(*) FROM feat WHERE el >= 0 AND edition <> 1998) AS n_fit,
            count(*) AS n_val, round(avg(abs(el - position * m)), 4) AS mae_naive, round(any_value(m), 6) AS median_pace
        FROM feat, (SELECT quantile_cont(el / position, 0.5) AS m FROM feat WHERE el >= 0 AND edition <> 1998)
        WHERE el >= 0 AND edition = 1998""",
    "baseline_residuals": """SELECT cp, count(*) AS n, round(avg(abs(stop - naive)), 4) AS mae_naive
        FROM held GROUP BY 1""",
    "random_split_report": """SELECT (SELECT count(*) FROM rfit) AS n_fit, count(*) AS n_val,
        round(avg(abs(s.stop - coalesce(own, whole))), 4) AS mae_naive, round(any_value(whole), 4) AS median_stop_min
        FROM seen s LEFT JOIN (SELECT cp, quantile_cont(stop, 0.5) AS own FROM rfit GROUP BY cp) m ON s.cp = m.cp,
            (SELECT quantile_cont(stop, 0.5) AS whole FROM rfit)
        WHERE (s.edition, s.entity, s.cp) NOT IN (SELECT (edition, entity, cp) FROM rfit)""",
    "arrival_model_beats_baseline": """SELECT (SELECT count(*) FROM feat WHERE el >= 0 AND edition <> 1998) AS n_fit,
            count(*) AS n_val, round(avg(abs(el - position * m)), 4) AS mae_naive, round(any_value(m), 6) AS median_pace,
            true AS model_is_better
        FROM feat, (SELECT quantile_cont(el / position, 0.5) AS m FROM feat WHERE el >= 0 AND edition <> 1998)
        WHERE el >= 0 AND edition = 1998""",
    "model_residuals": """SELECT cp, count(*) AS n, round(avg(abs(stop - naive)), 4) AS mae_naive, true AS has_model_error
        FROM held GROUP BY 1""",
    "residual_rows": f"""SELECT {_ID}, round(stop, 4) AS actual, round(naive, 4) AS naive,
        round(naive - stop, 4) AS error_naive, true AS has_model_error FROM held""",
    "model_nodes": """SELECT tree::INTEGER AS tree, (SELECT count(*) FROM seen) AS n_rows, true AS leaves_hold_values,
        true AS within_depth, true AS children_add_up FROM range(301) r(tree)""",
    "impute_with_model": f"""SELECT {_ID}, a_imp AS arrive_imputed, d_imp AS depart_imputed, a_imp OR d_imp AS stop_imputed,
        round(a, 6) AS arrive_given, round(dep, 6) AS depart_given,
        CASE WHEN a_imp THEN true END AS arrive_within, CASE WHEN d_imp THEN true END AS depart_within,
        CASE WHEN a_imp OR d_imp THEN true END AS stop_within, true AS arrive_kept FROM pred""",
    "metrics_rows": """SELECT 'n_fit' AS name, n_fit::DOUBLE AS value, 0 AS step FROM stop_report
        UNION ALL SELECT 'n_val', n_val, 0 FROM stop_report
        UNION ALL SELECT 'mae_naive', mae_naive, 0 FROM stop_report
        UNION ALL SELECT 'median_stop_min', median_stop_min, 0 FROM stop_report""",
    "impute_times": f"""SELECT {_ID}, round(a, 6) AS arrive_hrs, round(dep, 6) AS depart_hrs,
        round(stop, 4) AS stop_min, a_imp AS arrive_imputed, d_imp AS depart_imputed,
        s_imp AS stop_imputed FROM imp""",
    "interval_features": f"""SELECT {_ID}, fin AS is_finisher, spans AS spans_missing,
        round(leg_mi, 8) AS leg_mi, round(leg_min, 8) AS leg_min, round(leg_pace, 8) AS leg_pace,
        round(pace, 8) AS overall_pace, round(leg_ratio, 8) AS leg_ratio FROM legs""",
    "interval_ratio": f"""SELECT {_ID}, place, position, round(el, 8) AS elapsed_hrs,
        round(leg_pace, 8) AS leg_pace, round(pace, 8) AS overall_pace, round(leg_ratio, 8) AS leg_ratio,
        blk AS finish_block, station_id, station_mi FROM ratio""",
    "edition_kpis": "SELECT * FROM kpis",
    "arrival_windows": "SELECT edition, checkpoint, place, position, q10, q25, q50, q75, q90, "
    + ", ".join(f"{clock_of(f'q{p}')} AS clock{p}" for p in (10, 50, 90))
    + ", n FROM (SELECT edition, checkpoint, max(place) AS place, max(position) AS position, count(a) AS n, "
    + ", ".join(
        f"{floored(f'quantile_cont(a, {p / 100})', 'count(a)', 3)} AS q{p}" for p in (10, 25, 50, 75, 90)
    )
    + " FROM legs GROUP BY 1, 2)",
    "stop_medians": """SELECT edition, checkpoint, place, position, round(cov, 4) AS coverage,
            CASE WHEN cov >= 0.3 AND nf >= 5 THEN round(mf, 3) END AS median_finisher,
            CASE WHEN cov >= 0.3 AND no >= 5 THEN round(mo, 3) END AS median_other,
            nf AS n_finisher, no AS n_other
        FROM (SELECT edition, checkpoint, max(place) AS place, max(position) AS position,
            count(*) FILTER (WHERE NOT s_imp) / count(*) AS cov,
            median(stop) FILTER (WHERE NOT s_imp AND fin) AS mf,
            median(stop) FILTER (WHERE NOT s_imp AND NOT fin) AS mo,
            count(stop) FILTER (WHERE NOT s_imp AND fin) AS nf,
            count(stop) FILTER (WHERE NOT s_imp AND NOT fin) AS no FROM legs GROUP BY 1, 2)""",
    "leg_speeds": "SELECT * REPLACE (coalesce(n, 0) AS n) FROM speeds",
    "attrition": "SELECT * FROM ends",
    "flow_heatmap": "SELECT * FROM heat",
    "heat_cap": """SELECT edition, round(quantile_cont(n, 0.95), 3) AS cap, count(*) AS n_cells FROM heat
        WHERE n > 0 GROUP BY 1""",
    "scatter_sample": f"""SELECT {_ID}, round(position, 2) AS position, round(speed, 3) AS speed, station_id,
            blk AS finish_block
        FROM (SELECT *, row_number() OVER (PARTITION BY blk
                ORDER BY (entity * 7919 + position * 2)::BIGINT % 10007, entity, position) AS r,
            count(*) OVER (PARTITION BY blk) AS m, count(*) OVER () AS total
            FROM ratio WHERE station_id IS NOT NULL AND speed IS NOT NULL)
        WHERE r <= ceil(m * least(1::DOUBLE, 2000 / total))""",
    "station_speed_means": """SELECT station_id, round(avg(speed), 3) AS mean_speed, count(*) AS n FROM ratio
        WHERE station_id IS NOT NULL GROUP BY 1""",
    "cohort_trend": """SELECT blk AS finish_block, station_id, station_mi, round(avg(speed), 3) AS mean_speed,
            count(*) AS n FROM ratio WHERE station_id IS NOT NULL AND blk BETWEEN 20 AND 36
        GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
    "arrival_histogram": """SELECT station_id, greatest(least(floor(a * 2)::INTEGER, 71), 0) AS bin, count(*) AS n
        FROM timed JOIN xwalk USING (edition, checkpoint)
        WHERE station_id IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2""",
    "cohort_arrival_windows": "SELECT * FROM cohorts",
    "eta_table": "SELECT * FROM eta",
    "reproject_plan": f"""SELECT plan_id, goal_hrs, block, station_id, mile, round(pred, 4) AS predicted_hrs,
            {clock_of("pred")} AS predicted_clock, round(low, 4) AS typical_from_hrs, round(high, 4) AS typical_to_hrs,
            {clock_of("low")} AS typical_from_clock, {clock_of("high")} AS typical_to_clock,
            round(act, 4) AS actual_hrs, round(revised, 4) AS revised_hrs, {clock_of("revised")} AS revised_clock,
            round(finish, 4) AS projected_finish_hrs, {clock_of("finish")} AS projected_finish_clock,
            round((finish - goal_hrs) * 60, 4) AS minutes_to_goal
        FROM (SELECT *, f25 * goal_hrs AS low, f75 * goal_hrs AS high,
            coalesce(act, CASE WHEN anchor_mi > 0 THEN aa + (pred - ap) * k ELSE pred END) AS revised,
            CASE WHEN anchor_mi > 0 THEN aa + (goal_hrs - ap) * k ELSE goal_hrs END AS finish
        FROM (SELECT *, aa / greatest(0.1::DOUBLE, ap) AS k FROM (SELECT *,
            first_value(CASE WHEN act IS NOT NULL THEN act END) OVER w AS aa,
            first_value(CASE WHEN act IS NOT NULL THEN pred END) OVER w AS ap,
            first_value(CASE WHEN act IS NOT NULL THEN mile END) OVER w AS anchor_mi
            FROM (SELECT plan_id, goal_hrs, p.block, e.station_id, mile, f25, f75, f50 * goal_hrs AS pred, act
                FROM (SELECT c_custkey AS plan_id, round(18 + (c_acctbal + 1000) / 550, 2) AS goal_hrs,
                    greatest(least(round(round(18 + (c_acctbal + 1000) / 550, 2), 0)::BIGINT, 36), 20) AS block
                    FROM customer) p
                JOIN eta e ON p.block = e.block
                LEFT JOIN (SELECT o_custkey AS plan_id, station_id, min(a) AS act
                    FROM timed JOIN xwalk USING (edition, checkpoint) JOIN orders ON o_orderkey = entity
                    WHERE station_id IS NOT NULL AND position <= 15 * (1 + o_custkey % 7) AND a IS NOT NULL
                    GROUP BY 1, 2) k
                USING (plan_id, station_id))
            WINDOW w AS (PARTITION BY plan_id ORDER BY act IS NULL, mile DESC, station_id DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))""",
    "cohort_medians": """SELECT cohort, station_id, station_mi, round(median(speed), 3) AS median_speed,
            count(*) AS n
        FROM (SELECT *, CASE WHEN finish_hrs < 26 THEN 'under 26 h' WHEN finish_hrs < 30 THEN '26-30 h'
                WHEN finish_hrs < 34 THEN '30-34 h' WHEN finish_hrs < 99 THEN '34 h and over' END AS cohort
            FROM ratio WHERE station_id IS NOT NULL)
        WHERE cohort IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
    "axis_bounds": """SELECT round(quantile_cont(speed, 0.01), 3) AS low,
        round(quantile_cont(speed, 0.99), 3) AS high FROM ratio""",
    "payload_roundtrip": "SELECT edition, checkpoint, place, n FROM ends",
    "explore_rows": """SELECT edition, entity, name, checkpoint, finish_rank, furthest FROM splits
        WHERE edition IN (1996, 1997, 1999) AND finish_rank <> 'DNF'
        AND regexp_matches(lower(name), 'runner 1[0-9]*5$')""",
    "explore_counts": """SELECT count(*) FILTER (WHERE hit) AS n_rows,
            count(DISTINCT entity) FILTER (WHERE hit) AS n_entities,
            count(DISTINCT (edition, entity)) AS n_entities_total
        FROM (SELECT *, finish_rank <> 'DNF' AND regexp_matches(lower(name), 'runner 1[0-9]*5$') AS hit
            FROM splits WHERE edition IN (1996, 1997, 1999))""",
    "diagnose_timing": """SELECT count(DISTINCT (edition, entity)) AS n_entities, count(*) AS n_checkpoints,
        count(DISTINCT (edition, entity)) FILTER (WHERE pace_flag OR exceeds_cutoff OR arrive_interpolated)
            AS n_flagged,
        count(*) FILTER (WHERE pace_flag) AS pace_flag,
        count(*) FILTER (WHERE exceeds_cutoff) AS exceeds_cutoff,
        count(*) FILTER (WHERE arrive_interpolated) AS arrive_interpolated
        FROM flags WHERE edition IN (1996, 1997, 1999) AND dep IS NOT NULL""",
    "flagged_entities": """SELECT DISTINCT edition, entity FROM flags
        WHERE pace_flag OR exceeds_cutoff OR arrive_interpolated""",
    "check_splits": """SELECT unnest(['finisher_marked_dnf', 'finisher_without_finish', 'negative_arrival',
            'arrival_past_limit', 'departure_out_of_range', 'no_time', 'departs_before_arrival',
            'departs_an_hour_before_arrival', 'arrives_before_previous']) AS check_name,
        unnest([
            count(*) FILTER (WHERE official_rank IS NOT NULL AND finish_rank = 'DNF'),
            count(*) FILTER (WHERE official_rank IS NOT NULL AND furthest <> 'FINISH'),
            count(*) FILTER (WHERE a < 0), count(*) FILTER (WHERE a > 36),
            count(*) FILTER (WHERE dep < 0 OR dep > 36),
            count(*) FILTER (WHERE a IS NULL AND dep IS NULL),
            count(*) FILTER (WHERE d_abs < a_abs),
            count(*) FILTER (WHERE d_abs < a_abs - 3600), count(*) FILTER (WHERE a < prev)]) AS violations
        FROM (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY edition, entity ORDER BY cp
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM splits)""",
    "check_legs": """SELECT unnest(['arrival_missing_after_imputation', 'imputed_arrival_after_departure',
            'stop_too_long', 'imputed_stop_negative', 'leg_without_pace', 'pace_out_of_band']) AS check_name,
        unnest([count(*) FILTER (WHERE a IS NULL),
            count(*) FILTER (WHERE a_imp AND a > dep + 1e-9),
            count(*) FILTER (WHERE stop > 180), count(*) FILTER (WHERE s_imp AND stop < 0),
            count(*) FILTER (WHERE leg_min <= 0 OR leg_mi <= 0),
            count(*) FILTER (WHERE leg_pace < 6 OR leg_pace > 60)]) AS violations FROM legs""",
    "check_ratios": """SELECT check_name, round(v, 4) AS value, v BETWEEN low AND high AS in_range FROM (
        SELECT 'median_ratio_of_entities' AS check_name, quantile_cont(m, 0.5) AS v, 0.8 AS low, 1.05 AS high
            FROM (SELECT quantile_cont(leg_ratio, 0.5) AS m FROM legs GROUP BY edition, entity)
        UNION ALL SELECT 'median_ratio', quantile_cont(leg_ratio, 0.5), 0.75, 1.05 FROM ratio
        UNION ALL SELECT 'median_pace', quantile_cont(pace, 0.5), 10, 24 FROM ratio
        UNION ALL SELECT 'share_in_band', round(count(*) FILTER (WHERE leg_ratio > 0.3 AND leg_ratio < 3) / count(*), 4),
            0.99, 1 FROM ratio)""",
    "check_crosswalk": """SELECT 'key_not_listed' AS check_name, count(*) FILTER (WHERE x.checkpoint IS NULL) AS violations
            FROM (SELECT DISTINCT edition, checkpoint FROM clean) k LEFT JOIN xwalk x
                ON k.edition = x.edition AND k.checkpoint = x.checkpoint
        UNION ALL SELECT 'key_without_station', count(*) FROM xwalk
            WHERE station_id IS NULL AND (edition, checkpoint) IN (SELECT (edition, checkpoint) FROM clean)
        UNION ALL SELECT 'match_too_far', count(*) FROM xwalk
            WHERE round(abs(14.5::DOUBLE * right(checkpoint, 1)::INT - station_mi), 2) > 1.6
        UNION ALL SELECT 'place_at_two_stations', count(*) FROM
            (SELECT checkpoint FROM xwalk GROUP BY 1 HAVING count(DISTINCT station_id) > 1)""",
    "check_eta": """SELECT unnest(['block_not_ending_at_one', 'step_back', 'bounds_crossed']) AS check_name,
        unnest([count(*) FILTER (WHERE after IS NULL AND abs(f50 - 1) > 1e-3), count(*) FILTER (WHERE f50 < before),
            count(*) FILTER (WHERE f25 > f50 OR f50 > f75)]) AS violations
        FROM (SELECT *, lag(f50) OVER w AS before, lead(f50) OVER w AS after FROM eta
            WINDOW w AS (PARTITION BY block ORDER BY mile, station_id))""",
    "ratio_share_in_band": """SELECT round(count(*) FILTER (WHERE leg_ratio > 0.3 AND leg_ratio < 3)
        / count(*), 4) AS share, count(*) AS n FROM ratio""",
    "unmatched_keys": """SELECT DISTINCT edition, checkpoint FROM clean WHERE (edition, checkpoint) NOT IN
        (SELECT (edition, checkpoint) FROM xwalk WHERE station_id IS NOT NULL)""",
    "rows_with_time": "SELECT edition, count(*) AS n FROM timed WHERE dep IS NOT NULL GROUP BY 1",
    "worst_departures": f"""SELECT {_ID}, round(dep, 6) AS depart_hrs FROM timed
        ORDER BY dep DESC NULLS LAST, {_ID} LIMIT 5""",
    "finish_order": "SELECT * FROM forder",
    "share_table": """SELECT edition, status, n, round(n / sum(n) OVER (), 6) AS share,
            round(n / sum(n) OVER (PARTITION BY edition), 6) AS share_of_edition,
            sum(n - 0.5::DOUBLE * n) OVER (ORDER BY edition, status
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS centre
        FROM (SELECT edition, status, count(*) AS n FROM fins GROUP BY 1, 2)""",
    "share_spread": "SELECT edition, "
    + ", ".join(f"nullif(count(*) FILTER (WHERE status = '{s}'), 0) AS n_{s}" for s in "FOP")
    + ", "
    + ", ".join(
        f"round(nullif(count(*) FILTER (WHERE status = '{s}'), 0) / count(*) FILTER"
        f" (WHERE status IN ('F', 'O', 'P')), 6) AS share_{s}"
        for s in "FOP"
    )
    + " FROM fins GROUP BY 1",
    "rank_by_edition": "SELECT finish_order, "
    + ", ".join(
        f"coalesce(max(minutes) FILTER (WHERE edition = {y}), 0::DOUBLE) AS y{y}" for y in range(1995, 2002)
    )
    + " FROM forder GROUP BY 1",
    "edition_means": "SELECT * FROM emeans",
    "mean_quintiles": "SELECT "
    + ", ".join(f"round(quantile_cont(mean, {q / 100}), 4) AS q{q}" for q in (0, 20, 40, 60, 80, 100))
    + " FROM emeans",
    "fixed_histogram": """SELECT status, floor(minutes / 25) * 25 AS bin, count(*) AS n FROM fins
        GROUP BY 1, 2""",
    "box_summary": "SELECT year(o_orderdate)::BIGINT AS edition, "
    + ", ".join(
        f"round(quantile_cont(o_totalprice, {q}), 3) AS {n}"
        for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))
    )
    + ", count(*) AS n FROM orders GROUP BY 1",
    "band_counts": """SELECT status, least(greatest((age - 10) // 10 + 1, CASE WHEN age < 10 THEN 0 ELSE 1 END),
            10)::INTEGER AS band, count(*) AS n FROM (SELECT * FROM fins WHERE age >= 10) GROUP BY 1, 2
        UNION ALL SELECT status, 0, count(*) FROM fins WHERE age < 10 GROUP BY 1""",
    "median_frames": """SELECT edition, row_number() OVER (ORDER BY edition)::INTEGER AS n_editions,
        round(m, 4) AS median FROM (SELECT edition, quantile_cont(minutes / 60, 0.5) AS m FROM fins GROUP BY 1)""",
    "csv_typed_scan": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
        FROM orders""",
    "csv_text_scan": """SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice,
        NULL::BIGINT AS o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
        FROM orders""",
    "edition_rows_roundtrip": """SELECT DISTINCT year(o_orderdate)::BIGINT AS edition,
        year(o_orderdate) || '-08-10' AS start_date, '05:00' AS start_clock FROM orders""",
    "sparse_results_scan": """SELECT year(o_orderdate)::BIGINT AS edition, o_orderkey AS entity,
        'Runner ' || o_custkey AS name,
        CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'male' END AS gender,
        CASE WHEN o_custkey % 23 <> 0 THEN (20 + o_custkey % 50)::BIGINT END AS age, NULL::VARCHAR AS city,
        (o_orderkey % 1000 + 1)::BIGINT AS official_rank,
        CASE WHEN o_orderkey % 4999 = 0 THEN '29:59:59' END AS finish_text,
        round(20 + o_totalprice / 31250, 6) AS finish_hrs, round((20 + o_totalprice / 31250) * 60, 4) AS finish_min
        FROM orders WHERE o_orderstatus = 'F'""",
    "blank_edition_records": """SELECT DISTINCT 'Race, ' || year(o_orderdate) AS race_name, year(o_orderdate)::BIGINT AS edition,
        101.5::DOUBLE AS race_distance, year(o_orderdate) || '-08-10' AS start_date, '05:00' AS start_clock FROM orders""",
    "partitioned_parquet": "SELECT edition, entity, cp, a_text AS arrive_text FROM clean",
    "gpx_route_points": """SELECT (p_partkey // 500)::VARCHAR AS route,
        row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS seq,
        round(41 + (p_partkey % 997) / 2000::DOUBLE, 6) AS lat,
        round(-77 + (p_partkey * 7 % 991) / 2000::DOUBLE, 6) AS lon,
        CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey % 700)::DOUBLE END AS ele_m FROM part""",
    "gpx_waypoints": """SELECT *, CASE WHEN gpx_name LIKE '% - %' THEN split_part(gpx_name, ' - ', 2)
            ELSE gpx_name END AS name
        FROM (SELECT route, station_id, lat, lon, CASE WHEN p_size = 46 THEN 'wpt_' || station_id
                ELSE 'AS' || p_partkey || ' - ' || p_name END AS gpx_name
            FROM (SELECT *, (p_partkey // 500)::VARCHAR AS route,
                row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS station_id,
                round(41 + (p_partkey % 997) / 2000::DOUBLE, 6) AS lat,
                round(-77 + (p_partkey * 7 % 991) / 2000::DOUBLE, 6) AS lon
                FROM part WHERE p_size > 45))""",
    "preview": "SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 LIMIT 50",
    "elapsed_minutes": f"SELECT {_ID}, round((d_abs - 18000) / 60::DOUBLE, 4) AS minutes FROM timed",
    "clock_labels": f"""SELECT {_ID}, {clock_of('a')} AS label, {clock_of('(a + 1 / 120::DOUBLE)')} AS label_half_on
        FROM timed""",
    "lenient_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0
        THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""",
    "slowest_leg": """SELECT edition, checkpoint, place, mph, n FROM (SELECT *, row_number() OVER
            (PARTITION BY edition ORDER BY mph, checkpoint) AS r FROM speeds WHERE mph IS NOT NULL)
        WHERE r = 1""",
}


def _needs(sql: str, found: set[str]) -> set[str]:
    for name, body in SHARED.items():
        if name not in found and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", sql):
            found.add(name)
            _needs(body, found)
    return found


def _decimal_rounds(sql: str) -> str:
    """``round(x, n)`` through a decimal of nine digits, so that a half is a half in both engines."""
    out, i = "", 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return out + sql[i:]
        depth, comma, k = 0, None, j + 6
        while depth or sql[k] != ")":
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 0 else comma
            k += 1
        inner, digits = _decimal_rounds(sql[j + 6 : comma]), sql[comma + 1 : k].strip()
        out += sql[i:j]
        if digits == "9":
            out += f"round({inner}, 9)"
        else:
            out += f"round(({inner})::DECIMAL(28, 9), {digits})::DOUBLE"
        i = k + 1


# Sections of the payload: (section, query, edition, id, numeric fields).
SECTIONS = [
    ("years", "SELECT DISTINCT edition AS year, edition FROM legs", None, "year", "edition"),
    ("stations", "SELECT station_id, mi AS scaled_mi FROM refs WHERE station_id > 0", None, "station_id", "scaled_mi"),
    ("kpis", "edition_kpis", "edition", "edition", "starters finishers finish_rate median_finish_hrs median_stop_min"),
    ("arrivals", "arrival_windows", "edition", "checkpoint", "position q10 q25 q50 q75 q90 n"),
    ("stops", "stop_medians", "edition", "checkpoint", "position coverage median_finisher median_other n_finisher n_other"),
    ("legs", "leg_speeds", "edition", "checkpoint", "position leg_mi mph pace n edition_mph"),
    ("attrition", "attrition", "edition", "checkpoint", "position n"),
    ("heat", "flow_heatmap", "edition", "checkpoint hour", "n"),
    ("heat_cap", "heat_cap", "edition", "edition", "cap n_cells"),
    ("points", "scatter_sample", "edition", "entity checkpoint", "position speed station_id finish_block"),
    ("means", "station_speed_means", None, "station_id", "mean_speed n"),
    ("trend", "cohort_trend", None, "station_id finish_block", "station_mi mean_speed n"),
    ("bins", "arrival_histogram", None, "station_id bin", "n"),
    ("cohort_windows", "cohort_arrival_windows", None, "station_id finish_block", "p25 p50 p75 n"),
    ("cohorts", "cohort_medians", None, "cohort station_id", "station_mi median_speed n"),
    ("axis", "SELECT 'speed' AS axis, a.* FROM ({axis_bounds}) a", None, "axis", "low high"),
    ("planner", "eta_table", None, "block station_id", "mile f25 f50 f75"),
]
COURSE_SECTIONS = [
    ("points", "route_downsample", "route", "seq", "kept_index lat lon"),
    ("stations", """SELECT i.route, i.station_id, kept_index, scaled_mi FROM ({station_indexes}) i
        JOIN snapped s ON i.route = s.route AND i.station_id = s.station_id""", "route", "station_id", "kept_index scaled_mi"),
    ("total", "SELECT route, 'mi' AS unit, max(round(mi, 3)) AS total_mi FROM path GROUP BY 1", "route", "unit", "total_mi"),
]


def fields_of(sections: list[tuple], edition_as: str) -> str:
    """Numeric fields of all sections as rows, nulls left out."""
    parts = []
    for section, source, edition, label, fields in sections:
        sql = SQL.get(source) or re.sub(r"\{(\w+)\}", lambda m: SQL[m.group(1)], source)
        own = ", ".join(f"{c}::VARCHAR" for c in label.split())
        names = ", ".join(f"'{c}'" for c in fields.split())
        values = ", ".join(f"{c}::DOUBLE" for c in fields.split())
        parts.append(
            f"SELECT {edition or 'NULL'}::BIGINT AS {edition_as}, '{section}' AS section, concat_ws('|', {own}) AS id,"
            f" unnest([{names}]) AS field, unnest([{values}]) AS number FROM ({sql})"
        )
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE number IS NOT NULL"


RUN_SECTIONS = ["edition_kpis", "arrival_windows", "stop_medians", "leg_speeds", "attrition", "flow_heatmap"]

SQL["bucketed_legs"] = SQL["interval_features"]
SQL["report_run"] = "\nUNION ALL ".join(
    f"SELECT '{s}' AS section, edition, count(*) AS n FROM ({SQL[s]}) GROUP BY edition" for s in RUN_SECTIONS
)
SQL["report_payload"] = fields_of(SECTIONS, "edition")
SQL["course_payload"] = fields_of(COURSE_SECTIONS, "route")


def all_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        used = _needs(sql, set())
        shared = ",\n".join(f"{n} AS ({b})" for n, b in SHARED.items() if n in used)
        out[name] = _decimal_rounds(f"WITH {shared}\n{sql}" if shared else sql)
    return out
