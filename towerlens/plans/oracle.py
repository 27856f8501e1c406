"""The registered queries as SQL for DuckDB over the same tables."""

# The input views and the derived views, shared by all queries.
VIEWS = """
WITH signal AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS imsi,
         concat('C', CAST((user_id * 7 + (epoch_us(ts) // 1000) // 86400000) % 30 AS VARCHAR)) AS laccell,
         epoch_us(ts) // 1000 AS start_ms, CAST(ts AS TIMESTAMP) AS event_ts
  FROM events),
user_info AS (
  SELECT CAST(c_custkey AS VARCHAR) AS imsi, CAST(c_custkey % 2 AS VARCHAR) AS gender,
         CAST((c_custkey * 37) % 90 AS INTEGER) AS age
  FROM customer WHERE c_custkey % 10 <> 9),
region_cell AS (
  SELECT concat('R', CAST(n_regionkey AS VARCHAR)) AS region_id,
         concat('C', CAST(n_nationkey AS VARCHAR)) AS laccell FROM nation),
target_region AS (
  SELECT concat('R', CAST(r_regionkey AS VARCHAR)) AS region_id FROM region WHERE r_regionkey IN (0, 2, 3)),
signal_lines AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN concat('bad', imsi)
         ELSE concat_ws('|', imsi, laccell,
              concat('23.', lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')),
              concat('113.', lpad(CAST((event_id * 7) % 100000 AS VARCHAR), 5, '0')),
              CAST(start_ms AS VARCHAR)) END AS line FROM signal),
user_lines AS (
  SELECT concat_ws('|', CAST(c_custkey AS VARCHAR), CAST(c_custkey % 2 AS VARCHAR),
         CASE WHEN c_custkey % 53 = 0 THEN 'x' ELSE CAST((c_custkey * 37) % 90 AS VARCHAR) END) AS line
  FROM customer),
cell_lines AS (
  SELECT p_partkey AS line_no,
         CASE WHEN p_partkey % 41 = 0 THEN concat('R', CAST((p_partkey // 8) % 97 AS VARCHAR))
         ELSE concat_ws('|', concat('R', CAST((p_partkey // 8) % 97 AS VARCHAR)),
                        concat('C', CAST(p_partkey AS VARCHAR))) END AS line
  FROM part),
site_lines AS (
  SELECT s_suppkey AS line_no,
         concat_ws('|', concat('R', CAST(s_suppkey // 2 AS VARCHAR)),
                   concat('113.', CAST(s_suppkey % 90 + 10 AS VARCHAR), ',23.5'),
                   concat('113.1,23.1;113.2,23.', CAST(s_suppkey % 9 + 1 AS VARCHAR), ';113.3,23.3'),
                   CASE WHEN s_suppkey % 13 <> 0 THEN s_name END) AS line
  FROM supplier),
region_center AS (
  SELECT concat('R', CAST(r_regionkey AS VARCHAR)) AS region_id, r_name AS name,
         CAST(concat('113.', CAST(100 + r_regionkey AS VARCHAR)) AS DOUBLE) AS center_x,
         CAST(concat('23.', CAST(100 + r_regionkey AS VARCHAR)) AS DOUBLE) AS center_y,
         4 AS n_boundary_points
  FROM region WHERE r_regionkey <> 4),
user_index AS (
  SELECT imsi, row_number() OVER (ORDER BY imsi) AS bitmap_id FROM (SELECT DISTINCT imsi FROM user_info)),
region_hour_members AS (
  SELECT DISTINCT rc.region_id, strftime(e.event_ts, '%Y%m%d%H') AS produce_hour, ui.bitmap_id
  FROM signal e LEFT JOIN region_cell rc ON e.laccell = rc.laccell
                LEFT JOIN user_index ui ON e.imsi = ui.imsi),
portrait_members AS (
  SELECT CASE gender WHEN '1' THEN 1 WHEN '0' THEN 2 END AS portrait_id, bitmap_id
  FROM user_info u JOIN user_index i ON u.imsi = i.imsi WHERE age >= 10
  UNION ALL
  SELECT CASE WHEN age < 20 THEN 3 WHEN age < 40 THEN 4 ELSE 5 END, bitmap_id
  FROM user_info u JOIN user_index i ON u.imsi = i.imsi WHERE age >= 10),
all_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS imsi, CAST(c_custkey % 3 AS VARCHAR) AS gender,
         CAST((c_custkey * 37) % 90 AS INTEGER) AS age FROM customer),
all_index AS (
  SELECT imsi, row_number() OVER (ORDER BY imsi) AS bitmap_id FROM (SELECT DISTINCT imsi FROM all_users)),
all_portrait_members AS (
  SELECT CASE gender WHEN '1' THEN 1 WHEN '0' THEN 2 END AS portrait_id, bitmap_id
  FROM all_users u JOIN all_index i ON u.imsi = i.imsi WHERE age >= 10 AND gender IN ('0', '1')
  UNION ALL
  SELECT CASE WHEN age < 20 THEN 3 WHEN age < 40 THEN 4 ELSE 5 END, bitmap_id
  FROM all_users u JOIN all_index i ON u.imsi = i.imsi WHERE age >= 10),
portrait_names(portrait_id, portrait_value, comment) AS (
  VALUES (1, '1', '男性'), (2, '0', '女性'), (3, '10', '10-20岁人员'),
         (4, '20', '20-40岁人员'), (5, '40', '40岁以上人员')),
matrix AS (
  SELECT m.region_id, m.produce_hour, p.portrait_id, count(*) AS n_users
  FROM region_hour_members m JOIN portrait_members p ON m.bitmap_id = p.bitmap_id
  GROUP BY m.region_id, m.produce_hour, p.portrait_id),
urf AS (
  SELECT e.imsi, rc.region_id, u.gender, u.age, e.event_ts, e.event_id
  FROM signal e JOIN user_info u ON e.imsi = u.imsi JOIN region_cell rc ON e.laccell = rc.laccell),
persona AS (
  SELECT region_id, date_trunc('hour', event_ts) AS window_start,
         count(*) FILTER (WHERE gender = '1') AS man,
         count(*) - count(*) FILTER (WHERE gender = '1') AS women,
         count(*) FILTER (WHERE age >= 10 AND age < 20) AS age_10_20,
         count(*) FILTER (WHERE age >= 20 AND age < 40) AS age_20_40,
         count(*) FILTER (WHERE age >= 40) AS age_40, count(*) AS pep_cnt
  FROM urf GROUP BY 1, 2),
current_persona AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY window_start DESC) AS rn FROM persona)
  WHERE rn = 1),
chg AS (
  SELECT * FROM (SELECT *, lag(region_id) OVER (PARTITION BY imsi ORDER BY event_ts, event_id) AS prev FROM urf)
  WHERE prev IS NULL OR prev <> region_id),
flow_all AS (
  SELECT imsi, 0 AS event_type, prev AS region_id, gender, age, event_ts FROM chg WHERE prev IS NOT NULL
  UNION ALL SELECT imsi, 1, region_id, gender, age, event_ts FROM chg),
flow AS (
  SELECT * FROM flow_all WHERE region_id IN (SELECT region_id FROM target_region)),
visits AS (
  SELECT * FROM (SELECT *, lead(event_ts) OVER (PARTITION BY imsi ORDER BY event_ts, event_id) AS exit_ts FROM chg)
  WHERE region_id IN (SELECT region_id FROM target_region)),
stays AS (
  SELECT imsi, 2 AS event_type, region_id, gender, age, event_ts + INTERVAL 24 HOUR AS event_ts FROM visits
  WHERE event_ts + INTERVAL 24 HOUR <= coalesce(exit_ts, (SELECT max(event_ts) FROM signal))
  UNION ALL
  SELECT imsi, 3, region_id, gender, age, exit_ts FROM visits
  WHERE exit_ts IS NOT NULL AND event_ts + INTERVAL 24 HOUR <= exit_ts),
deltas AS (
  SELECT imsi, region_id, event_ts, event_type,
         CAST(CASE event_type WHEN 2 THEN 1 ELSE -1 END AS BIGINT) AS delta FROM stays),
region_list AS (
  SELECT seq, region_id FROM (
    SELECT line_no AS seq, trim(split_part(line, '|', 1)) AS region_id,
           lag(trim(split_part(line, '|', 1))) OVER (ORDER BY line_no) AS before FROM cell_lines)
  WHERE before IS NULL OR before <> region_id)
"""

_PORTRAIT_SIZES = """
SELECT n.portrait_id, n.portrait_value, n.comment, count(*) AS n_users
FROM all_portrait_members p JOIN portrait_names n ON p.portrait_id = n.portrait_id
WHERE n.portrait_id IN ({ids}) GROUP BY ALL
"""

_INTERSECTION = """
FROM region_hour_members m JOIN portrait_members p ON m.bitmap_id = p.bitmap_id
WHERE m.region_id = 'R0' AND m.produce_hour = '2024011108' AND p.portrait_id = 5
"""

_LATEST = """
SELECT imsi, gender, age, event_ts, event_type FROM {source} WHERE region_id = 'R0'
ORDER BY event_ts DESC, imsi, event_type LIMIT 50
"""

_QUERIES = {
    "scan_signal": "SELECT event_id, imsi, laccell, start_ms, event_ts FROM signal",
    "scan_signal_hour": """
SELECT event_id, imsi, laccell, start_ms, event_ts FROM signal
WHERE strftime(event_ts, '%Y%m%d%H') = '2024011108'""",
    "scan_user_info": "SELECT imsi, gender, age FROM all_users",
    "scan_region_cell": """
SELECT split_part(line, '|', 1) AS region_id, split_part(line, '|', 2) AS laccell
FROM cell_lines WHERE len(string_split(line, '|')) >= 2""",
    "scan_region_center": """
SELECT region_id, name, center_x, center_y, n_boundary_points FROM (
  SELECT p[1] AS region_id, p[4] AS name,
         CAST(string_split(p[2], ',')[1] AS DOUBLE) AS center_x,
         CAST(string_split(p[2], ',')[2] AS DOUBLE) AS center_y,
         CAST(len(string_split(p[3], ';')) AS INTEGER) AS n_boundary_points,
         row_number() OVER (PARTITION BY p[1] ORDER BY line_no DESC) AS rn
  FROM (SELECT line_no, string_split(line, '|') AS p FROM site_lines) WHERE len(p) = 4)
WHERE rn = 1""",
    "parse_signal": """
SELECT event_id, p[1] AS imsi, p[2] AS laccell, CAST(p[3] AS DOUBLE) AS latitude,
       CAST(p[4] AS DOUBLE) AS longitude, CAST(p[5] AS BIGINT) AS start_ms
FROM (SELECT event_id, string_split(line, '|') AS p FROM signal_lines) WHERE len(p) = 5""",
    "parse_user_info": """
SELECT p[1] AS imsi, p[2] AS gender, TRY_CAST(p[3] AS INTEGER) AS age
FROM (SELECT string_split(line, '|') AS p FROM user_lines) WHERE TRY_CAST(p[3] AS INTEGER) > -1""",
    "parse_reject_count": """
SELECT 'signal' AS input, count(*) FILTER (WHERE len(string_split(line, '|')) = 5) AS n_ok,
       count(*) FILTER (WHERE len(string_split(line, '|')) < 5) AS n_rejected FROM signal_lines
UNION ALL
SELECT 'signal_cell', count(*) FILTER (WHERE len(string_split(line, '|')) >= 2),
       count(*) FILTER (WHERE len(string_split(line, '|')) < 2) FROM signal_lines
UNION ALL
SELECT 'user_info', count(TRY_CAST(split_part(line, '|', 3) AS INTEGER)),
       count(*) - count(TRY_CAST(split_part(line, '|', 3) AS INTEGER)) FROM user_lines
UNION ALL
SELECT 'region_cell', count(*) FILTER (WHERE contains(line, '|')),
       count(*) FILTER (WHERE NOT contains(line, '|')) FROM cell_lines
UNION ALL
SELECT 'region_center', count(*) FILTER (WHERE len(string_split(line, '|')) = 4),
       count(*) FILTER (WHERE len(string_split(line, '|')) <> 4) FROM site_lines""",
    "signal_hour": "SELECT event_id, strftime(event_ts, '%Y%m%d%H') AS produce_hour FROM signal",
    "user_index": "SELECT imsi, bitmap_id FROM all_index",
    "user_index_extended": """
SELECT imsi, bitmap_id FROM user_index
UNION ALL
SELECT imsi, (SELECT max(bitmap_id) FROM user_index) + row_number() OVER (ORDER BY imsi)
FROM (SELECT DISTINCT imsi FROM signal WHERE imsi NOT IN (SELECT imsi FROM user_index))""",
    "user_age_band": """
SELECT imsi, CASE WHEN age >= 10 AND age < 20 THEN '10' WHEN age >= 20 AND age < 40 THEN '20'
       WHEN age >= 40 THEN '40' END AS age_flag FROM all_users""",
    "user_age_band_alt": """
SELECT imsi, CASE WHEN age <= 20 THEN 'age20down' WHEN age <= 40 THEN 'age20-40' ELSE 'age40up' END AS age_flag,
       CASE gender WHEN '1' THEN 'boy' WHEN '0' THEN 'girl' ELSE 'none' END AS gender_flag FROM all_users""",
    "portrait_gender": _PORTRAIT_SIZES.format(ids="1, 2"),
    "portrait_age": _PORTRAIT_SIZES.format(ids="3, 4, 5"),
    "portraits": _PORTRAIT_SIZES.format(ids="1, 2, 3, 4, 5"),
    "portrait_alt": """
SELECT n.portrait_id, v.portrait_value, n.comment, count(*) AS n_users FROM (
  SELECT CASE gender WHEN '1' THEN 'boy' WHEN '0' THEN 'girl' ELSE 'none' END AS portrait_value
  FROM all_users u JOIN all_index i ON u.imsi = i.imsi
  UNION ALL
  SELECT CASE WHEN age <= 20 THEN 'age20down' WHEN age <= 40 THEN 'age20-40' ELSE 'age40up' END
  FROM all_users u JOIN all_index i ON u.imsi = i.imsi) v
LEFT JOIN (VALUES (1, 'boy', '男孩'), (2, 'girl', '女孩'), (3, 'age20down', '年龄小于20岁'),
           (4, 'age20-40', '年龄20到40岁'), (5, 'age40up', '年龄40岁以上'))
  AS n(portrait_id, portrait_value, comment) ON v.portrait_value = n.portrait_value
GROUP BY ALL""",
    "portrait_members": "SELECT portrait_id, bitmap_id FROM all_portrait_members",
    "region_hour_users": "SELECT region_id, produce_hour, bitmap_id FROM region_hour_members",
    "region_hour_users_inner": """
SELECT region_id, produce_hour, bitmap_id FROM region_hour_members
WHERE region_id IS NOT NULL AND bitmap_id IS NOT NULL""",
    "region_hour_count": """
SELECT region_id, produce_hour, count(bitmap_id) AS n_users FROM region_hour_members GROUP BY 1, 2""",
    "bitmap_buckets": """
SELECT portrait_id, (bitmap_id - 1) // 32768 + 1 AS bucket, count(DISTINCT bitmap_id) AS n_bits
FROM all_portrait_members GROUP BY 1, 2""",
    "bitmap_buckets_wide": """
SELECT o_orderstatus AS status, (o_orderkey * 101 + 5000000000 - 1) // 32768 + 1 AS bucket,
       count(DISTINCT o_orderkey) AS n_bits FROM orders GROUP BY 1, 2""",
    "bitmap_to_ids": """
SELECT region_id, produce_hour, bitmap_id FROM region_hour_members
WHERE region_id IS NOT NULL AND bitmap_id IS NOT NULL""",
    "region_day_users": """
SELECT region_id, substr(produce_hour, 1, 8) AS produce_day, count(DISTINCT bitmap_id) AS n_users
FROM region_hour_members WHERE bitmap_id IS NOT NULL GROUP BY 1, 2""",
    "bitmap_and_count": "SELECT region_id, produce_hour, portrait_id, n_users FROM matrix",
    "portrait_region_hour_count": "SELECT count(*) AS n_users" + _INTERSECTION,
    "portrait_region_hour_users": "SELECT m.bitmap_id" + _INTERSECTION,
    "portrait_region_hour_matrix": "SELECT region_id, produce_hour, portrait_id, n_users FROM matrix",
    "enriched_signal": """
SELECT e.imsi, e.laccell, u.gender, u.age, e.event_ts FROM signal e JOIN user_info u ON e.imsi = u.imsi""",
    "user_region_flow": "SELECT imsi, region_id, gender, age, event_ts FROM urf",
    "region_persona_window": """
SELECT *, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start_text,
       strftime(window_start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end_text FROM persona""",
    "region_persona_people": """
SELECT region_id, time_bucket(INTERVAL 10 SECOND, event_ts) AS window_start,
       count(*) FILTER (WHERE gender = '1') AS man,
       count(*) - count(*) FILTER (WHERE gender = '1') AS women,
       count(*) FILTER (WHERE age >= 10 AND age < 20) AS age_10_20,
       count(*) FILTER (WHERE age >= 20 AND age < 40) AS age_20_40,
       count(*) FILTER (WHERE age >= 40) AS age_40, count(*) AS pep_cnt,
       count(DISTINCT imsi) AS distinct_users
FROM urf GROUP BY 1, 2""",
    "flow_events": "SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow",
    "flow_events_all": "SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow_all",
    "region_visits": "SELECT imsi, region_id, event_ts AS enter_ts, exit_ts FROM visits",
    "stay_events": "SELECT imsi, event_type, region_id, gender, age, event_ts FROM stays",
    "stay_delta": "SELECT imsi, region_id, event_ts, event_type, delta FROM deltas",
    "stay_running_total": """
SELECT region_id, event_ts, imsi, event_type,
       CAST(sum(delta) OVER (PARTITION BY region_id ORDER BY event_ts, event_type, imsi
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stay_count FROM deltas""",
    "stay_total": "SELECT region_id, CAST(sum(delta) AS BIGINT) AS stay_count FROM deltas GROUP BY 1",
    "stream_visit_events": """
SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow
UNION ALL SELECT imsi, event_type, region_id, gender, age, event_ts FROM stays""",
    "stream_reject_count": """
SELECT 'signal' AS input, count(*) FILTER (WHERE len(string_split(line, '|')) = 5) AS n_ok,
       count(*) FILTER (WHERE len(string_split(line, '|')) < 5) AS n_rejected FROM signal_lines
UNION ALL
SELECT 'user_info', count(TRY_CAST(split_part(line, '|', 3) AS INTEGER)),
       count(*) - count(TRY_CAST(split_part(line, '|', 3) AS INTEGER)) FROM user_lines
UNION ALL
SELECT 'region_cell', count(*) FILTER (WHERE contains(line, '|')),
       count(*) FILTER (WHERE NOT contains(line, '|')) FROM cell_lines""",
    "visits_by_load": """
SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow
UNION ALL SELECT imsi, event_type, region_id, gender, age, event_ts FROM stays""",
    "stream_from_history": """
SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow
UNION ALL SELECT imsi, event_type, region_id, gender, age, event_ts FROM stays""",
    "stream_running_stays": """
SELECT region_id, event_ts, imsi, event_type,
       CAST(sum(delta) OVER (PARTITION BY region_id ORDER BY event_ts, event_type, imsi
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stay_count FROM deltas""",
    "stream_open_visits": "SELECT imsi, region_id, event_ts AS enter_ts FROM visits WHERE exit_ts IS NULL",
    "stream_stay_totals": """
SELECT region_id, CAST(sum(delta) AS BIGINT) AS stay_count, max(event_ts) AS ts FROM deltas GROUP BY 1""",
    "stream_persona_windows": """
SELECT region_id, window_start, man, women, age_10_20, age_20_40, age_40, pep_cnt FROM persona""",
    "region_hour_users_skewed": "SELECT region_id, produce_hour, bitmap_id FROM region_hour_members",
    "flow_events_skewed": "SELECT imsi, event_type, region_id, gender, age, event_ts FROM flow",
    "region_day_users_bitmap": """
SELECT region_id, substr(produce_hour, 1, 8) AS produce_day, count(DISTINCT bitmap_id) AS n_users
FROM region_hour_members WHERE bitmap_id IS NOT NULL GROUP BY 1, 2""",
    "bitmap_and_ids": """
SELECT m.region_id, m.produce_hour, p.portrait_id, m.bitmap_id
FROM region_hour_members m JOIN portrait_members p ON m.bitmap_id = p.bitmap_id
WHERE m.region_id = 'R0' AND m.produce_hour = '2024011108'""",
    "region_day_users_sets": """
SELECT region_id, substr(produce_hour, 1, 8) AS produce_day, count(DISTINCT bitmap_id) AS n_users
FROM region_hour_members WHERE bitmap_id IS NOT NULL GROUP BY 1, 2""",
    "set_and_count": "SELECT region_id, produce_hour, portrait_id, n_users FROM matrix",
    "set_and_ids": """
SELECT m.region_id, m.produce_hour, p.portrait_id, m.bitmap_id
FROM region_hour_members m JOIN portrait_members p ON m.bitmap_id = p.bitmap_id
WHERE m.region_id = 'R0' AND m.produce_hour = '2024011108'""",
    "region_day_people_sketch": """
SELECT region_id, substr(produce_hour, 1, 8) AS produce_day, count(DISTINCT bitmap_id) AS n_users,
       true AS within_bound
FROM region_hour_members WHERE bitmap_id IS NOT NULL GROUP BY 1, 2""",
    "portrait_day_people_sketch": """
SELECT m.region_id, substr(m.produce_hour, 1, 8) AS produce_day, p.portrait_id,
       count(DISTINCT m.bitmap_id) AS n_users, true AS within_bound
FROM region_hour_members m JOIN portrait_members p ON m.bitmap_id = p.bitmap_id
WHERE m.region_id IS NOT NULL GROUP BY 1, 2, 3""",
    "stored_index_buckets": """
SELECT imsi, bitmap_id FROM user_index
UNION ALL
SELECT imsi, (SELECT max(bitmap_id) FROM user_index) + row_number() OVER (ORDER BY imsi)
FROM (SELECT DISTINCT imsi FROM signal WHERE imsi NOT IN (SELECT imsi FROM user_index))""",
    "stored_region_hours": "SELECT region_id, produce_hour, bitmap_id FROM region_hour_members",
    "stored_index_extended": """
SELECT imsi, bitmap_id FROM user_index
UNION ALL
SELECT imsi, (SELECT max(bitmap_id) FROM user_index) + row_number() OVER (ORDER BY imsi)
FROM (SELECT DISTINCT imsi FROM signal WHERE imsi NOT IN (SELECT imsi FROM user_index))""",
    "stored_portraits": _PORTRAIT_SIZES.format(ids="1, 2, 3, 4, 5"),
    "stored_newest_events": _LATEST.format(source="flow"),
    "stored_latest_events": _LATEST.format(source="flow"),
    "stored_keyed_portraits": """
SELECT c.*, n.name FROM current_persona c LEFT JOIN region_center n ON c.region_id = n.region_id""",
    "stored_region_portrait": """
SELECT c.*, n.name FROM current_persona c LEFT JOIN region_center n ON c.region_id = n.region_id""",
    "stored_text_heatmap": """
SELECT CAST(coalesce(sum(age_10_20), 0) AS BIGINT) AS age_10_20, CAST(coalesce(sum(age_20_40), 0) AS BIGINT) AS age_20_40,
       CAST(coalesce(sum(age_40), 0) AS BIGINT) AS age_40,
       CAST(coalesce(sum(man) FILTER (WHERE region_id <> 'R0'), 0) AS BIGINT) AS man,
       CAST(coalesce(sum(women), 0) AS BIGINT) AS women FROM current_persona""",
    "served_by_parameters": """
SELECT bitmap_id FROM region_hour_members WHERE region_id = 'R0' AND produce_hour = '2024011108'""",
    "region_portrait": """
SELECT c.*, n.name FROM current_persona c LEFT JOIN region_center n ON c.region_id = n.region_id""",
    "region_stay_total": """
SELECT region_id, CAST(sum(delta) AS BIGINT) AS stay_count, max(event_ts) AS ts FROM deltas
WHERE region_id = 'R0' GROUP BY 1""",
    "latest_flow_events": _LATEST.format(source="flow"),
    "latest_stay_detail": _LATEST.format(source="stays"),
    "latest_per_region": """
SELECT imsi, event_type, region_id, gender, age, event_ts, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY event_ts DESC, imsi, event_type) AS rank FROM flow)
WHERE rank <= 50""",
    "heatmap_totals": """
SELECT CAST(coalesce(sum(age_10_20), 0) AS BIGINT) AS age_10_20, CAST(coalesce(sum(age_20_40), 0) AS BIGINT) AS age_20_40,
       CAST(coalesce(sum(age_40), 0) AS BIGINT) AS age_40, CAST(coalesce(sum(man), 0) AS BIGINT) AS man,
       CAST(coalesce(sum(women), 0) AS BIGINT) AS women FROM current_persona""",
    "heatmap_regions": """
SELECT c.region_id, c.pep_cnt, n.center_x, n.center_y, n.n_boundary_points
FROM current_persona c LEFT JOIN region_center n ON c.region_id = n.region_id""",
    "heatmap_flat": """
SELECT c.*, n.name, n.center_x, n.center_y, n.n_boundary_points
FROM current_persona c LEFT JOIN region_center n ON c.region_id = n.region_id""",
    "adjacent_dedup_regions": "SELECT seq, region_id FROM region_list",
    "sample_regions": """
SELECT seq, region_id FROM region_list
ORDER BY md5(concat_ws('|', CAST(seq AS VARCHAR), region_id, '7')), seq LIMIT 40""",
}

ORACLE = {name: VIEWS + text for name, text in _QUERIES.items()}
