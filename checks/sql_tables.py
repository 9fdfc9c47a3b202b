"""SQL definitions (DuckDB) of the derived tables, as common table expressions.

Written independently of the Spark code: each statement repeats the definition
of the tables it needs over the raw parquet views.
"""

from __future__ import annotations

SAMPLES = """
nodes_of_events AS (
  SELECT *, (user_id * 7) % 60 AS ni,
         CASE WHEN (user_id * 7) % 60 >= 36 THEN 1 ELSE 0 END AS gpu
  FROM events),
samples AS (
  SELECT event_id AS prom_id,
    'r' || (10 + ni // 6)::VARCHAR || 'n' || (1 + ni % 6)::VARCHAR AS node,
    ts AS "timestamp", gpu AS gpu_node,
    (20 + event_id % 8)::DOUBLE AS node_ambient_temp,
    80 + value AS node_power_usage,
    value / 4 AS node_load1,
    40 + value / 2 AS node_rapl_package_power_sum,
    value * 5e8 AS node_memory_Active_bytes,
    30 + value / 10 AS node_thermal_zone_temp_min,
    30 + value / 9 AS node_thermal_zone_temp_mean,
    30 + value / 8 AS node_thermal_zone_temp_max,
    28 + value / 10 AS node_hwmon_temp_celsius_min,
    28 + value / 9 AS node_hwmon_temp_celsius_mean,
    28 + value / 8 AS node_hwmon_temp_celsius_max,
    gpu * value * 1000 + gpu * (value + 10) * 1000 + gpu * (value + 20) * 1000
      + gpu * (value + 30) * 1000 AS nvidia_gpu_power_usage_milliwatts_sum,
    gpu * value * 2e8 AS nvidia_gpu_memory_used_bytes_sum,
    gpu * (25 + value / 8) AS nvidia_gpu_temperature_celsius_min,
    (gpu * (25 + value / 8) + gpu * (26 + value / 8) + gpu * (27 + value / 8)
      + gpu * (28 + value / 8)) / 4 AS nvidia_gpu_temperature_celsius_mean,
    gpu * (28 + value / 8) AS nvidia_gpu_temperature_celsius_max,
    gpu * value * 1000 AS nvidia_gpu_power_usage_milliwatts_0,
    gpu * (value + 10) * 1000 AS nvidia_gpu_power_usage_milliwatts_1,
    gpu * (value + 20) * 1000 AS nvidia_gpu_power_usage_milliwatts_2,
    gpu * (value + 30) * 1000 AS nvidia_gpu_power_usage_milliwatts_3,
    gpu * (25 + value / 8) AS nvidia_gpu_temperature_celsius_0,
    gpu * (26 + value / 8) AS nvidia_gpu_temperature_celsius_1,
    gpu * (27 + value / 8) AS nvidia_gpu_temperature_celsius_2,
    gpu * (28 + value / 8) AS nvidia_gpu_temperature_celsius_3
  FROM nodes_of_events)"""

RAW = """
raw AS (
  SELECT * REPLACE (
      CASE WHEN prom_id % 13 <> 0 THEN node_power_usage END AS node_power_usage,
      CASE WHEN prom_id % 17 <> 0 THEN nvidia_gpu_power_usage_milliwatts_0 END
        AS nvidia_gpu_power_usage_milliwatts_0),
    CASE WHEN prom_id % 11 = 0 THEN NULL
         WHEN prom_id % 5 = 0 THEN '{"0": ' || (prom_id % 50)::VARCHAR || '}'
         ELSE '{"0": ' || (prom_id % 50)::VARCHAR || ', "1": ' || (prom_id % 70)::VARCHAR || '}'
    END AS power_json
  FROM samples)"""

JOBS = """
numbered_orders AS (
  SELECT *, (o_orderkey * 7919) % 60 AS hi,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey * 7919) % 40320)
      + to_days((CASE WHEN o_orderkey % 41 = 5 THEN -20 WHEN o_orderkey % 43 = 7
                 THEN 30 * (o_orderkey % 12) ELSE 0 END)::INT) AS submit_date,
    CASE WHEN o_orderkey % 29 = 3 THEN to_milliseconds(750)
         ELSE to_minutes(o_custkey % 180) END AS wait,
    CASE WHEN o_orderkey % 37 = 3 THEN to_seconds(10) WHEN o_orderkey % 47 = 9 THEN to_minutes(-30)
         ELSE to_minutes(1 + (o_custkey * 31 + o_orderkey) % 600) END AS run,
    CASE WHEN o_orderkey % 10 = 0 THEN 3 WHEN o_orderkey % 10 = 1 THEN 4 ELSE 1 END AS numnodes,
    CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 16 ELSE 8 END AS cores
  FROM orders),
jobs AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'None assigned' WHEN o_orderkey % 97 = 1 THEN 'software 1'
         WHEN o_orderkey % 10 = 0 THEN 'r' || (10 + hi // 6)::VARCHAR || 'n[1-2,4]'
         WHEN o_orderkey % 10 = 1 THEN 'r' || (10 + hi // 6)::VARCHAR || 'n[1,3-4],r16n2'
         ELSE 'r' || (10 + hi // 6)::VARCHAR || 'n' || (1 + hi % 6)::VARCHAR END AS node,
    submit_date,
    submit_date + wait AS start_date,
    submit_date + wait + run AS end_date,
    CASE WHEN o_orderkey % 31 = 2 THEN NULL WHEN o_orderkey % 12 IN (0, 1) THEN 'FAILED'
         WHEN o_orderkey % 12 = 2 THEN 'CANCELLED by ' || o_orderkey::VARCHAR
         WHEN o_orderkey % 12 = 3 THEN 'TIMEOUT'
         WHEN o_orderkey % 12 = 4 THEN 'OUT_OF_MEMORY'
         WHEN o_orderkey % 12 = 5 THEN 'NODE_FAIL'
         ELSE 'COMPLETED' END AS state,
    numnodes, numnodes * cores AS numcores
  FROM numbered_orders)"""

# Node lists taken apart with DuckDB's own string functions.
JOB_NODES = r"""
node_chunks AS (
  SELECT id, unnest(regexp_extract_all(node, '[^,\[]+(?:\[[^\]]*\])?')) AS chunk FROM jobs),
node_items AS (
  SELECT id, regexp_extract(chunk, '^([^\[]+)', 1) AS prefix,
    unnest(CASE WHEN contains(chunk, '[')
           THEN string_split(regexp_extract(chunk, '\[([^\]]*)\]', 1), ',')
           ELSE [''] END) AS item
  FROM node_chunks),
job_nodes AS (
  SELECT DISTINCT id, prefix || unnest(
    CASE WHEN regexp_matches(item, '^\d+-\d+$')
      THEN [x::VARCHAR FOR x IN range(split_part(item, '-', 1)::INT,
                                      split_part(item, '-', 2)::INT + 1)]
      ELSE [item] END) AS node
  FROM node_items),
marked AS (
  SELECT j.*, CASE WHEN starts_with(state, 'CANCELLED') THEN 'CANCELLED' ELSE state END AS status,
    (SELECT max(CASE WHEN substr(n.node, 1, 3) IN ('r16', 'r17', 'r18', 'r19') THEN 1 ELSE 0 END)
     FROM job_nodes n WHERE n.id = j.id) AS is_ml,
    date_diff('microsecond', submit_date, start_date) / 1e6 / 3600.0 AS wait_hours,
    date_diff('microsecond', start_date, end_date) / 1e6 / 3600.0
      + CASE WHEN end_date < start_date THEN 1 ELSE 0 END AS run_hours
  FROM jobs j)"""

JOINED = """
common AS (
  SELECT greatest((SELECT min(start_date) FROM jobs), (SELECT min("timestamp") FROM samples)) AS lo,
         least((SELECT max(end_date) FROM jobs), (SELECT max("timestamp") FROM samples)) AS hi),
js AS (
  SELECT s.*, j.id AS slurm_id, j.start_date, j.end_date, j.submit_date,
    CASE WHEN starts_with(j.state, 'CANCELLED') THEN 'CANCELLED' ELSE j.state END AS state,
    j.numnodes, j.numcores, date_diff('second', j.start_date, j.end_date) AS run_seconds
  FROM samples s
  JOIN job_nodes n ON n.node = s.node
  JOIN jobs j ON j.id = n.id AND s."timestamp" BETWEEN j.start_date AND j.end_date
  CROSS JOIN common c
  WHERE j.start_date >= c.lo AND j.end_date <= c.hi AND s."timestamp" BETWEEN c.lo AND c.hi)"""

HARDWARE = """
hardware AS (
  SELECT 'r' || (10 + ni // 6)::VARCHAR || 'n' || (1 + ni % 6)::VARCHAR AS node,
    'cpu-' || (ni % 3)::VARCHAR AS cpu_model,
    CASE WHEN ni >= 36 THEN 'gpu-' || (ni % 2)::VARCHAR END AS gpu_model,
    1 + ni % 2 AS cpu_count, 16 * (1 + ni % 2) AS cpu_core_count_total,
    125 * (1 + ni % 2) AS cpu_tdp_total,
    103079215104 * (1 + ni % 2) AS cpu_memory_bytes_total,
    2199023255552 AS node_filesystem_size_bytes_total,
    gpus AS gpu_count, 250 AS gpu_tdp_per_card, 250 * gpus AS gpu_tdp_total,
    25769803776 * gpus AS gpu_memory_bytes_total,
    80 AS cpu_t_case_max, 100 AS cpu_per_core_temp_max, 90 AS gpu_temp_max
  FROM (SELECT ni, CASE WHEN ni < 36 THEN 0 WHEN ni % 6 < 4 THEN 4 ELSE 2 END AS gpus
        FROM (SELECT (o_orderkey * 7919) % 60 AS ni FROM orders
              UNION SELECT 60 + o_orderkey % 6 FROM orders)))"""

PARTS = {
    "samples": SAMPLES,
    "raw": RAW,
    "jobs": JOBS,
    "job_nodes": JOB_NODES,
    "joined": JOINED,
    "hardware": HARDWARE,
}
NEEDS = {
    "samples": (),
    "raw": ("samples",),
    "jobs": (),
    "job_nodes": ("jobs",),
    "joined": ("samples", "jobs", "job_nodes"),
    "hardware": (),
}


def with_tables(names: str, body: str) -> str:
    """Prefix ``body`` with the definitions of the named tables.

    ``body`` is a SELECT, or further expressions followed by one after ``;;``.
    """
    chosen: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS[name]:
            add(needed)
        if name not in chosen:
            chosen.append(name)

    for name in names.split():
        add(name)
    expressions = [PARTS[n].strip() for n in chosen]
    if ";;" in body:
        more, body = body.split(";;")
        expressions.append(more.strip())
    return "WITH " + ",\n".join(expressions) + "\n" + body.strip()
