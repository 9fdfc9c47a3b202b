"""SQL side of the registered queries, for DuckDB over the raw parquet views.

Written from the definitions, not from the Spark code: plain theta joins, whole
windows, self joins and ``quantile_cont`` instead of the distributed forms.
"""

from __future__ import annotations

from checks.sql_tables import with_tables

ORACLE: dict[str, str] = {}
STATES = ("COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL")


def add(name: str, tables: str, body: str) -> None:
    ORACLE[name] = with_tables(tables, body)


def micros(col: str, name: str | None = None) -> str:
    return f'epoch_us("{col}") AS "{name or col}"'


# --- energy and classes -------------------------------------------------------

METRICS = """
counted AS (SELECT *, count(*) OVER (PARTITION BY node, "timestamp") AS concurrent FROM js),
on_node AS (
  SELECT slurm_id, node, avg(node_power_usage / concurrent) AS mean_power,
    max(run_seconds) AS rs, max(gpu_node) AS g, min(state) AS st
  FROM counted GROUP BY slurm_id, node),
of_job AS (
  SELECT slurm_id, sum(mean_power * rs) AS e, max(g) AS gpu_node, min(st) AS state, max(rs) AS rs
  FROM on_node GROUP BY slurm_id),
metrics AS (
  SELECT gpu_node, state, count(*) AS submissions, sum(rs)::BIGINT AS job_runtime_seconds,
    sum(e) AS node_energy
  FROM of_job GROUP BY gpu_node, state)"""

COMPARED = """,
compared AS (
  SELECT a.gpu_node, rack_count, node_count, job_submissions, job_runtime, job_energy, job_failures
  FROM (SELECT gpu_node, count(DISTINCT regexp_extract(node, '(r[0-9]+)n', 1)) AS rack_count,
          count(DISTINCT node) AS node_count, count(DISTINCT slurm_id) AS job_submissions
        FROM js GROUP BY gpu_node) a
  JOIN (SELECT gpu_node, sum(rs)::BIGINT AS job_runtime
        FROM (SELECT gpu_node, slurm_id, max(run_seconds) AS rs FROM js GROUP BY ALL)
        GROUP BY gpu_node) b USING (gpu_node)
  JOIN (SELECT gpu_node, sum(e) AS job_energy,
          count(CASE WHEN state = 'FAILED' THEN 1 END) AS job_failures
        FROM of_job GROUP BY gpu_node) c USING (gpu_node)),
shares AS (
  SELECT CASE WHEN gpu_node = 1 THEN 'ML' ELSE 'Generic' END AS type,
    rack_count / sum(rack_count) OVER () AS rack_count,
    node_count / sum(node_count) OVER () AS node_count,
    job_submissions / sum(job_submissions) OVER () AS job_submissions,
    job_failures / sum(job_failures) OVER () AS job_failures,
    job_runtime / sum(job_runtime) OVER () AS job_runtime,
    job_energy / sum(job_energy) OVER () AS job_energy
  FROM compared),
melted AS (
  SELECT type, variable, value FROM shares
  UNPIVOT (value FOR variable IN
    (rack_count, node_count, job_submissions, job_failures, job_runtime, job_energy)))"""

add("energy_by_class_state", "joined", METRICS + """;;
SELECT gpu_node, state, round(node_energy, 2) AS node_energy FROM metrics""")
ORACLE["energy_from_joined"] = ORACLE["energy_by_class_state"]
add("energy_share", "joined", METRICS + """;;
SELECT gpu_node, round(sum(e), 2) AS node_energy,
  round(100 * sum(e) / (SELECT sum(e) FROM of_job), 2) AS pct_energy
FROM of_job GROUP BY gpu_node""")
add("submissions_by_class_state", "joined", METRICS + """;;
SELECT gpu_node, state, submissions FROM metrics""")
add("runtime_by_class_state", "joined", METRICS + """;;
SELECT gpu_node, state, job_runtime_seconds FROM metrics""")
add("class_state_metrics", "joined", METRICS + """;;
SELECT gpu_node, state, submissions, job_runtime_seconds, round(node_energy, 2) AS node_energy
FROM metrics""")
ORACLE["named_tables"] = ORACLE["class_state_metrics"]
add("select_integers", "jobs", """
SELECT numnodes, count(*) AS n, sum(numcores)::BIGINT AS cores FROM jobs GROUP BY numnodes""")
add("class_comparison", "joined", METRICS + COMPARED + """;;
SELECT * REPLACE (round(job_energy, 2) AS job_energy) FROM compared""")
add("normalised_metrics", "joined", METRICS + """;;
SELECT gpu_node, state,
  round(submissions / sum(submissions) OVER (PARTITION BY gpu_node), 6) AS submissions,
  round(job_runtime_seconds / sum(job_runtime_seconds) OVER (PARTITION BY gpu_node), 6)
    AS job_runtime_seconds,
  round(node_energy / sum(node_energy) OVER (PARTITION BY gpu_node), 6) AS node_energy
FROM metrics""")
add("percent_table", "joined", METRICS + COMPARED + """;;
SELECT type, round(job_submissions * 100, 2)::VARCHAR || '%' AS job_submissions,
  round(job_runtime * 100, 2)::VARCHAR || '%' AS job_runtime,
  round(job_energy * 100, 2)::VARCHAR || '%' AS job_energy
FROM shares""")
add("metrics_melted", "joined", METRICS + COMPARED + """;;
SELECT type, variable, round(value, 6) AS value FROM melted""")
add("metrics_pivot", "joined", METRICS + COMPARED + """;;
SELECT variable,
  round(coalesce(avg(CASE WHEN type = 'Generic' THEN value END), 0), 6) AS "Generic",
  round(coalesce(avg(CASE WHEN type = 'ML' THEN value END), 0), 6) AS "ML"
FROM melted GROUP BY variable""")
add("stack_offsets", "joined", METRICS + COMPARED + """;;
SELECT type, variable, round(value, 6) AS value,
  round(CASE WHEN type = 'ML' THEN coalesce((SELECT g.value FROM melted g
    WHERE g.variable = m.variable AND g.type = 'Generic'), 0) ELSE 0 END, 6) AS left_edge
FROM melted m""")
add("state_matrix", "joined", METRICS + """,
long AS (
  SELECT gpu_node, state, 'submissions' AS metric,
    submissions / sum(submissions) OVER (PARTITION BY gpu_node) AS share FROM metrics
  UNION ALL SELECT gpu_node, state, 'job_runtime_seconds',
    job_runtime_seconds / sum(job_runtime_seconds) OVER (PARTITION BY gpu_node) FROM metrics
  UNION ALL SELECT gpu_node, state, 'node_energy',
    node_energy / sum(node_energy) OVER (PARTITION BY gpu_node) FROM metrics);;
SELECT gpu_node, metric, """ + ", ".join(
    f"round(coalesce(max(CASE WHEN state = '{s}' THEN share END), 0), 6) AS \"{s}\""
    for s in STATES) + """
FROM long GROUP BY gpu_node, metric""")

# --- integration --------------------------------------------------------------

add("interval_join_pairs", "joined", f"""
SELECT prom_id, node, {micros("timestamp")}, slurm_id, state, numnodes, numcores,
  {micros("start_date")}, {micros("end_date")}, round(node_power_usage, 6) AS node_power_usage,
  gpu_node, (SELECT count(*) FROM job_nodes n WHERE n.id = slurm_id) AS listed_nodes
FROM js""")
add("joined_written", "joined", f"""
SELECT prom_id, node, {micros("timestamp")}, slurm_id, state, {micros("submit_date")},
  {micros("end_date")}, round(node_load1, 6) AS node_load1,
  (SELECT count(*) FROM job_nodes n WHERE n.id = slurm_id) AS listed_nodes FROM js""")
ORACLE["loaded_every_fifth"] = """
SELECT event_id, user_id, event_type, round(value, 6) AS value
FROM (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i FROM events)
WHERE i % 5 = 0"""
FIFTH = """
fifth AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i FROM events)
  WHERE i % 5 = 0)"""
add("loaded_clean", "", FIFTH + """;;
SELECT event_id, user_id, epoch_us(ts) AS ts, event_type, round(value, 6) AS value FROM fifth
WHERE NOT (event_id IS NULL OR ts IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL OR props IS NULL)""")
add("loaded_profile", "", FIFTH + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, round(100.0 * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 6) AS null_percentage, "
    + (f"printf('%.6f', min({c}))" if c == "value" else f"min({c})::VARCHAR") + " AS example_value, "
    + ("round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std" if c == "value"
       else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std") + " FROM fifth"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + """);;
SELECT *, CASE WHEN mean > 0 THEN round(std / mean, 4) END AS coeff_var FROM p""")
add("literal_classes", "samples", """
names(gpu_node, type, card) AS (VALUES (0, 'Generic', NULL), (1, 'ML', 'gpu'), (2, 'Storage', NULL));;
SELECT type, card, (SELECT count(*) FROM samples s WHERE s.gpu_node = names.gpu_node) AS samples FROM names""")
add("concurrent_jobs", "joined", METRICS + """;;
SELECT prom_id, slurm_id, concurrent AS concurrent_job_count,
  round(node_power_usage / concurrent, 6) AS power_per_job FROM counted""")
add("state_counts_pivot", "joined", f"""
SELECT node, {micros("timestamp")}, """ + ", ".join(
    f"count(CASE WHEN state = '{s}' THEN 1 END) AS \"{s}\"" for s in STATES) + """,
  count(state) AS total_jobs_running
FROM js GROUP BY node, "timestamp" """)
add("date_coverage", "samples jobs", """
spans AS (
  SELECT 'jobs' AS source, min(start_date) AS lo, max(end_date) AS hi FROM jobs
  UNION ALL SELECT 'samples', min("timestamp"), max("timestamp") FROM samples),
three AS (SELECT * FROM spans UNION ALL SELECT 'intersection', max(lo), min(hi) FROM spans);;
SELECT source, epoch_us(lo) AS first_time, epoch_us(hi) AS last_time,
  date_sub('day', lo, hi) + 1 AS days FROM three""")
add("window_restrict", "joined", """
SELECT 'jobs' AS source, id FROM jobs, common WHERE start_date >= lo AND end_date <= hi
UNION ALL
SELECT 'samples', prom_id FROM samples, common WHERE "timestamp" BETWEEN lo AND hi""")
add("job_span_stats", "jobs", """
t AS (SELECT date_diff('second', start_date, end_date) AS s,
    start_date::DATE = end_date::DATE AS one, start_date::DATE < end_date::DATE AS many FROM jobs),
a AS (SELECT count(*) AS jobs,
    count(CASE WHEN s < 30 THEN 1 END) AS jobs_short, count(CASE WHEN one THEN 1 END) AS jobs_one_day,
    count(CASE WHEN many THEN 1 END) AS jobs_many_days,
    coalesce(sum(CASE WHEN s < 30 THEN s / 3600.0 END), 0) AS hours_short,
    coalesce(sum(CASE WHEN one THEN s / 3600.0 END), 0) AS hours_one_day,
    coalesce(sum(CASE WHEN many THEN s / 3600.0 END), 0) AS hours_many_days FROM t);;
SELECT jobs, jobs_short, jobs_one_day, jobs_many_days, round(hours_short, 4) AS hours_short,
  round(hours_one_day, 4) AS hours_one_day, round(hours_many_days, 4) AS hours_many_days,
  round(100.0 * jobs_short / jobs, 4) AS pct_jobs_short,
  round(100.0 * jobs_one_day / jobs, 4) AS pct_jobs_one_day,
  round(100.0 * jobs_many_days / jobs, 4) AS pct_jobs_many_days,
  round(100 * hours_short / (hours_short + hours_one_day + hours_many_days), 4) AS pct_hours_short,
  round(100 * hours_one_day / (hours_one_day + hours_many_days), 4) AS pct_hours_one_day,
  round(100 * hours_many_days / (hours_one_day + hours_many_days), 4) AS pct_hours_many_days
FROM a""")
add("explode_days", "jobs", """
SELECT id, strftime(unnest(range(start_date::DATE::TIMESTAMP,
    end_date::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS running_day
FROM jobs WHERE start_date <= end_date""")
add("top_node_lists", "job_nodes", """
longest AS (SELECT id, node FROM jobs ORDER BY length(node) DESC, id LIMIT 5);;
SELECT id, node, (SELECT string_agg(n.node, ',' ORDER BY n.node) FROM job_nodes n
                  WHERE n.id = longest.id) AS nodez FROM longest""")
add("overview", "joined", """
SELECT 'jobs' AS table_name, count(*) AS row_count, 8::BIGINT AS column_count,
  epoch_us(min(start_date)) AS first_time, epoch_us(max(end_date)) AS last_time FROM jobs
UNION ALL SELECT 'samples', count(*), 28, epoch_us(min("timestamp")), epoch_us(max("timestamp"))
FROM samples
UNION ALL SELECT 'job_samples', count(*), 28 + 8, epoch_us(min("timestamp")), epoch_us(max("timestamp"))
FROM js""")

# --- jobs ---------------------------------------------------------------------

add("jobs_enriched", "job_nodes", """
SELECT id, node, is_ml, status AS state, substr(node, 1, 3) AS rack,
  round(wait_hours, 6) AS job_waiting_time, round(run_hours, 6) AS job_running_time,
  round(numnodes * run_hours, 6) AS node_hours,
  (SELECT count(*) FROM job_nodes n WHERE n.id = marked.id) AS listed_nodes FROM marked""")
CALENDAR = """
dated AS (SELECT *, strftime(submit_date, '%Y-%m-%d') AS submit_day, month(submit_date) AS month_of_year,
    strftime(submit_date, '%U') AS week_of_year, dayofyear(submit_date) AS day_of_year,
    date_sub('hour', date_trunc('year', submit_date), submit_date) AS hour_of_year FROM {source})"""
add("calendar_columns", "jobs", CALENDAR.format(source="jobs") + """;;
SELECT id, submit_day, hour(submit_date) AS submit_hour_of_day,
  isodow(submit_date) - 1 AS submit_day_of_week, month_of_year, week_of_year, day_of_year,
  hour_of_year, date_sub('minute', date_trunc('year', submit_date), submit_date) AS minute_of_year,
  date_sub('second', date_trunc('year', submit_date), submit_date) AS second_of_year FROM dated""")
for name, column in (
    ("jobs_per_day", "submit_day"),
    ("jobs_per_month", "month_of_year"),
    ("jobs_per_week_u", "week_of_year"),
    ("jobs_per_doy", "day_of_year"),
    ("jobs_per_hour_of_year", "hour_of_year"),
):
    add(name, "job_nodes", CALENDAR.format(source="marked") + f""";;
SELECT is_ml, {column}::VARCHAR AS {column}, count(id) AS jobs FROM dated GROUP BY ALL""")
add("mean_jobs_per_day", "job_nodes", """
d AS (SELECT is_ml, submit_date::DATE AS day, count(*) AS n FROM marked GROUP BY ALL);;
SELECT is_ml, round(avg(n), 6) AS mean_jobs, count(*) AS periods FROM d GROUP BY is_ml""")
add("jobs_per_rack", "job_nodes", """
SELECT is_ml, substr(node, 1, 3) AS rack, count(*) AS jobs FROM marked
WHERE NOT (is_ml = 0 AND substr(node, 1, 3) IN ('Non', 'sof')) GROUP BY ALL""")
add("jobs_per_node_top5", "job_nodes", """
c AS (SELECT is_ml, node, count(*) AS jobs FROM marked
  WHERE node NOT IN ('None assigned', 'software 1', 'software 2')
  GROUP BY ALL HAVING count(*) >= 100),
r AS (SELECT *, row_number() OVER (PARTITION BY is_ml ORDER BY jobs DESC, node) AS place FROM c);;
SELECT * FROM r WHERE place <= 5""")
add("jobs_per_numnodes", "job_nodes", """
SELECT is_ml, numnodes, count(*) AS jobs FROM marked GROUP BY ALL""")
add("numnodes_counts", "job_nodes", """
SELECT is_ml, numnodes, count(*) AS jobs FROM marked GROUP BY ALL""")
add("failures_by_hour", "job_nodes", """
SELECT m.is_ml, h.hour, count(f.id) AS failed
FROM (SELECT unnest([0, 1]) AS is_ml) m CROSS JOIN (SELECT unnest(range(24)) AS hour) h
LEFT JOIN marked f ON f.is_ml = m.is_ml AND hour(f.submit_date) = h.hour AND f.status = 'FAILED'
GROUP BY ALL""")

# --- distributions ------------------------------------------------------------

POPULATIONS = """
sized AS (SELECT *, wait_hours AS job_waiting_time, run_hours AS job_running_time,
    numnodes * run_hours AS node_hours, CASE WHEN is_ml = 1 THEN 'ml' ELSE 'generic' END AS class
  FROM marked),
populated AS (
  SELECT 'all' AS population, * FROM sized
  UNION ALL SELECT class, * FROM sized
  UNION ALL SELECT lower(status), * FROM sized WHERE status IN ('COMPLETED', 'FAILED')
  UNION ALL SELECT class || ' ' || lower(status), * FROM sized
    WHERE status IN ('COMPLETED', 'FAILED'))"""


def described(source: str, columns: list[str], by: str, scale: str = "1", digits: int = 6) -> str:
    """One SELECT per column, over a scaled value."""
    parts = []
    for c in columns:
        v = f"({c}::DOUBLE * {scale})"
        stats = {
            "mean": f"avg({v})",
            "std": f"stddev_samp({v})",
            "min": f"min({v})",
            "p25": f"quantile_cont({v}, 0.25)",
            "p50": f"quantile_cont({v}, 0.5)",
            "p75": f"quantile_cont({v}, 0.75)",
            "max": f"max({v})",
        }
        rounded = ", ".join(f'round({e}, {digits}) AS "{n}"' for n, e in stats.items())
        key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
        parts.append(
            f"SELECT {key}'{c}' AS variable, count({c}) AS \"count\", {rounded} "
            f"FROM {source}{group}"
        )
    return "\nUNION ALL ".join(parts)


def describe(name, columns, scale="1", digits=6):
    add(name, "job_nodes",
        POPULATIONS + ";;" + described("populated", columns, "population", scale, digits))


describe("describe_wait_run", ["job_waiting_time", "job_running_time"])
describe("describe_wait_run_minutes", ["job_waiting_time", "job_running_time"], "60")
describe("describe_wait_run_seconds", ["job_waiting_time", "job_running_time"], "3600", 4)
describe("describe_size", ["numnodes", "numcores", "node_hours"])
describe("describe_node_minutes", ["node_hours"], "60")
add("quantiles_runtime", "job_nodes", POPULATIONS + """;;
SELECT population, 'job_running_time' AS variable,
  round(quantile_cont(run_hours, 0.7415), 6) AS p74_15,
  round(quantile_cont(run_hours, 0.8), 6) AS p80,
  round(quantile_cont(run_hours, 0.9072), 6) AS p90_72 FROM populated GROUP BY population""")
add("shares_wait_run", "job_nodes", POPULATIONS + """;;
SELECT population, round(avg((wait_hours <= 1)::INT), 6) AS wait_within_hour,
  round(avg((run_hours <= 1)::INT), 6) AS run_within_hour,
  round(avg((run_hours <= 6.0 / 60)::INT), 6) AS run_within_6_minutes
FROM populated GROUP BY population""")
add("shares_cores", "job_nodes", POPULATIONS + """;;
SELECT population, round(avg((numnodes = 1)::INT), 6) AS single_node,
  round(avg((numcores = 2)::INT), 6) AS cores_2, round(avg((numcores = 3)::INT), 6) AS cores_3,
  round(avg((numcores = 16)::INT), 6) AS cores_16 FROM populated GROUP BY population""")


def ecdf(name: str, column: str, by: str) -> None:
    where = "WHERE status IN ('COMPLETED', 'FAILED')" if "status" in by else ""
    keys = by.replace("status", "state")
    select = by.replace("status", "status AS state")
    add(name, "job_nodes", POPULATIONS + f""",
v AS (SELECT {select}, {column}::DOUBLE AS x FROM sized {where}),
c AS (SELECT {keys}, x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL);;
SELECT {keys}, round(x, 6) AS {column},
  round(n / sum(n) OVER (PARTITION BY {keys}), 6) AS pdf,
  round(sum(n) OVER (PARTITION BY {keys} ORDER BY x) / sum(n) OVER (PARTITION BY {keys}), 6) AS cdf
FROM c""")


for name, column in (
    ("ecdf_wait", "job_waiting_time"),
    ("ecdf_runtime", "job_running_time"),
    ("ecdf_cores", "numcores"),
    ("ecdf_numnodes", "numnodes"),
    ("ecdf_node_hours", "node_hours"),
):
    ecdf(name, column, "is_ml, status")
ecdf("ecdf_wait_by_class", "job_waiting_time", "is_ml")
ecdf("ecdf_runtime_by_class", "job_running_time", "is_ml")

add("box_jobs_per_period", "job_nodes", CALENDAR.format(source="marked") + """,
c AS (
  SELECT is_ml, 'month' AS period, month_of_year::VARCHAR AS slot, count(*) AS n FROM dated GROUP BY ALL
  UNION ALL SELECT is_ml, 'week', week_of_year, count(*) FROM dated GROUP BY ALL
  UNION ALL SELECT is_ml, 'day_of_year', day_of_year::VARCHAR, count(*) FROM dated GROUP BY ALL
  UNION ALL SELECT is_ml, 'hour', hour_of_year::VARCHAR, count(*) FROM dated GROUP BY ALL),
q AS (SELECT is_ml, period, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median,
    quantile_cont(n, 0.75) AS q3 FROM c GROUP BY ALL);;
SELECT q.is_ml, q.period, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(n)::DOUBLE AS whisker_low, max(n)::DOUBLE AS whisker_high
FROM q JOIN c ON c.is_ml = q.is_ml AND c.period = q.period
  AND n BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
GROUP BY ALL""")

# --- hardware -----------------------------------------------------------------

add("hardware_join", "samples hardware", """
SELECT prom_id, s.node, gpu_node, round(node_load1, 6) AS node_load1, cpu_model, gpu_model,
  cpu_count, cpu_memory_bytes_total, gpu_count
FROM samples s LEFT JOIN hardware h ON h.node = s.node""")
add("hardware_semi", "samples hardware", """
SELECT * FROM hardware WHERE node IN (SELECT node FROM samples)""")
FLAGGED = """
flagged AS (SELECT *, CASE WHEN substr(node, 1, 3) IN ('r16', 'r17', 'r18', 'r19') THEN 1 ELSE 0 END
    AS gpu_node FROM hardware WHERE node IN (SELECT node FROM samples)),
units AS (SELECT node, cpu_model, gpu_model, cpu_count, cpu_core_count_total, cpu_tdp_total,
    round_even(cpu_memory_bytes_total / 1073741824, 0) AS cpu_memory_giga_bytes_total,
    round_even(node_filesystem_size_bytes_total / 1073741824, 0) / 1024
      AS node_filesystem_size_tera_bytes_total,
    gpu_count, gpu_tdp_per_card, gpu_tdp_total,
    round_even(gpu_memory_bytes_total / 1073741824, 0) AS gpu_memory_giga_bytes_total,
    cpu_t_case_max, cpu_per_core_temp_max, gpu_temp_max, gpu_node FROM flagged),
by_rack AS (SELECT substr(node, 1, 3) AS rack, count(*) AS node_count_sum,
    sum(cpu_count)::BIGINT AS cpu_count_sum,
    sum(cpu_core_count_total)::BIGINT AS cpu_core_count_total_sum,
    sum(cpu_tdp_total)::BIGINT AS cpu_tdp_total_sum,
    round_even(sum(cpu_memory_bytes_total) / 1073741824, 0) AS cpu_memory_giga_bytes_total_sum,
    round_even(sum(node_filesystem_size_bytes_total) / 1073741824, 0) / 1024
      AS node_filesystem_size_tera_bytes_total_sum,
    sum(gpu_count)::BIGINT AS gpu_count_sum, sum(gpu_tdp_total)::BIGINT AS gpu_tdp_total_sum,
    round_even(sum(gpu_memory_bytes_total) / 1073741824, 0) AS gpu_memory_giga_bytes_total_sum,
    quantile_disc(gpu_node, 0.5) AS gpu_rack
  FROM flagged GROUP BY rack)"""
UNIT_NUMBERS = [
    "cpu_count", "cpu_core_count_total", "cpu_tdp_total", "cpu_memory_giga_bytes_total",
    "node_filesystem_size_tera_bytes_total", "gpu_count", "gpu_tdp_per_card", "gpu_tdp_total",
    "gpu_memory_giga_bytes_total", "cpu_t_case_max", "cpu_per_core_temp_max", "gpu_temp_max",
]
RACK_NUMBERS = [
    "node_count_sum", "cpu_count_sum", "cpu_core_count_total_sum", "cpu_tdp_total_sum",
    "cpu_memory_giga_bytes_total_sum", "node_filesystem_size_tera_bytes_total_sum",
    "gpu_count_sum", "gpu_tdp_total_sum", "gpu_memory_giga_bytes_total_sum",
]


def modes(source: str, columns: list[str], by: str) -> str:
    parts = [
        f"SELECT {by}, '{c}' AS variable, {c}::VARCHAR AS value, count(*) AS n "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL"
        for c in columns
    ]
    return f""",
counts AS ({" UNION ALL ".join(parts)}),
places AS (SELECT *, rank() OVER (PARTITION BY {by}, variable ORDER BY n DESC) AS place FROM counts);;
SELECT {by}, variable, value, n FROM places WHERE place = 1"""


add("hardware_units", "samples hardware", FLAGGED + ";; SELECT * FROM units")
add("hardware_describe", "samples hardware",
    FLAGGED + ";;" + described("units", UNIT_NUMBERS, "gpu_node", digits=4))
add("hardware_modes", "samples hardware",
    FLAGGED + modes("units", ["cpu_model", "gpu_model", *UNIT_NUMBERS], "gpu_node"))
add("hardware_totals", "samples hardware", FLAGGED + ";;" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(sum({c})::DOUBLE, 6) AS total FROM units"
    for c in [*UNIT_NUMBERS, "gpu_node"]))
add("rack_hardware", "samples hardware", FLAGGED + ";; SELECT * FROM by_rack")
add("rack_describe", "samples hardware",
    FLAGGED + ";;" + described("by_rack", RACK_NUMBERS, "gpu_rack", digits=4))
add("rack_modes", "samples hardware", FLAGGED + modes("by_rack", RACK_NUMBERS, "gpu_rack"))

RAW_RATIOS = """
wide AS (SELECT s.*, h.* EXCLUDE (node) FROM samples s LEFT JOIN hardware h ON h.node = s.node),
ratios AS (SELECT prom_id, gpu_node,
    node_load1 / nullif(cpu_core_count_total, 0) AS node_load_1_ratio,
    node_rapl_package_power_sum / nullif(cpu_tdp_total, 0) AS cpu_power_sum_ratio,
    node_memory_Active_bytes / nullif(cpu_memory_bytes_total, 0) AS cpu_mem_ratio,
""" + "".join(
    f"    ({metric}_{stat} - node_ambient_temp) / nullif({limit} - node_ambient_temp, 0)"
    f" AS {name}_{stat}_ratio,\n"
    for name, metric, limit in (
        ("cpu_temp", "node_thermal_zone_temp", "cpu_t_case_max"),
        ("cpu_core_temp", "node_hwmon_temp_celsius", "cpu_per_core_temp_max"),
        ("gpu_temp", "nvidia_gpu_temperature_celsius", "gpu_temp_max"),
    )
    for stat in ("mean", "min", "max")
) + """    nvidia_gpu_power_usage_milliwatts_sum / 1000 / nullif(gpu_tdp_total, 0) AS gpu_power_sum_ratio,
    nvidia_gpu_memory_used_bytes_sum / nullif(gpu_memory_bytes_total, 0) AS gpu_mem_sum_ratio
  FROM wide)"""
ALL_RATIOS = [
    "node_load_1_ratio", "cpu_power_sum_ratio", "cpu_mem_ratio",
    "cpu_temp_mean_ratio", "cpu_temp_min_ratio", "cpu_temp_max_ratio",
    "cpu_core_temp_mean_ratio", "cpu_core_temp_min_ratio", "cpu_core_temp_max_ratio",
    "gpu_power_sum_ratio", "gpu_mem_sum_ratio",
    "gpu_temp_mean_ratio", "gpu_temp_min_ratio", "gpu_temp_max_ratio",
]
MAIN_RATIOS = [
    "node_load_1_ratio", "cpu_power_sum_ratio", "cpu_mem_ratio", "cpu_temp_max_ratio",
    "cpu_core_temp_max_ratio", "gpu_power_sum_ratio", "gpu_mem_sum_ratio", "gpu_temp_max_ratio",
]


def _clipped(c: str) -> str:
    low = f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END"
    if "gpu" in c:
        return f"CASE WHEN gpu_node = 0 THEN 0.0 ELSE {low} END AS {c}"
    if c == "node_load_1_ratio":
        return f"CASE WHEN {c} > 1 THEN 1 ELSE {low} END AS {c}"
    return f"{low} AS {c}"


CLIPPED = RAW_RATIOS + """,
clipped AS (SELECT prom_id, gpu_node, """ + ", ".join(_clipped(c) for c in ALL_RATIOS) + """
  FROM ratios)"""
PERCENT = CLIPPED + """,
caps AS (SELECT gpu_node, """ + ", ".join(
    f"quantile_cont({c} * 100, 0.9999) AS cap_{c}" for c in MAIN_RATIOS) + """
  FROM clipped GROUP BY gpu_node),
percent AS (SELECT prom_id, k.gpu_node, """ + ", ".join(
    f"CASE WHEN {c} * 100 > cap_{c} THEN cap_{c} ELSE {c} * 100 END AS {c}"
    for c in MAIN_RATIOS) + """
  FROM clipped k JOIN caps USING (gpu_node))"""
WHOLE_PERCENT = PERCENT + """,
long AS (
""" + " UNION ALL ".join(
    f"SELECT gpu_node, '{c}' AS variable, round_even({c}, 0) AS x FROM percent WHERE {c} IS NOT NULL"
    for c in MAIN_RATIOS) + ")"
FENCES = WHOLE_PERCENT + """,
fences AS (SELECT gpu_node, variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
    quantile_cont(x, 0.75) AS q3 FROM long GROUP BY ALL),
placed AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM long JOIN fences USING (gpu_node, variable))"""


def listed(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


add("utilisation_ratios", "samples hardware",
    RAW_RATIOS + f";; SELECT prom_id, gpu_node, {listed(ALL_RATIOS)} FROM ratios")
add("ratios_clipped", "samples hardware",
    CLIPPED + f";; SELECT prom_id, gpu_node, {listed(ALL_RATIOS)} FROM clipped")
add("ratios_winsorized", "samples hardware",
    PERCENT + f";; SELECT prom_id, gpu_node, {listed(MAIN_RATIOS)} FROM percent")
add("ratio_describe", "samples hardware",
    PERCENT + ";;" + described("percent", MAIN_RATIOS, "gpu_node"))
add("ratio_describe_all", "samples hardware", PERCENT + """,
whole AS (SELECT """ + ", ".join(f"round_even({c}, 0) AS {c}" for c in MAIN_RATIOS) + """
  FROM percent);;""" + described("whole", MAIN_RATIOS, ""))
add("ratio_histogram", "samples hardware", WHOLE_PERCENT + """,
b AS (SELECT gpu_node, variable, least(floor(x / 5), 21)::BIGINT * 5 AS bin_left, count(*) AS n
  FROM long WHERE x BETWEEN 0 AND 110 GROUP BY ALL);;
SELECT gpu_node, variable, bin_left, n,
  round(n / (sum(n) OVER (PARTITION BY gpu_node, variable) * 5), 6) AS density FROM b""")
add("ratio_box", "samples hardware", FENCES + """;;
SELECT gpu_node, variable, round(max(q1), 6) AS q1, round(max(median), 6) AS median,
  round(max(q3), 6) AS q3, min(CASE WHEN inside THEN x END) AS whisker_low,
  max(CASE WHEN inside THEN x END) AS whisker_high,
  count(CASE WHEN NOT inside THEN 1 END) AS outlier_rows,
  count(DISTINCT CASE WHEN NOT inside THEN x END) AS outlier_values
FROM placed GROUP BY gpu_node, variable""")
add("ratio_box_outliers", "samples hardware", FENCES + """;;
SELECT gpu_node, variable, x AS value, count(*) AS n FROM placed WHERE NOT inside GROUP BY ALL""")
add("hot_share", "samples hardware", PERCENT + """;;
SELECT gpu_node, round(100.0 * count(CASE WHEN gpu_temp_max_ratio > 90 THEN 1 END)
  / nullif(count(gpu_temp_max_ratio), 0), 6) AS hot_pct FROM percent GROUP BY gpu_node""")

# --- GPU cards ----------------------------------------------------------------

CARDS = """
cards AS (SELECT prom_id, s.node, gpu_count, """ + ", ".join(
    f"nvidia_gpu_power_usage_milliwatts_{i} / 1000 / nullif(gpu_tdp_per_card, 0) AS power_{i}, "
    f"(nvidia_gpu_temperature_celsius_{i} - node_ambient_temp) / "
    f"nullif(gpu_temp_max - node_ambient_temp, 0) AS temp_{i}" for i in range(4)) + """
  FROM samples s JOIN hardware h ON h.node = s.node WHERE gpu_node = 1 AND gpu_count >= 4)"""


def bins(level: str) -> str:
    busy = " AND ".join(f"power_{i} >= {level}" for i in range(4))
    slots = " UNION ALL ".join(
        f"SELECT {i} AS slot, power_{i} * 100 AS p, temp_{i} * 100 AS t FROM cards WHERE {busy}"
        for i in range(4)
    )
    return CARDS + f""",
readings AS ({slots}),
means AS (SELECT slot, ceil(p)::INT AS power_bin, avg(t) AS mean_temp, count(*) AS samples
  FROM readings WHERE p > 0 AND p <= 170 GROUP BY ALL),
binned AS (SELECT g.slot, b.power_bin, mean_temp, coalesce(samples, 0) AS samples
  FROM (SELECT unnest(range(4)) AS slot) g
  CROSS JOIN (SELECT unnest(range(1, 171)) AS power_bin) b
  LEFT JOIN means m ON m.slot = g.slot AND m.power_bin = b.power_bin)"""


add("gpu_slot_ratios", "samples hardware", CARDS + ";; SELECT prom_id, node, gpu_count, " + listed(
    [f"{k}_{i}" for i in range(4) for k in ("power", "temp")]) + " FROM cards")
add("gpu_slot_stats", "samples hardware", CARDS + ";; SELECT gpu_count, " + ", ".join(
    f"round(avg(power_{i}), 6) AS power_{i}_mean, round(stddev_samp(power_{i}), 6) AS power_{i}_std"
    for i in range(4)) + " FROM cards GROUP BY gpu_count")
ORACLE["named_cards"] = ORACLE["gpu_slot_stats"]
add("gpu_nodes_count", "samples hardware", CARDS + """;;
SELECT gpu_count, count(DISTINCT node) AS n_node FROM cards
WHERE power_0 >= 0 AND power_1 >= 0 AND power_2 >= 0 AND power_3 >= 0 GROUP BY gpu_count""")
for name, level in (("gpu_power_temp_bins", "0.0"), ("gpu_power_temp_bins_95", "0.95")):
    add(name, "samples hardware", bins(level) + """;;
SELECT slot, power_bin, round(mean_temp, 6) AS mean_temp, samples FROM binned""")
add("gpu_temp_at_100", "samples hardware", bins("0.0") + """,
level AS (SELECT * FROM binned WHERE power_bin = 100 AND mean_temp IS NOT NULL);;
SELECT (SELECT slot FROM level ORDER BY mean_temp, slot LIMIT 1) AS coolest_slot,
  (SELECT round(min(mean_temp), 6) FROM level) AS coolest_temp,
  (SELECT slot FROM level ORDER BY mean_temp DESC, slot LIMIT 1) AS hottest_slot,
  (SELECT round(max(mean_temp), 6) FROM level) AS hottest_temp""")

# --- peers --------------------------------------------------------------------

HIGH_LOAD = """
counted AS (SELECT *, count(*) OVER (PARTITION BY node, "timestamp") AS concurrent,
    avg(node_power_usage) OVER (PARTITION BY gpu_node, node) AS usual,
    stddev_samp(node_power_usage) OVER (PARTITION BY gpu_node, node) AS spread FROM js),
high AS (SELECT * FROM counted WHERE node_power_usage > usual + spread AND concurrent > 1),
busy AS (SELECT slurm_id, gpu_node, node, "timestamp", min(state) AS state
  FROM high GROUP BY ALL),
pairs AS (SELECT a.*, b.slurm_id AS slurm_id_2, b.state AS state_2
  FROM busy a JOIN busy b ON a.gpu_node = b.gpu_node AND a.node = b.node
    AND a."timestamp" = b."timestamp" AND a.slurm_id <> b.slurm_id)"""
PEERS = HIGH_LOAD + """,
peers AS (SELECT slurm_id, gpu_node, node, "timestamp", """ + ", ".join(
    f"max(CASE WHEN state = '{s}' THEN 1 ELSE 0 END) AS \"{s}\", "
    f"count(CASE WHEN state_2 = '{s}' THEN 1 END) AS \"{s}_other_jobs\"" for s in STATES) + """
  FROM pairs GROUP BY slurm_id, gpu_node, node, "timestamp")"""
# All coefficients in one pass over the peers, then one row for each pair of states.
CORR = PEERS.replace("peers AS (", "peers AS MATERIALIZED (") + """,
wide AS (SELECT gpu_node, """ + ", ".join(
    f'covar_pop("{a}", "{b}_other_jobs") / '
    f'nullif(stddev_pop("{a}") * stddev_pop("{b}_other_jobs"), 0) AS "{a}|{b}"'
    for a in STATES for b in STATES) + """
  FROM peers GROUP BY gpu_node),
matrix AS (""" + " UNION ALL ".join(
    f"SELECT gpu_node, '{a}' AS state, '{b}' AS state_2, \"{a}|{b}\" AS corr FROM wide"
    for a in STATES for b in STATES) + ")"

add("high_load_rows", "joined", HIGH_LOAD + """;;
SELECT prom_id, slurm_id, node, gpu_node, round(node_power_usage, 6) AS node_power_usage,
  concurrent AS concurrent_job_count, round(usual, 6) AS node_power_usage_mean,
  round(spread, 6) AS node_power_usage_std FROM high""")
add("peer_pairs", "joined", HIGH_LOAD + """;;
SELECT gpu_node, state, state_2, count(*) AS pairs FROM pairs
WHERE state IS NOT NULL AND state_2 IS NOT NULL GROUP BY ALL""")
add("peer_state_counts", "joined", PEERS + """;;
SELECT * REPLACE (epoch_us("timestamp") AS "timestamp") FROM peers""")
add("peer_state_corr", "joined", CORR + """;;
SELECT gpu_node, state, state_2, round(corr, 6) AS corr FROM matrix""")
ordering = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATES))
add("peer_state_corr_triangle", "joined", CORR + f""";;
SELECT gpu_node, state, state_2, round(corr, 6) AS corr FROM matrix
WHERE CASE state {ordering} END >= CASE state_2 {ordering} END""")
# One read of the matrix: each side of the difference is the one row of its class.
add("peer_state_corr_diff", "joined", CORR + """;;
SELECT state, state_2, round(max(CASE WHEN gpu_node = 0 THEN corr END)
  - max(CASE WHEN gpu_node = 1 THEN corr END), 6) AS corr_diff
FROM matrix GROUP BY state, state_2""")

# --- data quality -------------------------------------------------------------

WIDE = [
    "node_ambient_temp", "node_power_usage", "node_load1", "node_rapl_package_power_sum",
    "node_memory_Active_bytes",
    *[f"node_{m}_{s}" for m in ("thermal_zone_temp", "hwmon_temp_celsius") for s in ("min", "mean", "max")],
    "nvidia_gpu_power_usage_milliwatts_sum", "nvidia_gpu_memory_used_bytes_sum",
    *[f"nvidia_gpu_temperature_celsius_{s}" for s in ("min", "mean", "max")],
    *[f"nvidia_gpu_power_usage_milliwatts_{i}" for i in range(4)],
    *[f"nvidia_gpu_temperature_celsius_{i}" for i in range(4)],
    "constant",
]
RAW_COLUMNS = ["prom_id", "node", "timestamp", "gpu_node", *WIDE[:-1], "power_json"]


def pct_null(c: str) -> str:
    return f'100.0 * count(CASE WHEN "{c}" IS NULL THEN 1 END) / count(*)'


add("null_pct", "raw", "SELECT " + ", ".join(
    f'round({pct_null(c)}, 6) AS "{c}"' for c in RAW_COLUMNS) + " FROM raw")
add("null_pct_by_node", "raw", "p AS (SELECT node AS k, " + ", ".join(
    f'{pct_null(c)} AS "{c}%null"' for c in RAW_COLUMNS) + " FROM raw GROUP BY node);; SELECT k AS node, "
    + ", ".join(f'round("{c}%null", 6) AS "{c}%null"' for c in RAW_COLUMNS)
    + ", round((" + " + ".join(f'"{c}%null"' for c in RAW_COLUMNS) + f") / {len(RAW_COLUMNS)}, 3)"
    + ' AS "cols_mean%null" FROM p')


def profiled(c: str, kind: str) -> str:
    numbers = (
        f'round(avg("{c}"), 2) AS mean, round(stddev_samp("{c}"), 2) AS std'
        if kind == "double"
        else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
    )
    example = f"printf('%.6f', min(\"{c}\"))" if kind == "double" else f'min("{c}")::VARCHAR'
    return (
        f"SELECT '{c}' AS name, '{kind}' AS \"dataType\", round({pct_null(c)}, 6) AS null_percentage, "
        f"{example} AS example_value, {numbers} FROM raw"
    )


KINDS = {"prom_id": "bigint", "node": "string", "timestamp": "timestamp_ntz", "gpu_node": "int", "power_json": "string"}
add("profile", "raw", "p AS (" + " UNION ALL ".join(
    profiled(c, KINDS.get(c, "double")) for c in RAW_COLUMNS) + """);;
SELECT *, CASE WHEN mean > 0 THEN round(std / mean, 4) END AS coeff_var FROM p""")
add("null_mask", "raw", "SELECT prom_id, " + ", ".join(
    f'("{c}" IS NULL)::INT AS "{c}"' for c in RAW_COLUMNS if c != "prom_id") + " FROM raw")
add("null_mask_by_hour", "raw", """
SELECT node, strftime("timestamp", '%Y-%m-%d %H') AS hour, count(*) AS rows, """ + ", ".join(
    f'count(CASE WHEN "{c}" IS NULL THEN 1 END) AS "null_{c}"'
    for c in RAW_COLUMNS if c not in ("node", "timestamp")) + """
FROM raw GROUP BY ALL""")
COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in RAW_COLUMNS)
add("complete_rows", "raw", f"""
SELECT count(*) AS rows, count(CASE WHEN {COMPLETE} THEN 1 END) AS complete_rows FROM raw""")
FILLED = """
filled AS (SELECT * REPLACE (coalesce(nvidia_gpu_power_usage_milliwatts_0, 0)
    AS nvidia_gpu_power_usage_milliwatts_0) FROM raw),
kept AS (SELECT * FROM filled WHERE node_power_usage IS NOT NULL AND power_json IS NOT NULL)"""
NUMBERS = ", ".join(f'round("{c}", 6) AS "{c}"' for c in WIDE[:-1]) + ", " + micros("timestamp")
add("fill_drop", "raw", FILLED + f""";;
SELECT prom_id, node, gpu_node, power_json, {NUMBERS} FROM kept""")
add("fill_drop_all", "raw", f"""
all_filled AS (SELECT * REPLACE (coalesce(node_power_usage, 0) AS node_power_usage,
    coalesce(nvidia_gpu_power_usage_milliwatts_0, 0) AS nvidia_gpu_power_usage_milliwatts_0)
    REPLACE_JSON FROM raw);;
SELECT prom_id, node, gpu_node, power_json, {NUMBERS} FROM all_filled""".replace(
    ")\n    REPLACE_JSON", ",\n    coalesce(power_json, '{}') AS power_json)"))
add("dropped_pct", "raw", FILLED + """,
c AS (SELECT (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM kept) AS rows_after);;
SELECT rows_before, rows_after, round(100.0 * (rows_before - rows_after) / rows_before, 2)
  AS dropped_pct FROM c""")
ORACLE["dropped_pct_observed"] = ORACLE["dropped_pct"]
add("null_neighbours", "raw", """
w AS (SELECT prom_id, node, node_power_usage, node_power_usage IS NULL AS h,
    lag(node_power_usage IS NULL, 1, false) OVER o AS before,
    lead(node_power_usage IS NULL, 1, false) OVER o AS after
  FROM raw WINDOW o AS (PARTITION BY node ORDER BY "timestamp", prom_id));;
SELECT prom_id, node, round(node_power_usage, 6) AS node_power_usage, h::INT AS has_null
FROM w WHERE h OR before OR after""")


def interpolated(c: str) -> str:
    """Correlated look-up of the nearest known neighbours, by position."""
    near = f"{c}_p.y + (n.i - {c}_p.i) * ({c}_n.y - {c}_p.y) / ({c}_n.i - {c}_p.i)"
    return (
        f"round(CASE WHEN n.{c} IS NOT NULL THEN n.{c} "
        f"ELSE coalesce({near}, {c}_n.y, {c}_p.y, 1.0) + 0.5 END, 6) AS {c}"
    )


GAPPY = ["node_power_usage", "nvidia_gpu_power_usage_milliwatts_0"]
add("interpolate", "raw", """
n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY "timestamp", prom_id) - 1 AS i FROM raw),
""" + ",\n".join(
    f"{c}_k AS (SELECT node, i, {c} AS y FROM n WHERE {c} IS NOT NULL)" for c in GAPPY) + """;;
SELECT n.prom_id, n.node, n.i AS node_index, """ + ", ".join(interpolated(c) for c in GAPPY) + """
FROM n """ + " ".join(
    f"ASOF LEFT JOIN {c}_k {c}_p ON n.node = {c}_p.node AND n.i >= {c}_p.i "
    f"ASOF LEFT JOIN {c}_k {c}_n ON n.node = {c}_n.node AND n.i <= {c}_n.i" for c in GAPPY))
add("every_nth", "raw", """
n AS (SELECT prom_id, node, row_number() OVER (ORDER BY "timestamp", prom_id) - 1 AS i FROM raw);;
SELECT prom_id, node FROM n WHERE i % 7 = 0""")
add("json_keys", "raw", """
SELECT DISTINCT unnest(json_keys(power_json)) AS key FROM raw WHERE power_json IS NOT NULL""")
add("json_widen", "raw", """
SELECT prom_id, (power_json->>'0')::DOUBLE AS "power_json-0",
  (power_json->>'1')::DOUBLE AS "power_json-1" FROM raw""")
add("json_long", "raw", """
keys AS (SELECT prom_id, power_json, unnest(json_keys(power_json)) AS key FROM raw);;
SELECT prom_id, key, TRY_CAST(json_extract_string(power_json, '$."' || key || '"') AS DOUBLE) AS value FROM keys""")
add("json_long_props", "", """
keys AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events);;
SELECT event_id, key, TRY_CAST(json_extract_string(props, '$."' || key || '"') AS DOUBLE) AS value FROM keys""")
add("json_keys_props", "", """
keys AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events);;
SELECT key FROM keys""")
add("json_leaves", "", """
t AS (SELECT event_id, unnest([
    {'path': '$.user.id', 'value': user_id::VARCHAR, 'kind': NULL},
    {'path': '$.user.tags[0]', 'value': event_type, 'kind': 'text'},
    {'path': '$.user.tags[1]', 'value': (event_id % 7)::VARCHAR, 'kind': NULL},
    {'path': '$.user.tags[2]', 'value': NULL, 'kind': NULL},
    {'path': '$.user.tags[3][0]', 'value': 'true', 'kind': NULL}], recursive := true) FROM events),
p AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events);;
SELECT event_id, path, value, kind FROM t UNION ALL
SELECT event_id, '$.props.' || key, json_extract_string(props, '$."' || key || '"'), NULL FROM p""")
add("json_aggregate", "raw", """
w AS (SELECT prom_id, (power_json->>'0')::DOUBLE AS a, (power_json->>'1')::DOUBLE AS b FROM raw);;
SELECT prom_id, round(least(a, b), 2) AS "power_json-min", round(greatest(a, b), 2) AS "power_json-max",
  round(coalesce(a, 0) + coalesce(b, 0), 2) AS "power_json-sum",
  round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 2)
    AS "power_json-mean" FROM w""")
DOUBLES = ["node_ambient_temp", "node_power_usage", "nvidia_gpu_power_usage_milliwatts_0"]


def matrix(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(covar_pop({x}, {y}) / "
        f"nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) AS corr FROM {source}"
        for x in DOUBLES for y in DOUBLES)


KNOWN = "known AS (SELECT * FROM raw WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in DOUBLES) + ")"
add("corr_pearson", "raw", KNOWN + ";;" + matrix("known"))
add("corr_wide", "samples", """
filled AS (SELECT *, 1.0::DOUBLE AS constant FROM samples),
sums AS (SELECT """ + ", ".join(
    f'covar_pop("{x}", "{y}") / nullif(stddev_pop("{x}") * stddev_pop("{y}"), 0) AS "{i}|{j}"'
    for i, x in enumerate(WIDE) for j, y in enumerate(WIDE) if i <= j) + """ FROM filled);;
""" + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(\"{min(i, j)}|{max(i, j)}\", 6) AS corr FROM sums"
    for i, x in enumerate(WIDE) for j, y in enumerate(WIDE)))
add("corr_spearman", "raw", KNOWN + ", ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    for c in DOUBLES) + " FROM known);;" + matrix("ranked"))
add("corr_spearman_wide", "samples", "ranked AS (SELECT " + ", ".join(
    f'rank() OVER (ORDER BY "{c}") + (count(*) OVER (PARTITION BY "{c}") - 1) / 2.0 AS "{c}"'
    for c in WIDE[:-1]) + """ FROM samples),
sums AS (SELECT """ + ", ".join(
    f'covar_pop("{x}", "{y}") / nullif(stddev_pop("{x}") * stddev_pop("{y}"), 0) AS "{i}|{j}"'
    for i, x in enumerate(WIDE[:-1]) for j, y in enumerate(WIDE[:-1]) if i <= j) + """ FROM ranked);;
""" + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(\"{min(i, j)}|{max(i, j)}\", 6) AS corr FROM sums"
    for i, x in enumerate(WIDE[:-1]) for j, y in enumerate(WIDE[:-1])))
add("distinct_states", "joined", "SELECT DISTINCT state FROM js")
add("node_expand", "job_nodes", "SELECT id, node AS node_name FROM job_nodes")
add("node_expand_simple", "jobs", r"""
racks AS (SELECT id, unnest(string_split(node, ',r')) AS rack FROM jobs),
parts AS (SELECT id, regexp_extract(rack, '([0-9]+)n', 1) AS number,
    unnest(string_split(regexp_extract(rack, 'n\[?([0-9,]+)', 1), ',')) AS item FROM racks);;
SELECT id, 'r' || number || 'n' || item AS node_name FROM parts""")
add("gpu_flag", "job_nodes", """
SELECT id, is_ml AS gpu_node, (SELECT count(*) FROM job_nodes n WHERE n.id = marked.id
    AND substr(n.node, 1, 3) IN ('r16', 'r17', 'r18', 'r19')) AS gpu_nodes_listed,
  regexp_extract(node, '(r[0-9]+)n', 1) AS rack, length(node) AS node_length FROM marked""")
