"""Telemetry tables derived from a generic star schema with an event stream.

Maps events to node samples, orders to batch jobs, and the nodes that the jobs
name to node hardware, so that every analysis can run on those tables.  All
derivations are deterministic integer arithmetic or exact constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SLOTS = (0, 1, 2, 3)
GPU_RACKS = (16, 17, 18, 19)
GPU_NODES = tuple(f"r{rack}n{n}" for rack in GPU_RACKS for n in range(1, 7))


# SQL text of the node name for a node index 0..59.
NODE_NAME = "concat('r', 10 + {0} DIV 6, 'n', 1 + {0} % 6)"


def samples(spark: SparkSession, base: str) -> DataFrame:
    """Node samples: one row per event, 60 nodes in 10 racks, r16-r19 with GPUs."""
    power = [f"gpu_node * (value + {10 * i}) * 1000" for i in SLOTS]
    heat = [f"gpu_node * ({25 + i} + value / 8)" for i in SLOTS]
    events = spark.read.parquet(f"{base}/events.parquet").selectExpr(
        "event_id",
        "ts",
        "value",
        "(user_id * 7) % 60 AS ni",
        "CASE WHEN (user_id * 7) % 60 >= 36 THEN 1 ELSE 0 END AS gpu_node",
    )
    return events.selectExpr(
        "event_id AS prom_id",
        f"{NODE_NAME.format('ni')} AS node",
        "ts AS timestamp",
        "gpu_node",
        "double(20 + event_id % 8) AS node_ambient_temp",
        "80 + value AS node_power_usage",
        "value / 4 AS node_load1",
        "40 + value / 2 AS node_rapl_package_power_sum",
        "value * 5e8D AS node_memory_Active_bytes",
        *[
            f"{floor} + value / {share} AS {metric}_{stat}"
            for metric, floor in (("node_thermal_zone_temp", 30), ("node_hwmon_temp_celsius", 28))
            for stat, share in (("min", 10), ("mean", 9), ("max", 8))
        ],
        f"{' + '.join(power)} AS nvidia_gpu_power_usage_milliwatts_sum",
        "gpu_node * value * 2e8D AS nvidia_gpu_memory_used_bytes_sum",
        f"{heat[0]} AS nvidia_gpu_temperature_celsius_min",
        f"({' + '.join(heat)}) / 4 AS nvidia_gpu_temperature_celsius_mean",
        f"{heat[-1]} AS nvidia_gpu_temperature_celsius_max",
        *[f"{power[i]} AS nvidia_gpu_power_usage_milliwatts_{i}" for i in SLOTS],
        *[f"{heat[i]} AS nvidia_gpu_temperature_celsius_{i}" for i in SLOTS],
    )


def raw_samples(spark: SparkSession, base: str) -> DataFrame:
    """Samples before cleaning: gaps in two columns and a JSON map per row."""
    whole = samples(spark, base)
    gaps = {"node_power_usage": 13, "nvidia_gpu_power_usage_milliwatts_0": 17}
    return whole.selectExpr(
        *[f"CASE WHEN prom_id % {gaps[c]} <> 0 THEN {c} END AS {c}" if c in gaps else c for c in whole.columns],
        """CASE WHEN prom_id % 11 = 0 THEN NULL
                WHEN prom_id % 5 = 0 THEN concat('{"0": ', prom_id % 50, '}')
                ELSE concat('{"0": ', prom_id % 50, ', "1": ', prom_id % 70, '}')
           END AS power_json""",
    )


def jobs(spark: SparkSession, base: str) -> DataFrame:
    """Batch jobs: one row per order, with node lists in bracket syntax."""
    numbered = spark.read.parquet(f"{base}/orders.parquet").selectExpr(
        "o_orderkey AS id",
        "(o_orderkey * 7919) % 60 AS hi",
        # Some jobs are submitted before New Year, some months later.
        """TIMESTAMP_NTZ '2024-01-01 00:00:00'
           + make_dt_interval(0, 0, int((o_orderkey * 7919) % 40320))
           + make_dt_interval(CASE WHEN o_orderkey % 41 = 5 THEN -20
                                   WHEN o_orderkey % 43 = 7 THEN int(30 * (o_orderkey % 12))
                                   ELSE 0 END) AS submit_date""",
        # Some wait for a fraction of a second.
        """CASE WHEN o_orderkey % 29 = 3 THEN make_dt_interval(0, 0, 0, 0.75)
                ELSE make_dt_interval(0, 0, int(o_custkey % 180)) END AS wait""",
        # Some run for ten seconds; some seem to end before they start.
        """CASE WHEN o_orderkey % 37 = 3 THEN make_dt_interval(0, 0, 0, 10)
                WHEN o_orderkey % 47 = 9 THEN make_dt_interval(0, 0, -30)
                ELSE make_dt_interval(0, 0, int(1 + (o_custkey * 31 + o_orderkey) % 600))
           END AS run""",
        """CASE WHEN o_orderkey % 10 = 0 THEN 3 WHEN o_orderkey % 10 = 1 THEN 4 ELSE 1 END
           AS numnodes""",
        "CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 16 ELSE 8 END AS cores",
    )
    return numbered.selectExpr(
        "id",
        f"""CASE WHEN id % 97 = 0 THEN 'None assigned'
                 WHEN id % 97 = 1 THEN 'software 1'
                 WHEN id % 10 = 0 THEN concat('r', 10 + hi DIV 6, 'n[1-2,4]')
                 WHEN id % 10 = 1 THEN concat('r', 10 + hi DIV 6, 'n[1,3-4],r16n2')
                 ELSE {NODE_NAME.format("hi")} END AS node""",
        "submit_date",
        "submit_date + wait AS start_date",
        "submit_date + wait + run AS end_date",
        """CASE WHEN id % 31 = 2 THEN NULL
                WHEN id % 12 <= 1 THEN 'FAILED'
                WHEN id % 12 = 2 THEN concat('CANCELLED by ', id)
                WHEN id % 12 = 3 THEN 'TIMEOUT'
                WHEN id % 12 = 4 THEN 'OUT_OF_MEMORY'
                WHEN id % 12 = 5 THEN 'NODE_FAIL'
                ELSE 'COMPLETED' END AS state""",
        "numnodes",
        "numnodes * cores AS numcores",
    )


def hardware(spark: SparkSession, base: str) -> DataFrame:
    """One row per node that the orders are mapped to, and six nodes without samples."""
    indexes = (
        spark.read.parquet(f"{base}/orders.parquet")
        .selectExpr("explode(array((o_orderkey * 7919) % 60, 60 + o_orderkey % 6)) AS ni")
        .distinct()
    )
    return indexes.selectExpr(
        "ni",
        "int(1 + ni % 2) AS cpus",
        "CASE WHEN ni < 36 THEN 0 WHEN ni % 6 < 4 THEN 4 ELSE 2 END AS gpus",
    ).selectExpr(
        f"{NODE_NAME.format('ni')} AS node",
        "concat('cpu-', ni % 3) AS cpu_model",
        "CASE WHEN ni >= 36 THEN concat('gpu-', ni % 2) END AS gpu_model",
        "cpus AS cpu_count",
        "cpus * 16 AS cpu_core_count_total",
        "cpus * 125 AS cpu_tdp_total",
        f"cpus * {96 * 1024**3}L AS cpu_memory_bytes_total",
        f"{2 * 1024**4}L AS node_filesystem_size_bytes_total",
        "gpus AS gpu_count",
        "250 AS gpu_tdp_per_card",
        "gpus * 250 AS gpu_tdp_total",
        f"gpus * {24 * 1024**3}L AS gpu_memory_bytes_total",
        "80 AS cpu_t_case_max",
        "100 AS cpu_per_core_temp_max",
        "90 AS gpu_temp_max",
    )
