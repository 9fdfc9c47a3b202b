"""Spark side of the registered queries.

Each takes ``(spark, base)``, reads the parquet tables below ``base`` as a whole
and returns a DataFrame.  Doubles are rounded so that results of two engines
with different summation order can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackline.functions import jsonmap, nodes, ratios, times
from rackline.operators import clean, correlation, distribution, ordered, profile
from rackline.operators.attach import attach
from rackline.plans import energy, gpu, hardware, integration, jobs, peers
from rackline.sources import views
from rackline.sources.loader import read_table
from rackline.sources.tables import (
    Tables,
    columns_of_type,
    fresh_path,
    literal_table,
    load,
    materialise,
    select_by_dtype,
    store_bucketed,
    write_joined,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
STATES = energy.STATES


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles}) if doubles else df


def query(name: str, digits: int | None = 6):
    """Register a query; without ``digits`` it rounds its doubles itself."""

    def register(build: Query) -> Query:
        REGISTRY[name] = build if digits is None else lambda spark, base: rounded(build(spark, base), digits)
        return build

    return register


def joined(spark: SparkSession, base: str, **how) -> DataFrame:
    return integration.integrate(views.samples(spark, base), views.jobs(spark, base), **how)


def unpaired(spark: SparkSession, base: str) -> integration.Sides:
    """The joined table's two sides, for analyses that need not pair them."""
    return integration.sides(views.samples(spark, base), views.jobs(spark, base))


def job_summary(spark: SparkSession, base: str) -> DataFrame:
    return energy.observed_job_nodes(views.samples(spark, base), views.jobs(spark, base))


SAMPLE_COLUMNS = ("prom_id", "node", "timestamp", "gpu_node", "node_power_usage")
NARROW = (*SAMPLE_COLUMNS, "slurm_id", "state", "start_date", "end_date", "numnodes", "numcores")


def stored_joined(spark: SparkSession, base: str) -> DataFrame:
    """The joined table as a stored one, with the number of jobs at each instant.

    Samples are put in buckets by instant, so that those of one instant are counted, and get
    the number of its jobs, where they lie.  Rows are paired after that, and written as they come.
    """
    samples = views.samples(spark, base).select(*SAMPLE_COLUMNS)
    window = integration.common_window(views.jobs(spark, base), samples)
    placed = store_bucketed(samples, ["node", "timestamp"])
    path = fresh_path(spark)
    how = {"counted": "concurrent_job_count", "in_order": True, "columns": [*NARROW, "concurrent_job_count"]}
    write_joined(integration.integrate(placed, views.jobs(spark, base), window, **how), path, in_order=True)
    return load(spark, path)


def enriched(spark: SparkSession, base: str) -> DataFrame:
    return jobs.jobs_enriched(views.jobs(spark, base), views.GPU_NODES)


def hw(spark: SparkSession, base: str) -> DataFrame:
    return views.hardware(spark, base)


def observed_hw(spark: SparkSession, base: str) -> DataFrame:
    return hardware.observed_hardware(hw(spark, base), views.samples(spark, base))


def flagged_hw(spark: SparkSession, base: str) -> DataFrame:
    return nodes.flag_gpu(observed_hw(spark, base), "node", views.GPU_NODES)


def micros(col: str):
    """Timestamps as whole microseconds since 1970, the same in every client."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, F.col(col)).alias(col)


# --- energy and classes -------------------------------------------------------


@query("energy_by_class_state", 2)
def energy_by_class_state(spark, base):
    return energy.energy_by_class_state(job_summary(spark, base))


@query("energy_from_joined", 2)
def energy_from_joined(spark, base):
    """The same from the stored joined table."""
    return energy.energy_by_class_state(energy.job_nodes(stored_joined(spark, base)))


@query("energy_share", 2)
def energy_share(spark, base):
    return energy.energy_share(job_summary(spark, base))


@query("submissions_by_class_state")
def submissions_by_class_state(spark, base):
    return energy.submissions_by_class_state(unpaired(spark, base))


@query("runtime_by_class_state")
def runtime_by_class_state(spark, base):
    return energy.runtime_by_class_state(unpaired(spark, base))


@query("class_state_metrics", 2)
def class_state_metrics(spark, base):
    return energy.class_state_metrics(job_summary(spark, base))


@query("class_comparison", 2)
def class_comparison(spark, base):
    return energy.class_comparison(job_summary(spark, base))


@query("normalised_metrics")
def normalised_metrics(spark, base):
    return energy.normalise_columns(
        energy.class_state_metrics(job_summary(spark, base)), energy.METRICS, ["gpu_node"]
    )


@query("percent_table")
def percent_table(spark, base):
    cols = ["job_submissions", "job_runtime", "job_energy"]
    table = energy.class_label(energy.class_comparison(job_summary(spark, base)))
    return energy.percent_table(energy.normalise_columns(table, cols), cols, ["type"])


@query("metrics_melted")
def metrics_melted(spark, base):
    return energy.melted_comparison(energy.class_comparison(job_summary(spark, base)))


@query("metrics_pivot")
def metrics_pivot(spark, base):
    long = energy.melted_comparison(energy.class_comparison(job_summary(spark, base)))
    return energy.pivot_mean(long, "variable", "type", "value", ["Generic", "ML"])


@query("stack_offsets")
def stack_offsets(spark, base):
    long = energy.melted_comparison(energy.class_comparison(job_summary(spark, base)))
    return energy.stack_offsets(long, "variable", "type", "value", ["Generic", "ML"])


@query("state_matrix")
def state_matrix(spark, base):
    return energy.state_matrix(energy.class_state_metrics(job_summary(spark, base)))


# --- integration --------------------------------------------------------------


@query("interval_join_pairs", None)
def interval_join_pairs(spark, base):
    """What is made of one side is made before the join, once for a row and not for each of its pairs."""
    sides = unpaired(spark, base)
    samples = sides.samples.select(
        "prom_id", "node", "timestamp", micros("timestamp").alias("_at_micros"), "node_power_usage", "gpu_node"
    )
    jobs = sides.jobs.withColumns({
        "_start_micros": micros("start_date"),
        "_end_micros": micros("end_date"),
        "listed_nodes": F.size("slurm_nodes"),
    })
    pairs = integration.Sides(rounded(samples), jobs).pairs([
        "prom_id", "node", "_at_micros", "slurm_id", "state", "numnodes", "numcores", "_start_micros", "_end_micros",
        "node_power_usage", "gpu_node", "listed_nodes",
    ])
    return pairs.withColumnsRenamed({"_at_micros": "timestamp", "_start_micros": "start_date", "_end_micros": "end_date"})


def stored_tables(spark, base) -> Tables:
    """The tables below one path, under their own names and with their own columns."""
    tables = Tables(fresh_path(spark))
    samples = views.samples(spark, base).withColumnRenamed("prom_id", "id")
    samples.write.parquet(tables.path("node_samples"))
    views.jobs(spark, base).write.parquet(tables.path("jobs"))
    hw(spark, base).write.parquet(tables.path("node_hardware"))
    return tables


@query("named_tables", 2)
def named_tables(spark, base):
    """From the stored tables through the stored joined one to an analysis."""
    tables = stored_tables(spark, base)
    samples, job_table = tables.load(spark, "node_samples"), tables.load(spark, "jobs")
    table = integration.integrate(samples, job_table, counted="concurrent_job_count", in_order=True)
    write_joined(table, tables.path("job_samples"), in_order=True)
    return energy.class_state_metrics(energy.job_nodes(tables.load(spark, "job_samples")))


@query("named_cards")
def named_cards(spark, base):
    tables = stored_tables(spark, base)
    return gpu.slot_stats(
        gpu.slot_ratios(tables.load(spark, "node_samples"), tables.load(spark, "node_hardware"))
    )


@query("select_integers")
def select_integers(spark, base):
    """Columns by type, of the table as registered under its logical name."""
    tables = stored_tables(spark, base)
    tables.register(spark, ["jobs"])
    return select_by_dtype(spark.table("jobs"), T.IntegerType).groupBy("numnodes").agg(
        F.count(F.lit(1)).alias("n"), F.sum("numcores").alias("cores")
    )


@query("joined_written")
def joined_written(spark, base):
    """Through the sink and back: the joined table as other sessions would read it."""
    path = fresh_path(spark)
    write_joined(joined(spark, base, in_order=True), path, in_order=True)
    return load(spark, path).select(
        F.size("slurm_nodes").alias("listed_nodes"), "prom_id", "node", micros("timestamp"), "slurm_id", "state", micros("submit_date"),
        micros("end_date"), "node_load1",
    )


@query("loaded_every_fifth")
def loaded_every_fifth(spark, base):
    order = ["user_id", "ts", "event_id"]
    table, _ = read_table(spark, f"{base}/events.parquet", nth=5, order=order)
    return table.select("event_id", "user_id", "event_type", "value")


@query("loaded_clean")
def loaded_clean(spark, base):
    """Every fifth event in order, without the incomplete ones."""
    order = ["user_id", "ts", "event_id"]
    table, _ = read_table(spark, f"{base}/events.parquet", nth=5, sort=True, clean=True, order=order)
    return table.select("event_id", "user_id", micros("ts"), "event_type", "value")


@query("loaded_profile")
def loaded_profile(spark, base):
    """What the loader says about the events that it read."""
    order = ["user_id", "ts", "event_id"]
    _, seen = read_table(spark, f"{base}/events.parquet", nth=5, sort=True, clean=True, order=order)
    return table_profile(seen).drop("dataType")


@query("literal_classes")
def literal_classes(spark, base):
    """Samples per class, named by a table written in place; a class without samples stays."""
    names = literal_table(
        spark, [(0, "Generic", None), (1, "ML", "gpu"), (2, "Storage", None)], "gpu_node int, type string, card string"
    )
    counts = views.samples(spark, base).groupBy("gpu_node").agg(F.count(F.lit(1)).alias("samples"))
    return attach(names, counts, "gpu_node").select("type", "card", F.coalesce("samples", F.lit(0)).alias("samples"))


@query("concurrent_jobs", None)
def concurrent_jobs(spark, base):
    """The share of a job is the same for all jobs of a sample, and made and rounded once for the sample."""
    share = F.col("node_power_usage") / F.col("concurrent_job_count")
    return integration.with_concurrency(
        unpaired(spark, base),
        columns=["prom_id", "slurm_id", "concurrent_job_count", "power_per_job"],
        finish=lambda counted: rounded(counted.withColumn("power_per_job", share)),
    )


@query("state_counts_pivot")
def state_counts_pivot(spark, base):
    counts = integration.state_counts(unpaired(spark, base), list(STATES))
    return counts.select("node", micros("timestamp"), *STATES, "total_jobs_running")


@query("date_coverage")
def date_coverage(spark, base):
    found = integration.date_coverage(views.jobs(spark, base), views.samples(spark, base))
    return found.select("source", micros("first_time"), micros("last_time"), "days")


@query("window_restrict")
def window_restrict(spark, base):
    inside_jobs, inside_samples = integration.restrict_to_window(
        views.jobs(spark, base), views.samples(spark, base)
    )
    return inside_jobs.select(F.lit("jobs").alias("source"), "id").unionByName(
        inside_samples.select(F.lit("samples").alias("source"), F.col("prom_id").alias("id"))
    )


@query("job_span_stats", 4)
def job_span_stats(spark, base):
    return integration.job_span_stats(views.jobs(spark, base))


@query("explode_days")
def explode_days(spark, base):
    days = times.explode_days(views.jobs(spark, base), "start_date", "end_date")
    return days.select("id", F.date_format("running_day", "yyyy-MM-dd").alias("running_day"))


@query("top_node_lists")
def top_node_lists(spark, base):
    return integration.longest_node_lists(views.jobs(spark, base), 5).select(
        "id", "node", F.array_join(F.array_sort("nodez"), ",").alias("nodez")
    )


@query("overview")
def overview(spark, base):
    tables = [
        profile.overview(views.jobs(spark, base), "jobs", "start_date", "end_date"),
        profile.overview(views.samples(spark, base), "samples", "timestamp", "timestamp"),
        profile.overview(joined(spark, base), "job_samples", "timestamp", "timestamp"),
    ]
    both = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return both.select(
        "table_name", "row_count", "column_count", micros("first_time"), micros("last_time")
    )


# --- jobs ---------------------------------------------------------------------


@query("jobs_enriched")
def jobs_enriched(spark, base):
    return enriched(spark, base).select(
        "id", "node", "is_ml", "state", "rack", "job_waiting_time", "job_running_time",
        "node_hours", F.size("split_nodes").alias("listed_nodes"),
    )


@query("calendar_columns")
def calendar_columns(spark, base):
    dated = times.calendar_columns(views.jobs(spark, base))
    return dated.select(
        "id", F.date_format("submit_day", "yyyy-MM-dd").alias("submit_day"),
        "submit_hour_of_day", "submit_day_of_week", "month_of_year", "week_of_year",
        "day_of_year", "hour_of_year", "minute_of_year", "second_of_year",
    )


def _per_period(period: str) -> Query:
    column = jobs.PERIODS[period]

    def build(spark, base):
        counts = jobs.jobs_per_period(enriched(spark, base), period)
        return counts.withColumn(column, F.col(column).cast("string"))

    return build


for _name, _period in (
    ("jobs_per_day", "day"),
    ("jobs_per_month", "month"),
    ("jobs_per_week_u", "week"),
    ("jobs_per_doy", "day_of_year"),
    ("jobs_per_hour_of_year", "hour"),
):
    query(_name)(_per_period(_period))


@query("mean_jobs_per_day")
def mean_jobs_per_day(spark, base):
    return jobs.mean_jobs_per_period(enriched(spark, base))


@query("jobs_per_rack")
def jobs_per_rack(spark, base):
    return jobs.jobs_per_rack(enriched(spark, base))


@query("jobs_per_node_top5")
def jobs_per_node_top5(spark, base):
    return jobs.busiest_nodes(enriched(spark, base))


@query("jobs_per_numnodes")
def jobs_per_numnodes(spark, base):
    return jobs.jobs_per_numnodes(enriched(spark, base))


@query("numnodes_counts")
def numnodes_counts(spark, base):
    return distribution.value_counts(enriched(spark, base), "numnodes", ["is_ml"], "jobs")


@query("failures_by_hour")
def failures_by_hour(spark, base):
    return jobs.failures_by_hour(enriched(spark, base))


# --- distributions ------------------------------------------------------------

WAIT_RUN = ["job_waiting_time", "job_running_time"]
SIZES = ["numnodes", "numcores", "node_hours"]


def _describe(cols: list[str], scale: float) -> Query:
    def build(spark, base):
        population = jobs.with_populations(enriched(spark, base))
        return distribution.describe(population, cols, ["population"], scale)

    return build


query("describe_wait_run")(_describe(WAIT_RUN, 1.0))
query("describe_wait_run_minutes")(_describe(WAIT_RUN, 60.0))
query("describe_wait_run_seconds", 4)(_describe(WAIT_RUN, 3600.0))
query("describe_size")(_describe(SIZES, 1.0))
query("describe_node_minutes")(_describe(["node_hours"], 60.0))


@query("quantiles_runtime")
def quantiles_runtime(spark, base):
    marked = jobs.with_populations(enriched(spark, base))
    return distribution.quantiles(
        marked, ["job_running_time"], [0.7415, 0.8, 0.9072], ["population"]
    )


@query("shares_wait_run")
def shares_wait_run(spark, base):
    return jobs.wait_run_shares(enriched(spark, base))


@query("shares_cores")
def shares_cores(spark, base):
    return jobs.core_shares(enriched(spark, base))


def _ecdf(col: str, by: list[str]) -> Query:
    def build(spark, base):
        chosen = enriched(spark, base)
        if "state" in by:
            chosen = jobs.by_class_and_state(chosen)
        return distribution.ecdf(chosen, col, by)

    return build


for _name, _col in (
    ("ecdf_wait", "job_waiting_time"),
    ("ecdf_runtime", "job_running_time"),
    ("ecdf_cores", "numcores"),
    ("ecdf_numnodes", "numnodes"),
    ("ecdf_node_hours", "node_hours"),
):
    query(_name)(_ecdf(_col, ["is_ml", "state"]))
query("ecdf_wait_by_class")(_ecdf("job_waiting_time", ["is_ml"]))
query("ecdf_runtime_by_class")(_ecdf("job_running_time", ["is_ml"]))


@query("box_jobs_per_period")
def box_jobs_per_period(spark, base):
    return jobs.box_jobs_per_period(enriched(spark, base))


# --- hardware -----------------------------------------------------------------


@query("hardware_join")
def hardware_join(spark, base):
    return hardware.with_hardware(views.samples(spark, base), hw(spark, base)).select(
        "prom_id", "node", "gpu_node", "node_load1", "cpu_model", "gpu_model", "cpu_count",
        "cpu_memory_bytes_total", "gpu_count",
    )


@query("hardware_semi")
def hardware_semi(spark, base):
    return observed_hw(spark, base)


@query("hardware_units")
def hardware_units(spark, base):
    return ratios.convert_bytes(flagged_hw(spark, base))


def _unit_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("node", "gpu_node", "rack", "gpu_rack")]


@query("hardware_describe", 4)
def hardware_describe(spark, base):
    units = ratios.convert_bytes(flagged_hw(spark, base))
    cols = [c for c in _unit_columns(units) if not c.endswith("model")]
    return distribution.describe(units, cols, ["gpu_node"])


@query("hardware_modes")
def hardware_modes(spark, base):
    units = ratios.convert_bytes(flagged_hw(spark, base))
    return distribution.modes(units, _unit_columns(units), ["gpu_node"])


@query("hardware_totals")
def hardware_totals(spark, base):
    units = ratios.convert_bytes(flagged_hw(spark, base))
    return distribution.column_totals(
        units, [c for c in units.columns if c != "node" and not c.endswith("model")]
    )


@query("rack_hardware")
def rack_hardware(spark, base):
    return ratios.convert_bytes(hardware.rack_hardware(observed_hw(spark, base), views.GPU_NODES))


@query("rack_describe", 4)
def rack_describe(spark, base):
    units = ratios.convert_bytes(hardware.rack_hardware(observed_hw(spark, base), views.GPU_NODES))
    return distribution.describe(units, _unit_columns(units), ["gpu_rack"])


@query("rack_modes")
def rack_modes(spark, base):
    units = ratios.convert_bytes(hardware.rack_hardware(observed_hw(spark, base), views.GPU_NODES))
    return distribution.modes(units, _unit_columns(units), ["gpu_rack"])


ALL_RATIOS = (
    "node_load_1_ratio", "cpu_power_sum_ratio", "cpu_mem_ratio",
    "cpu_temp_mean_ratio", "cpu_temp_min_ratio", "cpu_temp_max_ratio",
    "cpu_core_temp_mean_ratio", "cpu_core_temp_min_ratio", "cpu_core_temp_max_ratio",
    "gpu_power_sum_ratio", "gpu_mem_sum_ratio",
    "gpu_temp_mean_ratio", "gpu_temp_min_ratio", "gpu_temp_max_ratio",
)


@query("utilisation_ratios", 9)
def utilisation_ratios(spark, base):
    wide = hardware.with_hardware(views.samples(spark, base), hw(spark, base))
    return ratios.utilisation_ratios(wide).select("prom_id", "gpu_node", *ALL_RATIOS)


@query("ratios_clipped", 9)
def ratios_clipped(spark, base):
    return hardware.utilisation(views.samples(spark, base), hw(spark, base)).select(
        "prom_id", "gpu_node", *ALL_RATIOS
    )


def percent(spark, base, *keep: str, cols=ratios.RATIOS) -> DataFrame:
    return hardware.utilisation_percent(views.samples(spark, base), hw(spark, base), cols, keep=keep)


@query("ratios_winsorized", 9)
def ratios_winsorized(spark, base):
    return percent(spark, base, "prom_id")


@query("ratio_describe")
def ratio_describe(spark, base):
    return distribution.describe(percent(spark, base), ratios.RATIOS, ["gpu_node"])


@query("ratio_describe_all")
def ratio_describe_all(spark, base):
    whole = hardware.rounded(percent(spark, base), ratios.RATIOS)
    return distribution.describe(whole, ratios.RATIOS)


@query("ratio_histogram")
def ratio_histogram(spark, base):
    return distribution.histogram_density(percent(spark, base), ratios.RATIOS, ["gpu_node"])


@query("ratio_box")
def ratio_box(spark, base):
    whole = hardware.rounded(percent(spark, base), ratios.RATIOS)
    return distribution.box_stats(whole, ratios.RATIOS, ["gpu_node"])


@query("ratio_box_outliers")
def ratio_box_outliers(spark, base):
    whole = hardware.rounded(percent(spark, base), ratios.RATIOS)
    return distribution.box_outliers(whole, ratios.RATIOS, ["gpu_node"])


@query("hot_share")
def hot_share(spark, base):
    column = "gpu_temp_max_ratio"
    return hardware.hot_share(percent(spark, base, cols=[column]), column)


# --- GPU cards ----------------------------------------------------------------


def cards(spark, base) -> DataFrame:
    return gpu.slot_ratios(views.samples(spark, base), hw(spark, base))


@query("gpu_slot_ratios", 9)
def gpu_slot_ratios(spark, base):
    return cards(spark, base).drop("timestamp")


@query("gpu_slot_stats")
def gpu_slot_stats(spark, base):
    return gpu.slot_stats(cards(spark, base))


@query("gpu_nodes_count")
def gpu_nodes_count(spark, base):
    return distribution.count_distinct(
        gpu.all_slots_at_least(cards(spark, base), 0.0), ["node"], ["gpu_count"]
    )


@query("gpu_power_temp_bins")
def gpu_power_temp_bins(spark, base):
    return gpu.binned_temperature(gpu.all_slots_at_least(cards(spark, base), 0.0))


@query("gpu_power_temp_bins_95")
def gpu_power_temp_bins_95(spark, base):
    return gpu.binned_temperature(gpu.all_slots_at_least(cards(spark, base), 0.95))


@query("gpu_temp_at_100")
def gpu_temp_at_100(spark, base):
    return gpu.temperature_at(
        gpu.binned_temperature(gpu.all_slots_at_least(cards(spark, base), 0.0))
    )


# --- peers --------------------------------------------------------------------


def high_load(spark, base) -> integration.Sides:
    return peers.high_load_jobs(unpaired(spark, base))


@query("high_load_rows", None)
def high_load_rows(spark, base):
    """All doubles are those of the sample, and rounded before it meets its jobs."""
    columns = [
        "prom_id", "slurm_id", "node", "gpu_node", "node_power_usage", "concurrent_job_count",
        "node_power_usage_mean", "node_power_usage_std",
    ]
    return peers.high_load_rows(
        unpaired(spark, base),
        columns=columns,
        finish=lambda above: rounded(above.select("timestamp", *[c for c in columns if c != "slurm_id"])),
    )


@query("peer_pairs")
def peer_pairs(spark, base):
    return peers.peer_pairs(high_load(spark, base), STATES)


@query("peer_state_counts")
def peer_state_counts(spark, base):
    """The time is made a number once for an instant, not for each job that ran then."""
    counts = peers.peer_state_counts(
        high_load(spark, base), STATES, finish=lambda instants: instants.withColumn("_at_micros", micros("timestamp"))
    )
    return counts.withColumn("timestamp", F.col("_at_micros")).drop("_at_micros")


@query("peer_state_corr")
def peer_state_corr(spark, base):
    return peers.peer_state_corr(high_load(spark, base), STATES)


@query("peer_state_corr_triangle")
def peer_state_corr_triangle(spark, base):
    return peers.lower_triangle(peers.peer_state_corr(high_load(spark, base), STATES), STATES)


@query("peer_state_corr_diff")
def peer_state_corr_diff(spark, base):
    return peers.matrix_difference(peers.peer_state_corr(high_load(spark, base), STATES))


# --- data quality -------------------------------------------------------------


def raw(spark, base) -> DataFrame:
    return views.raw_samples(spark, base)


@query("null_pct")
def null_pct(spark, base):
    return profile.null_pct(raw(spark, base))


@query("null_pct_by_node")
def null_pct_by_node(spark, base):
    return profile.null_pct_by(raw(spark, base), "node")


def table_profile(df: DataFrame) -> DataFrame:
    """A profile whose examples of doubles are written alike by every engine."""
    number = F.format_string("%.6f", F.col("example_value").cast("double"))
    shown = F.when(F.col("dataType") == "double", number).otherwise(F.col("example_value"))
    return df.withColumn("example_value", shown)


@query("profile")
def whole_profile(spark, base):
    return table_profile(profile.profile(raw(spark, base)))


@query("null_mask")
def null_mask(spark, base):
    mask = profile.null_mask(raw(spark, base), ["prom_id"])
    flags = [c for c in mask.columns if c != "prom_id"]
    return mask.withColumns({c: F.col(c).cast("int") for c in flags})


@query("null_mask_by_hour")
def null_mask_by_hour(spark, base):
    return profile.null_mask_by_hour(raw(spark, base))


@query("complete_rows")
def complete_rows(spark, base):
    return profile.complete_rows(raw(spark, base))


def _drop_time(df: DataFrame) -> DataFrame:
    return df.drop("timestamp")


@query("fill_drop")
def fill_drop(spark, base):
    return clean.fill_drop(raw(spark, base)).withColumn("timestamp", micros("timestamp"))


@query("fill_drop_all")
def fill_drop_all(spark, base):
    return clean.fill_drop_all(raw(spark, base)).withColumn("timestamp", micros("timestamp"))


@query("dropped_pct")
def dropped_pct(spark, base):
    before = raw(spark, base)
    return clean.dropped_pct(before, clean.fill_drop(before))


@query("dropped_pct_observed")
def dropped_pct_observed(spark, base):
    """The same, counted while the cleaned table is written."""
    return clean.drop_observed(raw(spark, base), clean.fill_drop)[1]


ORDER = ["timestamp", "prom_id"]


@query("null_neighbours")
def null_neighbours(spark, base):
    gaps = raw(spark, base).select("prom_id", "node", "timestamp", "node_power_usage")
    found = ordered.null_rows_with_neighbours(gaps, ["node"], ORDER, key=["prom_id"])
    return _drop_time(found).withColumn("has_null", F.col("has_null").cast("int"))


@query("interpolate")
def interpolate(spark, base):
    filled = ordered.interpolate(
        raw(spark, base),
        ["node_power_usage", "nvidia_gpu_power_usage_milliwatts_0"],
        ["node"],
        ORDER,
        {"default": 1.0},
        0.5,
        ["prom_id"],
    )
    return filled.select(
        "prom_id", "node", "node_index", "node_power_usage", "nvidia_gpu_power_usage_milliwatts_0"
    )


@query("every_nth")
def every_nth(spark, base):
    return _drop_time(
        ordered.every_nth(
            raw(spark, base).select("prom_id", "node", "timestamp"), 7, ORDER, key=["prom_id"]
        )
    )


@query("json_keys")
def json_keys(spark, base):
    return jsonmap.json_keys(raw(spark, base), "power_json")


@query("json_widen")
def json_widen(spark, base):
    wide = jsonmap.json_widen(raw(spark, base), "power_json", ("0", "1"))
    return wide.select("prom_id", *[F.col(c) for c in wide.columns if c.startswith("power_json-")])


@query("json_long")
def json_long(spark, base):
    return jsonmap.json_long(raw(spark, base).select("prom_id", "power_json"), "power_json")


@query("json_long_props")
def json_long_props(spark, base):
    """The JSON text of the event stream itself."""
    return jsonmap.json_long(load(spark, f"{base}/events.parquet").select("event_id", "props"), "props")


@query("json_keys_props")
def json_keys_props(spark, base):
    return jsonmap.json_keys(load(spark, f"{base}/events.parquet"), "props")


@query("json_leaves")
def json_leaves(spark, base):
    """Values of nested JSON text, made of each event."""
    events = load(spark, f"{base}/events.parquet")
    nested = F.expr(
        """concat('{"props": ', props, ', "user": {"id": ', user_id, ', "tags": ["', event_type, '", ', event_id % 7,
           ', null, [true]]}}')"""
    )
    leaves = jsonmap.json_leaves(events.select("event_id", nested.alias("doc")), "doc")
    return leaves.select("event_id", "path", "value", F.when(F.col("kind") == "STRING", "text").alias("kind"))


@query("json_aggregate")
def json_aggregate(spark, base):
    rows = raw(spark, base).select("prom_id", "power_json")
    return jsonmap.json_aggregate(rows, "power_json", ("min", "mean", "max", "sum"))


CORRELATED = ("node_ambient_temp", "node_power_usage", "nvidia_gpu_power_usage_milliwatts_0")


@query("corr_pearson")
def corr_pearson(spark, base):
    some = raw(spark, base).select("prom_id", "node", *CORRELATED)
    return correlation.pearson_matrix(select_by_dtype(some, T.DoubleType))


@query("corr_wide")
def corr_wide(spark, base):
    """All doubles of the samples, and a constant."""
    wide = views.samples(spark, base).withColumn("constant", F.lit(1.0))
    return correlation.pearson_matrix(wide)


@query("corr_spearman")
def corr_spearman(spark, base):
    return correlation.spearman_matrix(raw(spark, base), CORRELATED, ["prom_id"])


@query("corr_spearman_wide")
def corr_spearman_wide(spark, base):
    """Rank correlation of all doubles of the samples."""
    samples = views.samples(spark, base)
    doubles = columns_of_type(samples, T.DoubleType)
    return correlation.spearman_matrix(samples, doubles, ["prom_id"])


@query("distinct_states")
def distinct_states(spark, base):
    return distribution.distinct_values(joined(spark, base), "state")


@query("node_expand")
def node_expand(spark, base):
    expanded = views.jobs(spark, base).select("id", nodes.expand_nodes(F.col("node")).alias("n"))
    return expanded.select("id", F.explode("n").alias("node_name"))


@query("node_expand_simple")
def node_expand_simple(spark, base):
    expanded = views.jobs(spark, base).select(
        "id", nodes.expand_nodes_simple(F.col("node")).alias("n")
    )
    return expanded.select("id", F.explode("n").alias("node_name"))


@query("gpu_flag")
def gpu_flag(spark, base):
    listed = nodes.expand_nodes(F.col("node"))
    return views.jobs(spark, base).select(
        "id",
        nodes.gpu_flag(listed, views.GPU_NODES).alias("gpu_node"),
        F.size(nodes.gpu_members(listed, views.GPU_NODES)).alias("gpu_nodes_listed"),
        nodes.rack_regex(F.col("node")).alias("rack"),
        F.length("node").alias("node_length"),
    )
