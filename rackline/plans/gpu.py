"""Power and temperature of single GPU cards."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.functions.ratios import ratio, temperature_ratio
from rackline.plans.hardware import with_hardware

POWER = "nvidia_gpu_power_usage_milliwatts"
HEAT = "nvidia_gpu_temperature_celsius"


def gpu_slots(df: DataFrame) -> list[int]:
    """Slot numbers found in the column names, ascending."""
    found = (re.fullmatch(rf"{HEAT}_(\d+)", c) for c in df.columns)
    return sorted(int(m.group(1)) for m in found if m)


def slot_ratios(
    samples: DataFrame, hardware: DataFrame, min_cards: int = 4, slots: Sequence[int] | None = None
) -> DataFrame:
    """Per card power and temperature ratios on GPU nodes with enough cards."""
    slots = gpu_slots(samples) if slots is None else slots
    wide = with_hardware(samples, hardware).where(
        (F.col("gpu_node") == 1) & (F.col("gpu_count") >= min_cards)
    )
    row_id = [c for c in ("prom_id", "id") if c in samples.columns][:1]
    return wide.selectExpr(
        *row_id,
        "node",
        "timestamp",
        "gpu_count",
        *[f"{ratio(f'{POWER}_{i} / 1000', 'gpu_tdp_per_card')} AS power_{i}" for i in slots],
        *[f"{temperature_ratio(f'{HEAT}_{i}', 'gpu_temp_max')} AS temp_{i}" for i in slots],
    )


def _slots_of(ratios: DataFrame) -> list[int]:
    return sorted(int(c.split("_")[1]) for c in ratios.columns if c.startswith("power_"))


def all_slots_at_least(ratios: DataFrame, level: float) -> DataFrame:
    """Samples whose cards all draw at least ``level``; drops missing readings."""
    powers = [F.col(f"power_{i}") >= level for i in _slots_of(ratios)]
    return ratios.where(reduce(lambda a, b: a & b, powers))


def slot_stats(ratios: DataFrame) -> DataFrame:
    """Mean and sample deviation of each card's power ratio by number of cards."""
    slots = _slots_of(ratios)
    return ratios.groupBy("gpu_count").agg(
        *[F.avg(f"power_{i}").alias(f"power_{i}_mean") for i in slots],
        *[F.stddev_samp(f"power_{i}").alias(f"power_{i}_std") for i in slots],
    )


def unit_bin(x: Column, upper: int) -> Column:
    """Right edge of the bin ``(n-1, n]`` that holds ``x``; none outside ``(0, upper]``."""
    return F.when((x > 0) & (x <= upper), F.ceil(x).cast("int"))


def binned_temperature(ratios: DataFrame, upper: int = 170) -> DataFrame:
    """Mean temperature per card and 1 % power bin, labelled by the right edge.

    All bins from 1 to ``upper`` are present; those without samples have null.
    """
    slots = _slots_of(ratios)
    cards = F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                unit_bin(F.col(f"power_{i}") * 100, upper).alias("power_bin"),
                (F.col(f"temp_{i}") * 100).alias("temp"),
            )
            for i in slots
        ]
    )
    means = (
        ratios.select(F.inline(cards))
        .where(F.col("power_bin").isNotNull())
        .groupBy("slot", "power_bin")
        .agg(F.avg("temp").alias("mean_temp"), F.count(F.lit(1)).alias("samples"))
    )
    bins = ratios.sparkSession.range(1, upper + 1).select(
        F.explode(F.array(*[F.lit(i) for i in slots])).alias("slot"),
        F.col("id").cast("int").alias("power_bin"),
    )
    return bins.join(means, ["slot", "power_bin"], "left").na.fill(0, ["samples"])


def temperature_at(binned: DataFrame, power_bin: int = 100) -> DataFrame:
    """Temperatures of all cards at one power level: coolest and hottest card."""
    at = binned.where(F.col("power_bin") == power_bin)
    # Equal temperatures go to the lower slot, for either extreme.
    low = F.struct("mean_temp", "slot")
    high = F.struct("mean_temp", (-F.col("slot")).alias("slot"))
    known = F.col("mean_temp").isNotNull()
    return at.agg(
        F.min(F.when(known, low)).alias("low"), F.max(F.when(known, high)).alias("high")
    ).select(
        F.col("low.slot").alias("coolest_slot"),
        F.col("low.mean_temp").alias("coolest_temp"),
        (-F.col("high.slot")).alias("hottest_slot"),
        F.col("high.mean_temp").alias("hottest_temp"),
    )
