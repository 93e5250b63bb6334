"""Protocol metrics and energy models of micro-controllers and radios (inventory 77-79)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protocol_metrics(flat: DataFrame, keys=("arch", "lib", "opts", "benchmark", "item")) -> DataFrame:
    """77: cycles of each item: median of its runs but the first, less the median of the empty run.

    ``flat`` has keys, attr, run and value; ``nop`` is the attribute of empty runs. Under two runs,
    or beyond 1e7 cycles, there is no value.
    """
    median = lambda attr: F.median(F.when((F.col("attr") == attr) & (F.col("run") > 0), F.col("value")))
    runs = F.count_if(F.col("attr") == "cycles")
    g = flat.groupBy(*keys).agg((median("cycles") - F.coalesce(median("nop"), F.lit(0.0))).alias("_c"), runs.alias("runs"))
    return g.withColumn("cycles", F.when((F.col("runs") >= 2) & (F.col("_c") <= 1e7), F.col("_c"))).drop("_c")


def memory_metrics(wide: DataFrame, segments=("text", "data", "bss")) -> DataFrame:
    """77: sums of segments with and without the library, and what it adds in segments, stack and heap."""
    total = lambda prefix: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{prefix}{s}"), F.lit(0)) for s in segments])
    return wide.withColumns({"total": total(""), "total_delta": total("") - total("base_"), "stack_delta": F.col("stack") - F.col("base_stack"), "heap_delta": F.col("heap") - F.col("base_heap")})


def cycles_to_energy(df: DataFrame, currents: DataFrame, cycles: str = "cycles") -> DataFrame:
    """78: nanojoules of cycles by a current table (mcu, freq_hz, memory, volt, ampere): power times cycles by frequency."""
    keys = ["mcu", "freq_hz", "memory", "volt"]
    power = F.col("volt") * F.col("ampere")
    return df.join(currents, keys).withColumn("energy_nj", power * F.col(cycles) / F.col("freq_hz") * 1e9)


def radio_energy(size: Column, coefficients: list[float], header: int = 0, mtu: int | None = None) -> Column:
    """79: energy of sending some bytes: a polynomial in the bytes of each packet, headers included."""
    def poly(n):
        return reduce(lambda acc, c: acc * n + F.lit(float(c)), reversed(coefficients), F.lit(0.0))

    if mtu is None:
        return poly(size + header)
    full, rest = F.floor(size / mtu), size % mtu
    return full * poly(F.lit(mtu + header)) + F.when(rest > 0, poly(rest + header)).otherwise(0.0)


def radio_energy_per_byte(size: Column, coefficients: list[float]) -> Column:
    """79: derivative of the polynomial: what one byte more costs."""
    slope = [i * c for i, c in enumerate(coefficients)][1:] or [0.0]
    return reduce(lambda acc, c: acc * size + F.lit(float(c)), reversed(slope), F.lit(0.0))
