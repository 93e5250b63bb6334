"""Signals and time series (inventory 126-152, 165-168).

A signal table is long: ``signal`` (one or more key columns), ``i`` (sample index) or a time, and
``value``. Windows run within a signal; only change points and drift paths leave the JVM.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.operators.scan import Scan

KEYS = ["signal"]


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def running_mean(df: DataFrame, n: int, keys=KEYS, order: str = "i") -> DataFrame:
    """126: means of n samples in turn; incomplete ones are left out."""
    return Scan.of(df, keys, order).ahead(n, mean=F.avg("value"), _n=F.count("value")).rows().where(F.col("_n") == n).drop("_n")


def gradient(df: DataFrame, keys=KEYS, order: str = "i") -> DataFrame:
    """127: central differences, one-sided at the ends."""
    before, after, v = F.col("_before"), F.col("_after"), F.col("value")
    rows = Scan.of(df, keys, order).shifted(1, _before="value").shifted(-1, _after="value").rows()
    return rows.withColumn("gradient", F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)).drop("_before", "_after")


def threshold_points(df: DataFrame, limit: float, keys=KEYS, order: str = "i") -> DataFrame:
    """127: samples of steep gradient."""
    return gradient(df, keys, order).where(F.abs("gradient") > limit)


def edges(df: DataFrame, level: Column, after: float | None = None, keys=KEYS, order: str = "i", offset: int = 2) -> DataFrame:
    """128: level changes, after a start-up; the edge is at the sample ``offset`` further on."""
    rows = df if after is None else df.where(F.col(order) >= after)
    marked = Scan.of(rows.withColumn("level", level.cast("int")), keys, order).shifted(1, _was="level").rows()
    return marked.where(F.col("_was").isNotNull() & (F.col("level") != F.col("_was"))).select(*keys, (F.col(order) + offset).alias("edge"), "level")


def edge_errors(df: DataFrame, level: Column, least: int, keys=KEYS, order: str = "i") -> DataFrame:
    """128: signals that are too short or whose trigger starts or ends high."""
    high = level.cast("int")
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(high, order).alias("first"), F.max_by(high, order).alias("last"))
    return s.select(*keys, F.filter(F.array(F.when(F.col("n") < least, "too short"), F.when(F.col("first") == 1, "starts high"), F.when(F.col("last") == 1, "ends high")), lambda e: e.isNotNull()).alias("errors")).where(F.size("errors") > 0)


def calibration_edges(df: DataFrame, start: float, current: float, gap: float, keys=KEYS, order: str = "i") -> DataFrame:
    """129: first sample over 0.6 of the calibration current, and the first below 0.4 of it more than ``gap`` later."""
    up = df.where((F.col(order) >= start) & (F.col("value") > 0.6 * current)).groupBy(*keys).agg(F.min(order).alias("up"))
    return df.join(up, list(keys)).where((F.col(order) > F.col("up") + gap) & (F.col("value") < 0.4 * current)).groupBy(*keys, "up").agg(F.min(order).alias("down"))


def calibration_function(charge: Column, points: list[tuple[float, float]]) -> Column:
    """130: charge to current by straight lines through three (charge, current) means, going on beyond them."""
    (a, ya), (b, yb), (c, yc) = sorted(points)
    return F.when(charge < b, ya + (charge - a) * ((yb - ya) / (b - a))).otherwise(yb + (charge - b) * ((yc - yb) / (c - b)))


def charge_to_current(charge: Column, shunt: float) -> Column:
    """131: raw charge to current, with the converter's fixed factor."""
    return charge * (1.836 / (shunt * 65535))


def segments(df: DataFrame, edge: Column, keys=KEYS, order: str = "i") -> DataFrame:
    """132: a running number of segments; a new one begins where ``edge`` holds."""
    return Scan.of(df, keys, order).summed(segment=edge.cast("int")).rows()


def segment_table(df: DataFrame, clip: float, keys=KEYS, order: str = "i") -> DataFrame:
    """132: mean, deviation, clipping and duration of segments, steps to the neighbours, and the previous duration."""
    s = df.groupBy(*keys, "segment").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") >= clip).cast("double")).alias("clip_rate"), F.count("*").alias("duration"))
    rows = Scan.of(s, keys, "segment").shifted(1, _prev="mean", timeout="duration").shifted(-1, _next="mean").rows()
    return rows.withColumns({"to_prev": F.col("mean") - F.col("_prev"), "to_next": F.col("mean") - F.col("_next"), "is_state": F.col("segment") % 2 == 0}).drop("_prev", "_next")


def validate_segments(table: DataFrame, plan: DataFrame, keys=KEYS, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """133: each planned segment with a reason if it is missing, clipped, or of wrong kind or duration."""
    j = plan.join(table, [*keys, "segment"], "full_outer")
    reason = (
        F.when(F.col("duration").isNull() | F.col("planned").isNull(), "wrong number of segments")
        .when(F.col("is_state") != F.col("planned_state"), "state and transition confused")
        .when(F.col("clip_rate") > 0, "clipped")
        .when(~F.coalesce("near_interrupt", F.lit(False)) & ((F.col("duration") < low * F.col("planned")) | (F.col("duration") > high * F.col("planned"))), "wrong duration")
    )
    return j.select(*keys, "segment", reason.alias("reason"))


def islands(df: DataFrame, on: Column, keys=KEYS, order: str = "i") -> DataFrame:
    """Maximal runs of equal ``on``: start, end, count and number in order."""
    new = F.coalesce(F.col("_on") != F.col("_was"), F.lit(True)).cast("int")
    runs = Scan.of(df.withColumn("_on", on), keys, order).shifted(1, _was="_on").summed(run=new).rows()
    return runs.groupBy(*keys, "run").agg(F.first("_on").alias("on"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def sync_pulses(df: DataFrame, high: float, shortest: float, longest: float, wanted: int = 3, keys=KEYS, order: str = "i") -> DataFrame:
    """134: high runs of a duration between the bounds, for signals that have just as many as wanted."""
    runs = islands(df, F.col("value") > high, keys, order).where(F.col("on") & (F.col("end") - F.col("start") > shortest) & (F.col("end") - F.col("start") < longest))
    return runs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") == wanted).withColumn("pulse", F.row_number().over(_w(keys, "start"))).select(*keys, "pulse", "start", "end")


def rescale_clock(plan: DataFrame, pulses: DataFrame, keys=KEYS, order: str = "i") -> DataFrame:
    """135: planned durations as running times, stretched to run from the first pulse's end to the second's start."""
    p = pulses.groupBy(*keys).agg(F.max(F.when(F.col("pulse") == 1, F.col("end"))).alias("a"), F.max(F.when(F.col("pulse") == 2, F.col("start"))).alias("b"))
    w = _w(keys, order)
    t = plan.withColumns({"_t": F.sum("planned").over(w), "_all": F.sum("planned").over(Window.partitionBy(*keys))})
    return t.join(p, list(keys)).withColumn("time", F.col("a") + F.col("_t") / F.col("_all") * (F.col("b") - F.col("a"))).drop("_t", "_all", "a", "b")


def cut_at_times(samples: DataFrame, cuts: DataFrame, keys=KEYS, ts: str = "t") -> DataFrame:
    """136: samples with the number of cuts at or before them as segment, by one sort of both."""
    both = samples.select(*keys, ts, "value", F.lit(0).alias("_cut")).unionByName(cuts.select(*keys, ts, F.lit(None).cast("double").alias("value"), F.lit(1).alias("_cut")))
    w = Window.partitionBy(*keys).orderBy(ts, F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("segment", F.sum("_cut").over(w)).where("_cut = 0").drop("_cut")


def trim_at_gaps(df: DataFrame, gap: float, least: int = 12, keys=KEYS, ts: str = "t") -> DataFrame:
    """137: edges between the first and the last gap; signals with fewer than ``least`` go."""
    w = _w(keys, ts)
    step = df.withColumn("_gap", (F.col(ts) - F.lag(ts).over(w)) > gap)
    lim = step.groupBy(*keys).agg(F.min(F.when(F.col("_gap"), F.col(ts))).alias("_a"), F.max(F.when(F.col("_gap"), F.col(ts))).alias("_b"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(lim, list(keys)).where((F.col(ts) >= F.col("_a")) & (F.col(ts) < F.col("_b"))).drop("_a", "_b", "_n")


def offline_attributes(df: DataFrame, correction_us: float = 20.0) -> DataFrame:
    """138: power in microwatts, duration in microseconds, energy in picojoules, and transition energy over the states around it."""
    transition = F.col("isa") == "transition"
    us = F.col("duration_s") * 1e6 - F.when(transition, correction_us).otherwise(0.0)
    uw = F.col("power_w") * 1e6
    out = df.withColumns({"power": uw, "duration": us, "energy": uw * us})
    return out.withColumns({"rel_energy_prev": F.when(transition, (F.col("power") - F.col("prev_power")) * F.col("duration")), "rel_energy_next": F.when(transition, (F.col("power") - F.col("next_power")) * F.col("duration"))})


def traces_to_aggregate(trace: DataFrame, ignore_runs: DataFrame | None = None) -> DataFrame:
    """139: observations of traces, without UNINITIALIZED elements and ignored runs; attributes by kind of element."""
    rows = trace.where("name <> 'UNINITIALIZED'")
    if ignore_runs is not None:
        rows = rows.join(ignore_runs, ["trace_id", "seq"], "left_anti")
    is_transition = F.col("isa") == "transition"
    return rows.withColumns({c: F.when(is_transition, F.col(c)) for c in ("energy", "rel_energy_prev", "rel_energy_next", "timeout") if c in rows.columns})


def concat_traces(a: DataFrame, b: DataFrame) -> DataFrame:
    """140: traces of two inputs under new numbers, with the old ones kept. Numbers are places within ranges of ids, so that no task sorts all of them."""
    from gaugework.operators.assess import place_in_group

    both = a.select("*", F.lit(0).alias("_src")).unionByName(b.select("*", F.lit(1).alias("_src")), allowMissingColumns=True)
    first = a.select(F.count_distinct("trace_id").alias("_first"))
    number = place_in_group(both.select("_src", "trace_id").distinct(), ["_src"], "trace_id").crossJoin(F.broadcast(first))
    number = number.select("_src", "trace_id", (F.col("place") + 1 + F.col("_src") * F.col("_first")).cast("long").alias("new_id"))
    return both.join(number, ["_src", "trace_id"]).withColumnRenamed("trace_id", "orig_id").withColumnRenamed("new_id", "trace_id").drop("_src")


def normalise(df: DataFrame, keys=KEYS, top: float = 25.0) -> DataFrame:
    """141: values scaled so that the largest magnitude is ``top``."""
    return df.withColumn("value", F.col("value") / F.max(F.abs("value")).over(Window.partitionBy(*keys)) * top)


def up_sample(df: DataFrame, s: int, keys=KEYS, order: str = "i") -> DataFrame:
    """142: s samples for one, on the line to the next sample (the last is held)."""
    rows = df.withColumn("_next", F.coalesce(F.lead("value").over(_w(keys, order)), F.col("value")))
    return rows.select(*keys, order, "value", "_next", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("_k")).select(*keys, (F.col(order) * s + F.col("_k")).alias(order), (F.col("value") + (F.col("_next") - F.col("value")) * F.col("_k") / s).alias("value"))


def down_sample(df: DataFrame, s: int, keys=KEYS, order: str = "i") -> DataFrame:
    """142: means of blocks of s; the last block is filled up with the last sample."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_m"), F.max_by("value", order).alias("_l"))
    blocks = df.groupBy(*keys, F.floor(F.col(order) / s).alias("block")).agg(F.sum("value").alias("_s"), F.count("*").alias("_n"))
    return blocks.join(last, list(keys)).select(*keys, F.col("block").alias(order), ((F.col("_s") + (s - F.col("_n")) * F.col("_l")) / s).alias("value"))


def needs_refinement(df: DataFrame, group=("name",), keys=KEYS, order: str = "i", edge: int = 5, limit: float = 200.0, share: float = 0.3, least: int = 30) -> DataFrame:
    """143: groups of which enough signals have a far tail: median to 1st, or 99th percentile to median."""
    k = [*group, *keys]
    span = Window.partitionBy(*k)
    inner = df.withColumns({"_a": F.min(order).over(span), "_b": F.max(order).over(span)}).where((F.col(order) >= F.col("_a") + edge) & (F.col(order) <= F.col("_b") - edge))
    q = inner.groupBy(*k).agg(F.percentile("value", [0.01, 0.5, 0.99]).alias("q"))
    far = (F.col("q")[1] - F.col("q")[0] > limit) | (F.col("q")[2] - F.col("q")[1] > limit)
    return q.groupBy(*group).agg(F.count("*").alias("signals"), F.avg(far.cast("double")).alias("share")).withColumn("refine", (F.col("signals") >= least) & (F.col("share") > share))


def costs_to(values: np.ndarray, end: int) -> np.ndarray:
    """145: for each start s the sum of absolute deviations of values[s:end] from their median, in one walk back from ``end``.

    Two heaps hold the lower and the upper half of the values met so far.
    """
    low: list[float] = []
    high: list[float] = []
    below = above = 0.0
    out = np.empty(end)
    for s in range(end - 1, -1, -1):
        v = float(values[s])
        if low and v > -low[0]:
            heapq.heappush(high, v)
            above += v
        else:
            heapq.heappush(low, -v)
            below += v
        if len(low) > len(high) + 1:
            v = -heapq.heappop(low)
            heapq.heappush(high, v)
            below, above = below - v, above + v
        elif len(high) > len(low):
            v = heapq.heappop(high)
            heapq.heappush(low, -v)
            below, above = below + v, above - v
        out[s] = above - below - (low[0] if len(low) > len(high) else 0.0)
    return np.maximum(out, 0.0)


class Deviations:
    """145: sums of absolute deviations from the median of any stretches of one signal, many at a time.

    Ranks of values are kept bit by bit, highest first, each level stably parted by its bit, with running counts and sums of
    the lower side; a stretch's median, and the sum of what is below it, then take one step a bit. Memory is the signal's
    length times the bits of its number of different values.
    """

    def __init__(self, values: np.ndarray):
        self.centre = float(np.median(values))
        v = np.asarray(values, float) - self.centre
        self.grid, rank = np.unique(v, return_inverse=True)
        self.sums = np.concatenate([[0.0], np.cumsum(v)])
        self.levels = []
        for bit in reversed(range(max(1, int(len(self.grid) - 1).bit_length()))):
            low = (rank >> bit & 1) == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(low)]), np.concatenate([[0.0], np.cumsum(np.where(low, v, 0.0))]), int(low.sum())))
            order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
            rank, v = rank[order], v[order]

    def of(self, begin: np.ndarray, end: int) -> np.ndarray:
        """The deviations of ``values[b:end]`` for every ``b``."""
        a, z = begin.astype(np.int64), np.full(len(begin), end, np.int64)
        size = z - a
        total = self.sums[z] - self.sums[a]
        k = (size - 1) // 2
        below, left, at = np.zeros(len(a)), k.copy(), np.zeros(len(a), np.int64)
        for bit, count, sums, zeros in self.levels:
            ca, cz = count[a], count[z]
            up = left >= cz - ca
            below += np.where(up, sums[z] - sums[a], 0.0)
            left -= np.where(up, cz - ca, 0)
            at += up.astype(np.int64) << bit
            a, z = np.where(up, zeros + a - ca, ca), np.where(up, zeros + z - cz, cz)
        middle = self.grid[at]
        below += left * middle
        return np.maximum(total - 2 * below + middle * (2 * k - size), 0.0)


def changes_by_penalty(values: np.ndarray, penalties, min_distance: int = 5, jump: int = 1) -> list[list[int]]:
    """145: for each penalty the starts of new stretches of least absolute deviation, all penalties in one dynamic programme.

    Stretches have ``min_distance`` samples at least and start at multiples of ``jump``; of equal totals the earliest
    start counts. A start is given up, for ends ``min_distance`` further on, once it costs more than a change there at all
    penalties: parting a stretch never costs more, so that it can be no part of a best path any more. Time then grows with
    the signal's length times the stretches' lengths, memory with the length.
    """
    n, pen = len(values), np.asarray(penalties, float)
    ends = [*range(max(1, -(-min_distance // jump)) * jump, n - min_distance + 1, jump), n]
    starts = np.array([0, *ends[:-1]])
    costs = Deviations(np.asarray(values, float))
    slack = 1e-9 * (1.0 + float(np.abs(np.asarray(values, float) - costs.centre).max()))
    best = np.full((len(starts) + 1, len(pen)), np.inf)
    best[0] = -pen
    came = np.zeros((len(starts) + 1, len(pen)), int)
    alive, ready, waiting = np.zeros(1, np.int64), 1, []
    for i, t in enumerate(ends, 1):
        upto = min(int(np.searchsorted(starts, t - min_distance, side="right")), i) if t >= min_distance else 1
        if upto > ready:
            alive, ready = np.concatenate([alive, np.arange(ready, upto)]), upto
        while waiting and waiting[0][0] <= t:
            gone = waiting.pop(0)[1]
            alive = alive[~np.isin(alive, gone, assume_unique=True)]
        total = best[alive] + costs.of(starts[alive], t)[:, None]
        least = total.min(axis=0)
        came[i] = alive[(total <= least + slack).argmax(axis=0)]
        best[i] = least + pen
        gone = alive[(total > best[i] + 2 * slack).all(axis=1)] if i < len(ends) else ()
        if len(gone):
            waiting.append((t + min_distance, gone))
    out = []
    for j in range(len(pen)):
        at, i = [], int(came[len(ends), j])
        while i:
            at.append(int(starts[i]))
            i = int(came[i, j])
        out.append(at[::-1])
    return out


def change_points(values: np.ndarray, penalty: float, min_distance: int = 5, jump: int = 1) -> list[int]:
    """145: change points of one signal at one penalty."""
    return changes_by_penalty(np.asarray(values, float), [penalty], min_distance, jump)[0] if len(values) else []


def fixed_change_points(values: np.ndarray, count: int, min_distance: int = 5) -> list[int]:
    """145: the best ``count`` change points, by dynamic programming over their number."""
    n = len(values)
    costs = {t: costs_to(values, t) for t in range(min_distance, n + 1)}
    rows = [{t: (costs[t][0], ()) for t in costs}]
    for _ in range(count):
        row = {}
        for t in costs:
            cand = [(p[0] + costs[t][s], (*p[1], s)) for s, p in rows[-1].items() if t - s >= min_distance]
            if cand:
                row[t] = min(cand)
        rows.append(row)
    return list(rows[-1].get(n, (0, ()))[1])


#: 145: signals of up to so many samples are solved together, as arrays; a chunk of them holds about ``CHUNK`` numbers.
SHORT, CHUNK = 192, 400_000


def _stretch_costs(values: np.ndarray, least: int, whole: set) -> np.ndarray:
    """145: (signal, end, start): deviations from the median of all stretches of ``least`` samples or more, or of a ``whole`` signal's length, of signals of one width."""
    many, n = values.shape
    out = np.full((many, n + 1, n + 1), np.inf)
    for size in range(1, n + 1):
        if size >= least or size in whole:
            x = np.sort(np.lib.stride_tricks.sliding_window_view(values, size, axis=1), axis=2)
            half, at = size // 2, np.arange(n - size + 1)
            out[:, at + size, at] = x[:, :, size - half :].sum(axis=2) - x[:, :, :half].sum(axis=2)
    return out


def changes_of_many(series: list[np.ndarray], penalties, min_distance: int = 5, jump: int = 1) -> list[list[tuple[list[int], int, int]]]:
    """145: what ``changes_by_penalty`` finds for each of many signals, as runs: starts of new stretches, and the first and last
    place of the neighbouring penalties that share them.

    Short signals of like length share one dynamic programme over arrays; long ones are solved one by one.
    """
    pen, out = np.asarray(penalties, float), [[] for _ in series]
    sizes = np.array([len(v) for v in series], np.int64)
    order = np.argsort(sizes, kind="stable")
    short = order[sizes[order] <= SHORT]
    begin = 0
    while begin < len(short):
        end = begin + 1
        while end < len(short) and (end + 1 - begin) * int(sizes[short[end]]) * (int(sizes[short[end]]) + len(pen)) <= CHUNK:
            end += 1
        for i, runs in zip(short[begin:end], _together([np.asarray(series[i], float) for i in short[begin:end]], pen, min_distance, jump), strict=True):
            out[i] = runs
        begin = end
    for i in order[sizes[order] > SHORT]:
        found = changes_by_penalty(np.asarray(series[i], float), pen, min_distance, jump)
        firsts = [j for j in range(len(pen)) if j == 0 or found[j] != found[j - 1]]
        out[i] = [(found[a], a, b - 1) for a, b in zip(firsts, [*firsts[1:], len(pen)], strict=True)]
    return out


def _together(chunk: list[np.ndarray], pen: np.ndarray, min_distance: int, jump: int) -> list[list[tuple[list[int], int, int]]]:
    """The programme of ``changes_by_penalty`` for a few short signals at once: what follows a signal's end is padding that no stretch of it holds."""
    sizes = np.array([len(v) for v in chunk])
    n, many = int(sizes.max(initial=0)), len(chunk)
    values = np.zeros((many, n))
    for i, v in enumerate(chunk):
        values[i, : len(v)] = v
    slack = np.array([1e-9 * (1.0 + float(np.abs(v - np.median(v)).max())) if len(v) else 0.0 for v in chunk])
    costs = _stretch_costs(values, min_distance, set(sizes.tolist()))
    starts = np.array([0, *range(max(1, -(-min_distance // jump)) * jump, n - min_distance + 1, jump)])
    best = np.full((many, len(pen), len(starts)), np.inf)
    best[:, :, 0] = -pen
    came, last = np.zeros((many, n + 1, len(pen)), np.int64), set(sizes.tolist())
    place = {int(s): i for i, s in enumerate(starts)}
    for t in range(1, n + 1):
        if t in place or t in last:
            upto = max(1, int(np.searchsorted(starts, t - min_distance, side="right")))
            total = best[:, :, :upto] + costs[:, t][:, starts[:upto]][:, None]
            least = total.min(axis=2)
            came[:, t] = starts[(total <= (least + slack[:, None])[:, :, None]).argmax(axis=2)]
            if t in place:
                best[:, :, place[t]] = least + pen
    at, steps, row, column = np.repeat(sizes[:, None], len(pen), axis=1), [], np.arange(many)[:, None], np.arange(len(pen))[None, :]
    while True:
        at = came[row, at, column]
        if not at.any():
            break
        steps.append(at)
    path = np.stack(steps[::-1], axis=2) if steps else np.zeros((many, len(pen), 0), np.int64)
    new = np.concatenate([np.ones((many, 1), bool), (path[:, 1:] != path[:, :-1]).any(axis=2)], axis=1)
    out = []
    for i in range(many):
        firsts = np.flatnonzero(new[i]).tolist()
        out.append([([c for c in path[i, a].tolist() if c], a, b - 1) for a, b in zip(firsts, [*firsts[1:], len(pen)], strict=True)])
    return out


def _with_runs(penalties, min_distance: int, jump: int):
    """Batches with ``found`` for their ``samples``."""
    pen = np.asarray(penalties, float)

    def run(batches):
        for batch in batches:
            samples = batch.column("samples")
            ends = np.cumsum(samples.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            values = samples.flatten().field("value").to_numpy(zero_copy_only=False)
            runs = changes_of_many(np.split(values, ends[:-1]) if len(ends) else [], penalties, min_distance, jump)
            flat = [r for one in runs for r in one]
            changes = pa.ListArray.from_arrays(np.cumsum([0, *(len(r[0]) for r in flat)]).astype(np.int32), pa.array([c for r in flat for c in r[0]], pa.int64()))
            pens = pa.ListArray.from_arrays(np.cumsum([0, *(r[2] - r[1] + 1 for r in flat)]).astype(np.int32), pa.array(np.concatenate([pen[:0], *(pen[r[1] : r[2] + 1] for r in flat)])))
            found = pa.ListArray.from_arrays(np.cumsum([0, *map(len, runs)]).astype(np.int32), pa.StructArray.from_arrays([changes, pens], ["changes", "penalties"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "found"])

    return run


def detect_runs(df: DataFrame, penalties, keys=KEYS, order: str = "i", min_distance: int = 5, jump: int = 1) -> DataFrame:
    """145: a row for each signal: keys, its ``samples`` in order, and ``found``: its change points, each with the penalties that
    give them. What is worked out from both needs no further shuffle. A signal goes to its worker once."""
    grid = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col("value").cast("double").alias("value")))).alias("samples"))
    one = T.StructType([T.StructField("changes", T.ArrayType(T.LongType())), T.StructField("penalties", T.ArrayType(T.DoubleType()))])
    shape = T.StructType([*grid.schema.fields, T.StructField("found", T.ArrayType(one))])
    return grid.mapInArrow(_with_runs([float(p) for p in penalties], min_distance, jump), shape)


def detect_changes(df: DataFrame, penalties, keys=KEYS, order: str = "i", min_distance: int = 5, jump: int = 1) -> DataFrame:
    """145: change points of every signal at every penalty: a row for each (signal, penalty)."""
    each = detect_runs(df, penalties, keys, order, min_distance, jump).select(*keys, F.explode("found").alias("f"))
    return each.select(*keys, F.explode("f.penalties").alias("penalty"), F.col("f.changes").alias("changes"))


def change_totals(runs: DataFrame, keys=KEYS) -> DataFrame:
    """145: what the stretches of each signal and penalty of ``detect_runs`` cost, worked out again from the samples: their
    deviations, and the penalties of the changes. Rows of a signal stay where they are."""
    each = runs.select(*keys, F.transform("samples", lambda x: x["value"]).alias("v"), F.explode("found").alias("f"))
    each = each.withColumn("b", F.concat(F.array(F.lit(0).cast("long")), "f.changes", F.array(F.size("v").cast("long"))))
    part = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda j: F.array_sort(F.slice("v", (F.get("b", j - 1) + 1).cast("int"), (F.get("b", j) - F.get("b", j - 1)).cast("int"))))
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    both = F.transform(part, lambda x: F.named_struct(F.lit("x"), x, F.lit("m"), middle(x)))
    cost = F.aggregate(both, F.lit(0.0), lambda a, p: a + F.aggregate(p["x"], F.lit(0.0), lambda c, y: c + F.abs(y - p["m"])))
    each = each.select(*keys, cost.alias("cost"), F.size("f.changes").alias("k"), F.explode("f.penalties").alias("penalty"))
    return each.select(*keys, "penalty", (F.col("cost") + F.col("k") * F.col("penalty")).alias("total"), (F.col("k") + 1).cast("long").alias("parts"))


def plateau_penalty(found: DataFrame, keys=KEYS) -> DataFrame:
    """146: the middle of the first longest run of penalties with equally many change points."""
    w = _w(keys, "penalty")
    n = found.withColumn("_n", F.size("changes"))
    runs = n.withColumn("_new", F.coalesce(F.col("_n") != F.lag("_n").over(w), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    lengths = runs.groupBy(*keys, "_run").agg(F.count("*").alias("length"), F.sort_array(F.collect_list("penalty")).alias("p"), F.first("_n").alias("n_changes"))
    best = lengths.groupBy(*keys).agg(F.max(F.struct("length", (-F.col("_run")).alias("r"), "p", "n_changes")).alias("b"))
    return best.select(*keys, F.col("b.p")[F.floor((F.col("b.length") - 1) / 2).cast("int")].alias("penalty"), F.col("b.n_changes").alias("n_changes"))


def substates(df: DataFrame, chosen: DataFrame, group=("name",), keys=KEYS, order: str = "i") -> DataFrame:
    """147: mean, deviation and duration of the stretches between changes, for signals with the group's usual number of changes."""
    usual = chosen.groupBy(*group).agg(F.mode(F.size("changes")).alias("_usual"))
    good = chosen.join(usual, list(group)).where(F.size("changes") == F.col("_usual")).select(*group, *keys, "changes")
    rows = df.join(good, [*group, *keys]).withColumn("substate", F.size(F.filter("changes", lambda c: c <= F.col(order))))
    return rows.groupBy(*group, *keys, "substate").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("duration"))


def ward(x: np.ndarray, limit: float) -> np.ndarray:
    """Labels of agglomerative clusters: merge the cheapest pair by Ward's distance while it is below ``limit``."""
    groups = [([i], row.astype(float)) for i, row in enumerate(np.atleast_2d(x))]
    while len(groups) > 1:
        best = min((np.sqrt(2 * len(a[0]) * len(b[0]) / (len(a[0]) + len(b[0]))) * np.linalg.norm(a[1] - b[1]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= limit:
            break
        _, i, j = best
        (ia, ca), (ib, cb) = groups[i], groups[j]
        groups[i] = (ia + ib, (ca * len(ia) + cb * len(ib)) / (len(ia) + len(ib)))
        del groups[j]
    out = np.zeros(len(x), int)
    for k, (rows, _) in enumerate(groups):
        out[rows] = k
    return out


def cluster_substates(lut: DataFrame, group: str = "name", durations: str = "duration", powers: str = "power", limits=(50.0, 500.0)) -> DataFrame:
    """148: configurations of each state (a row each, few) clustered by durations, then within by powers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
        outer = ward(pdf[[durations]].to_numpy(), limits[0])
        label = np.zeros(len(pdf), int)
        for k in np.unique(outer):
            label[outer == k] = ward(pdf.loc[outer == k, [powers]].to_numpy(), limits[1])
        return pdf.assign(cluster=(pd.Series(outer) * 1000 + label).rank(method="dense").astype(int))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lut.schema)
    return lut.groupBy(group).applyInPandas(run, f"{shape}, cluster bigint")


def drift_candidates(df: DataFrame, events: DataFrame, penalties, window: float, keys=KEYS, ts: str = "t") -> DataFrame:
    """149: change points of the samples around each expected event, with votes over penalties."""
    from gaugework.operators.lookup import interval_join

    spans = events.select(*keys, "event", F.col(ts).alias("expected"), (F.col(ts) - window).alias("_lo"), (F.col(ts) + window).alias("_hi"))
    near = interval_join(df.select(*keys, ts, "value"), spans, keys, ts, "_lo", "_hi", 2 * window)
    k = [*keys, "event", "expected"]
    runs = detect_runs(near, penalties, k, ts).select(*k, "samples", F.explode("found").alias("f"))
    each = runs.select(*k, "samples", F.size("f.penalties").alias("n"), F.explode("f.changes").alias("i"))
    at = F.get("samples", F.col("i").cast("int"))[ts].alias("at")
    # A window's runs lie in one row, so that its votes are summed without a shuffle of its samples.
    votes = each.select(*k, "i", at, "n").groupBy(*k, "i", "at").agg(F.sum("n").alias("votes"))
    return votes.select(*k, (F.col("at") - F.col("expected")).alias("drift"), "votes")


def greedy_drift(candidates: DataFrame, keys=KEYS, limit: float = 0.5e-3) -> DataFrame:
    """151: each event takes the candidate nearest to the running drift if within ``limit``; a fold over events, in the JVM."""
    per = candidates.groupBy(*keys, "event").agg(F.collect_list("drift").alias("c"))
    runs = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event", "c"))).alias("e"))
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast("array<struct<event:bigint,drift:double>>").alias("out"))

    def step(s, x):
        best = F.array_min(F.transform(x["c"], lambda v: F.struct(F.abs(v - s["d"]).alias("far"), v.alias("v"))))
        d = F.when(best["far"] < limit, best["v"]).otherwise(s["d"])
        return F.struct(d.alias("d"), F.array_append(s["out"], F.struct(x["event"].cast("bigint").alias("event"), d.alias("drift"))).alias("out"))

    return runs.select(*keys, F.explode(F.aggregate("e", start, step)["out"]).alias("x")).select(*keys, "x.event", "x.drift")


def drift_from_states(changes: DataFrame, events: DataFrame, window: float, keys=KEYS, ts: str = "t") -> DataFrame:
    """152: exactly two state changes in an event's window give a new drift (their mean); else the last one holds."""
    from gaugework.operators.lookup import interval_join

    spans = events.select(*keys, "event", F.col(ts).alias("expected"), (F.col(ts) - window).alias("_lo"), (F.col(ts) + window).alias("_hi"))
    near = interval_join(changes.select(*keys, ts), spans, keys, ts, "_lo", "_hi", 2 * window).groupBy(*keys, "event").agg(F.count("*").alias("_n"), F.avg(F.col(ts) - F.col("expected")).alias("_d"))
    all_events = events.select(*keys, "event").join(near.where("_n = 2"), [*keys, "event"], "left")
    return all_events.select(*keys, "event", F.coalesce(F.last("_d", ignorenulls=True).over(_w(keys, "event")), F.lit(0.0)).alias("drift"))


def peaks(df: DataFrame, threshold: Column | float | None = None, dt: float = 1.0, keys=KEYS, order: str = "i") -> DataFrame:
    """165: runs at or over the threshold (the mean by default): duration, energy, and energy over the baseline.

    A run that lasts to the end of the signal is unfinished and left out.
    """
    whole = Window.partitionBy(*keys)
    rows = df.withColumn("_t", F.avg("value").over(whole) if threshold is None else (threshold if isinstance(threshold, Column) else F.lit(threshold)))
    base = F.avg(F.when(F.col("value") < F.col("_t"), F.col("value"))).over(whole)
    rows = rows.withColumns({"_base": base, "_end": F.max(order).over(whole)})
    extra = rows.groupBy(*keys).agg(F.first("_base").alias("baseline"), F.first("_end").alias("_end"))
    runs = islands(rows, F.col("value") >= F.col("_t"), keys, order).where("on").join(extra, list(keys)).where(F.col("end") < F.col("_end"))
    return runs.select(*keys, "start", "n", (F.col("n") * dt).alias("duration"), (F.col("total") * dt).alias("energy"), ((F.col("total") - F.col("n") * F.col("baseline")) * dt).alias("energy_over_baseline"))


def threshold_for_peaks(df: DataFrame, grid, wanted: int, keys=KEYS, order: str = "i") -> DataFrame:
    """166: the first threshold of a grid that gives just ``wanted`` peaks, all thresholds in one job."""
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    k = [*keys, "threshold"]
    n = islands(each, F.col("value") >= F.col("threshold"), k, order).where("on").groupBy(*k).agg(F.count("*").alias("n"))
    return n.where(F.col("n") == wanted).groupBy(*keys).agg(F.min("threshold").alias("threshold"))


def channel_summary(df: DataFrame, keys=KEYS, order: str = "i") -> DataFrame:
    """167: range and mean of each channel, means above and below mid-range, and the mean duration of high runs."""
    whole = Window.partitionBy(*keys)
    rows = df.withColumn("border", (F.min("value").over(whole) + F.max("value").over(whole)) / 2)
    s = rows.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.avg(F.when(F.col("value") > F.col("border"), F.col("value"))).alias("high"), F.avg(F.when(F.col("value") <= F.col("border"), F.col("value"))).alias("low"))
    runs = islands(rows, F.col("value") > F.col("border"), keys, order).where("on").groupBy(*keys).agg(F.avg("n").alias("high_run"))
    return s.join(runs, list(keys), "left")


def compare_steps(a: DataFrame, b: DataFrame, start: float, limit: float, hold: int, keys=KEYS, order: str = "i") -> DataFrame:
    """168: two instruments aligned on their first sample over ``start``; steps of the first, and each step's mean on both."""

    def aligned(df):
        first = df.where(F.col("value") > start).groupBy(*keys).agg(F.min(order).alias("_f"))
        return df.join(first, list(keys)).where(F.col(order) >= F.col("_f")).select(*keys, (F.col(order) - F.col("_f")).alias("k"), "value")

    x, y = aligned(a), aligned(b)
    w = _w(keys, "k")
    steep = F.abs(F.col("value") - F.lag("value").over(w)) > limit
    stepped = x.withColumn("_s", F.when(steep, F.col("k")))
    stepped = stepped.withColumn("_prev", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_s").isNotNull() & (F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") > hold))
    seg = stepped.withColumn("step", F.sum(new.cast("int")).over(w)).select(*keys, "k", "step", F.col("value").alias("va"))
    return seg.join(y.select(*keys, "k", F.col("value").alias("vb")), [*keys, "k"]).groupBy(*keys, "step").agg(F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.count("*").alias("n"))
