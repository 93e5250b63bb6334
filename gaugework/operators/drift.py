"""Drift of a clock along a run (inventory 150): one drift, or none at a cost, for each event, so that the steps between
drifts sum least. The drift before the first event is 0.

What a stretch of events does to a drift is a matrix over (min, +): a pair (enter, leave) has the least cost of a path whose
first drift is ``enter`` and whose last one is ``leave``; besides, all events may be skipped. Such matrices compose, so a long
run is cut into blocks: each block makes its matrix, the matrices of a run (at most ``scan.RANGES``) give the drifts at the
borders of its blocks, and each block then finds its path between the two.

A pair goes if another one, or skipping all, does the same for no more with the moves to its ends; so pairs that stay differ by
more than the price of a skip, and their number is bounded by the square of (range of drifts / ``skip``), not by events.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators import stats
from gaugework.operators.lineage import cut, written
from gaugework.operators.scan import Scan

#: Price of an event without a drift, in the unit of the drifts (s).
SKIP = 270e-6
#: Candidates of a run that one task works on, about.
BLOCK = 8192


def block_matrix(candidates, skip: float = SKIP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Enter, leave and cost of the pairs of a stretch of events that no other does as well as."""
    enter = leave = cost = np.empty(0)
    for m, xs in enumerate(candidates):
        new = [(enter, leave, cost + skip)]
        heads, at = np.unique(enter, return_inverse=True)
        for x in xs:
            reach = np.full(len(heads), np.inf)
            np.minimum.at(reach, at, cost + np.abs(leave - x))
            new.append((np.append(heads, x), np.full(len(heads) + 1, x), np.append(reach, m * skip)))
        enter, leave, cost = (np.concatenate(v) for v in zip(*new, strict=True))
        order = np.argsort(cost, kind="stable")
        enter, leave, cost = enter[order], leave[order], cost[order]
        near = np.abs(enter[:, None] - enter) + np.abs(leave[:, None] - leave)
        worse = np.triu(cost[:, None] + near <= cost, 1).any(axis=0) | ((m + 1) * skip + np.abs(enter - leave) <= cost)
        enter, leave, cost = enter[~worse], leave[~worse], cost[~worse]
    return enter, leave, cost


def _least(drift: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The states to keep, in order of cost: the cheapest of each drift, but those that another one reaches for clearly less."""
    order = np.argsort(cost, kind="stable")
    d, c = drift[order], cost[order]
    away = np.abs(d[:, None] - d)
    worse = np.triu((away == 0) | (c[:, None] + away < c - 1e-12 * (1 + c)), 1).any(axis=0)
    return order[~worse]


def borders(blocks, skip: float = SKIP) -> list[float]:
    """The drifts before the first block, between blocks and after the last one, from (events, enter, leave, cost) of each block."""
    drift, cost, back = np.zeros(1), np.zeros(1), []
    for n, enter, leave, own in blocks:
        came = np.arange(len(drift))
        all_drift, all_cost = drift, cost + n * skip
        if len(enter):
            reach = cost[:, None] + np.abs(drift[:, None] - enter) + own
            best = reach.argmin(axis=0)
            came, all_drift, all_cost = np.append(came, best), np.append(drift, leave), np.append(all_cost, reach.min(axis=0))
        keep = _least(all_drift, all_cost)
        drift, cost = all_drift[keep], all_cost[keep]
        back.append((came[keep], drift))
    out, at = [], int(cost.argmin())
    for came, d in reversed(back):
        out.append(float(d[at]))
        at = int(came[at])
    return [0.0, *reversed(out)]


def path(candidates, skip: float = SKIP, start: float = 0.0, end: float | None = None) -> list[float | None]:
    """The drift taken (or None) at each event, from ``start`` to ``end`` where that is given.

    Of paths that cost the same with the move to ``end``, one that ends there: what follows starts there and does not pay for the move.
    """
    drift, cost, back = np.array([start]), np.zeros(1), []
    for xs in candidates:
        xs = np.asarray(xs, float)
        came, taken = np.arange(len(drift)), np.zeros(len(drift) + len(xs), bool)
        taken[len(drift) :] = True
        all_drift, all_cost = np.append(drift, xs), cost + skip
        if len(xs):
            reach = cost[:, None] + np.abs(drift[:, None] - xs)
            came, all_cost = np.append(came, reach.argmin(axis=0)), np.append(all_cost, reach.min(axis=0))
        keep = _least(all_drift, all_cost)
        drift, cost = all_drift[keep], all_cost[keep]
        back.append((came[keep], drift, taken[keep]))
    if end is None:
        at = int(cost.argmin())
    elif (drift == end).any():
        at = int(np.where(drift == end, cost, np.inf).argmin())
    else:
        at = int((cost + np.abs(drift - end)).argmin())
    out = []
    for came, d, taken in reversed(back):
        out.append(float(d[at]) if taken[at] else None)
        at = int(came[at])
    return out[::-1]


def _runs(column: pa.Array):
    """For each row of an array of (event, drift), in order: its events, and the drifts of each, without nulls."""
    at, rows = column.offsets.to_numpy(), column.values
    event, drift = rows.field("event").to_numpy(zero_copy_only=False), rows.field("drift").to_numpy(zero_copy_only=False)
    for a, b in zip(at, at[1:], strict=False):
        e, x = event[a:b], drift[a:b]
        cuts = np.flatnonzero(e[1:] != e[:-1]) + 1
        # Nulls lead and NaN ends an event, so that what is left is still sorted.
        yield e[np.append(0, cuts)], [d[~np.isnan(d)] for d in np.split(x, cuts)]


def _spread(batch: pa.RecordBatch, keys, sizes) -> list[pa.Array]:
    """The keys of each row, as often as ``sizes`` says."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
    return [batch.column(k).take(at) for k in keys]


def compensate(candidates: DataFrame, keys=("signal",), skip: float = SKIP, block: int = BLOCK) -> DataFrame:
    """Keys, event, the drift in force at it, and whether it was taken there, of ``candidates`` (keys, event, drift).

    A null drift is no candidate; an event with nulls alone keeps the drift before it. Events and keys may repeat; runs of null
    keys are runs. A run of more than ``block`` candidates is the work of many tasks. A block is one row, and a task takes rows
    in batches, as there may be many short ones.
    """
    keys = list(keys)
    df = candidates.select(*keys, F.col("event").cast("bigint").alias("event"), F.col("drift").cast("double").alias("drift")).where("event is not null")
    cut_up = Scan.of(df, keys, "event", block)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    head = kinds + ", " if kinds else ""
    blocked = cut_up.blocked
    by = [*keys, "_b"] if blocked else keys
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_up.df.repartition(parts, *by) if by else cut_up.df
    blocks = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("event", "drift"))).alias("_c")).where(F.size("_c") > 0)

    def walk(batches):
        for batch in batches:
            near = [batch.column(c).to_numpy() for c in ("_start", "_end")] if blocked else None
            events, drifts, takens = [], [], []
            for i, (e, c) in enumerate(_runs(batch.column("_c"))):
                start, end = (near[0][i], near[1][i]) if near else (0.0, None)
                found = np.array(path(c, skip, start, end), float)
                taken = ~np.isnan(found)
                last = np.maximum.accumulate(np.where(taken, np.arange(len(e)), -1))
                events.append(e), drifts.append(np.where(last < 0, start, found[last])), takens.append(taken)
            if events:
                yield pa.RecordBatch.from_arrays([*_spread(batch, keys, [len(e) for e in events]), *(pa.array(np.concatenate(x)) for x in (events, drifts, takens))], names=[*keys, "event", "drift", "taken"])

    out = f"{head}event bigint, drift double, taken boolean"
    if not blocked:
        return blocks.mapInArrow(walk, out)

    def matrix(batches):
        for batch in batches:
            made = [(len(e), *block_matrix(c, skip)) for e, c in _runs(batch.column("_c"))]
            n, *pairs = zip(*made, strict=True) if made else [()] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(pa.float64())) for x in pairs)], names=[*by, "n", "enter", "leave", "cost"])

    def join_up(batches):
        for batch in batches:
            at, m = batch.column("_m").offsets.to_numpy(), batch.column("_m").values
            number, n, pairs = m.field("_b").to_numpy(), m.field("n").to_numpy(), m.field("enter")
            cuts, pairs = pairs.offsets.to_numpy(), [m.field(c).values.to_numpy() for c in ("enter", "leave", "cost")]
            ends = [borders([(n[i], *(x[cuts[i] : cuts[i + 1]] for x in pairs)) for i in range(a, b)], skip) for a, b in zip(at, at[1:], strict=False)]
            flat = lambda part: pa.array([x for e in ends for x in part(e)], pa.float64())
            yield pa.RecordBatch.from_arrays([*_spread(batch, keys, np.diff(at)), pa.array(number[at[0] : at[-1]]), flat(lambda e: e[:-1]), flat(lambda e: e[1:])], names=[*keys, "_b", "_start", "_end"])

    blocks = cut(blocks)
    each = blocks.mapInArrow(matrix, f"{head}_b int, n bigint, enter array<double>, leave array<double>, cost array<double>")
    whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "n", "enter", "leave", "cost"))).alias("_m"))
    ends = written(whole.mapInArrow(join_up, f"{head}_b int, _start double, _end double"))
    placed = blocks.alias("d").join(ends.alias("e"), stats._same(by, "d", "e")).select(*(f"d.{k}" for k in keys), "_c", "_start", "_end")
    return placed.mapInArrow(walk, out)
