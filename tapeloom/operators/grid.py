"""Irregular readings onto a regular grid, gaps marked and filled by singular-spectrum imputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.times import floor_div, micros

DAY_S = 86_400
#: Trajectory length, singular vectors kept, and when the iteration ends.
WINDOW, RANK, TOLERANCE = 16, 3, 1e-4
#: Rounds after which a series that still moves is given up and marked as not converged.
ITERATIONS = 10_000
#: An extrapolation beyond this many times the series' spread is not tried.
WILD = 1e6
#: Series, of about one length, that are decomposed together.
STACK = 512

SERIES = "source string, slot_epoch bigint, n_readings bigint, value double, is_missing boolean, is_imputed boolean, converged boolean"


def ssa_fill(x: np.ndarray, seen: np.ndarray, window: int = WINDOW, rank: int = RANK, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> np.ndarray:
    """The filled series of ``ssa_impute``."""
    return ssa_impute(x, seen, window, rank, tolerance, iterations)[0]


def ssa_impute(x: np.ndarray, seen: np.ndarray, window: int = WINDOW, rank: int = RANK, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fill the unseen entries of a stack of series (one per row) by iterative singular-spectrum imputation.

    Each round embeds the series as Hankel trajectories, projects them on the leading singular
    vectors, averages the anti-diagonals and puts the result in the unseen places only, until
    these move by less than ``tolerance`` of the series' spread. Every third round starts from a
    squared extrapolation of the two before (SQUAREM), which counts only where it leaves no more
    outside the leading vectors than they did. A series without any seen value stays NaN; one of
    under three slots or with one or two seen values has straight lines. Where ``lengths`` are
    given, a row's slots beyond its length do not belong to it; its trajectories are padded with
    zeros, which leave the leading vectors as they are.

    Also returned, by series: 1 where the tolerance was met, 0 where ``iterations`` rounds did not
    meet it, -1 where no round was needed or possible.
    """
    out = np.where(seen, x, np.nan)
    rows, n = out.shape
    lengths = np.full(rows, n) if lengths is None else lengths
    state = np.full(rows, -1)
    at = np.arange(n)
    inside = at < lengths[:, None]
    some = seen.any(axis=1)
    for i in np.flatnonzero(some):  # the start: straight lines between neighbours
        out[i, : lengths[i]] = np.interp(at[: lengths[i]], at[seen[i]], x[i, seen[i]])
    live = np.flatnonzero((lengths > 2) & (inside & ~seen).any(axis=1) & (seen.sum(axis=1) > 2))
    if not len(live):
        return out, state
    own, m = inside[live], lengths[live][:, None]
    centre = np.where(own, out[live], 0).sum(axis=1, keepdims=True) / m
    y, hole = np.where(own, out[live] - centre, 0), own & ~seen[live]
    spread = np.maximum(np.sqrt((y**2).sum(axis=1) / m[:, 0]), 1e-12)
    sizes = np.maximum(2, np.minimum(window, m // 2))
    weight = np.maximum(np.minimum(np.minimum(at + 1, m - at), np.minimum(sizes, m - sizes + 1)), 1).astype(float)
    size = int(sizes.max())
    keep, spans = min(rank, size), n - size + 1
    within = (np.arange(size) < sizes)[:, :, None] & (np.arange(spans) < m - sizes + 1)[:, None, :]

    def step(z: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round for some series, and what of them lay outside the leading vectors before it."""
        hankel = np.lib.stride_tricks.sliding_window_view(z, spans, axis=1) * within[part]
        values, vectors = np.linalg.eigh(hankel @ hankel.transpose(0, 2, 1))
        lead = vectors[:, :, -keep:]
        flat = lead @ (lead.transpose(0, 2, 1) @ hankel)
        back = np.zeros_like(z)
        for k in range(size):
            back[:, k : k + spans] += flat[:, k]
        return np.where(hole[part], back / weight[part], z), values[:, :-keep].sum(axis=1)

    state[live] = 0
    going = np.arange(len(live))
    before = last = y
    for r in range(iterations):
        third = r % 3 == 2
        z = last
        if third:
            one, two = before[1] - before[0], last - 2 * before[1] + before[0]
            far = np.maximum(np.sqrt((one**2).sum(axis=1) / np.maximum((two**2).sum(axis=1), 1e-300)), 1)[:, None]
            with np.errstate(over="ignore", invalid="ignore"):
                z = before[0] + 2 * far * one + far**2 * two
            tame = np.abs(z).max(axis=1) < WILD * spread[going]
            z = np.where(tame[:, None], z, last)
        new, outside = step(z, going)
        met = np.abs(new - z).max(axis=1) <= tolerance * spread[going]
        if third:
            good = outside <= limit
            new, met = np.where(good[:, None], new, last), met & good
        else:
            limit = outside
        y[going] = new
        state[live[going[met]]] = 1
        rest = ~met
        # What the next round needs of the series that go on: the start of a triple, its first round, its second.
        before = [new] if third else [*([last] if r % 3 == 0 else before), new]
        before, limit, last, going = [b[rest] for b in before], limit[rest], new[rest], going[rest]
        if not len(going):
            break
    out[live] = np.where(hole, y + centre, out[live])
    return out, state


def _fill(batches: Iterator[pa.RecordBatch], step_s: int, only_missing: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, first = batch.column("source"), batch.column("first").to_numpy(zero_copy_only=False)
        slots = batch.column("slots")
        bounds, rows = slots.offsets.to_numpy(), slots.flatten()
        slot, count = (rows.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        value = rows.field(2).to_numpy(zero_copy_only=False).astype(float)
        bounds = bounds - bounds[0]
        owner = np.repeat(np.arange(len(first)), np.diff(bounds))
        place = slot - first[owner]
        length = np.maximum.reduceat(place, bounds[:-1]) + 1 if len(first) else np.zeros(0, int)
        order = np.argsort(length, kind="stable")
        for k in range(0, len(order), STACK):
            part = order[k : k + STACK]
            n = int(length[part].max())
            index = np.full(len(first), -1)
            index[part] = np.arange(len(part))
            own = index[owner] >= 0
            x, counts = np.full((len(part), n), np.nan), np.zeros((len(part), n), np.int64)
            x[index[owner[own]], place[own]] = value[own]
            counts[index[owner[own]], place[own]] = count[own]
            filled, state = ssa_impute(x, ~np.isnan(x), lengths=length[part])
            state = np.repeat(state, n)
            missing = counts == 0
            inside = np.arange(n) < length[part][:, None]
            pick = np.flatnonzero((inside & missing if only_missing else inside).ravel())
            values = filled.ravel()[pick]
            yield pa.RecordBatch.from_arrays(
                [
                    source.take(pa.array(np.repeat(part, n)[pick])),
                    pa.array((((first[part][:, None] + np.arange(n)) * step_s).ravel())[pick]),
                    pa.array(counts.ravel()[pick]),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(missing.ravel()[pick]),
                    pa.array((np.isnan(x).ravel() & ~np.isnan(filled).ravel())[pick]),
                    pa.array(state[pick] == 1, mask=state[pick] < 0),
                ],
                names=["source", "slot_epoch", "n_readings", "value", "is_missing", "is_imputed", "converged"],
            )


def regular_series(readings: DataFrame, source: Column, ts: str, value: Column, step_s: int = 300, only_missing: bool = False) -> DataFrame:
    """A regular series per source and UTC day, from the day's first slot with a reading to its last.

    A reading is a row with source and time; a slot's value is the mean of its readings' values,
    which may be null. Columns: source, slot_epoch (the slot's start), n_readings, value,
    is_missing (no reading in the slot), is_imputed (the value is not measured; null where the
    day has no value at all), converged (whether the day's imputation met its tolerance; null
    where nothing was imputed or straight lines were). ``only_missing`` returns the marked slots alone. ``step_s`` must
    divide a day. Repeated rows count as readings; an empty table gives an empty series.

    Readings are reduced to one row per source and slot before they are shuffled, so a busy
    source weighs no more than its slots; what one task holds of a source is one day, at most
    ``86400 / step_s`` slots.
    """
    if DAY_S % step_s:
        raise ValueError("step_s must divide a day")
    slot = floor_div(micros(ts), step_s * 1_000_000)
    slotted = readings.select(source.alias("source"), slot.alias("slot"), value.cast("double").alias("value")).where("source is not null and slot is not null")
    slotted = slotted.groupBy("source", "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    day = floor_div(F.col("slot"), DAY_S // step_s)
    series = slotted.groupBy("source", day.alias("day")).agg(F.min("slot").alias("first"), F.collect_list(F.struct("slot", "n", "value")).alias("slots"))
    return series.select("source", "first", "slots").mapInArrow(lambda batches: _fill(batches, step_s, only_missing), SERIES)
