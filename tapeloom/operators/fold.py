"""Folds over a key's rows in order that no aggregate can express, streamed so that no key is held in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, object], None], schema: str) -> DataFrame:
    """One row per key: the state after ``step(state, row)`` over its rows in ``order``.

    Rows are partitioned by key and sorted within partitions, and the state alone is carried from
    batch to batch. The fold of one key is serial by nature; its memory is one state.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys)
                if state is None or at != current:
                    if state is not None:
                        out.append({**dict(zip(keys, current)), **state})
                    current, state = at, start()
                step(state, row)
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([{**dict(zip(keys, current)), **state}])

    names = [c.strip().split()[0] for c in schema.split(",")]
    sorted_rows = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInPandas(lambda b: (x[names] for x in run(b)), schema)


def positions(fills: DataFrame, key: str, order: list[str], is_buy: str, qty: str, cost: str) -> DataFrame:
    """Open quantity, its average cost and the realised gain per key: (key, open_qty, avg_cost, realised, n_clamped).

    Buys move the average; sells realise against it and are clamped to what is open.
    """

    def start() -> dict:
        return {"open_qty": 0, "avg_cost": 0.0, "realised": 0.0, "n_clamped": 0}

    def step(s: dict, r) -> None:
        n, price = int(getattr(r, qty)), float(getattr(r, cost))
        if getattr(r, is_buy):
            s["avg_cost"] = (s["avg_cost"] * s["open_qty"] + price * n) / (s["open_qty"] + n) if s["open_qty"] + n else 0.0
            s["open_qty"] += n
            return
        sold = min(n, s["open_qty"])
        s["n_clamped"] += int(sold < n)
        s["realised"] += sold * (price - s["avg_cost"])
        s["open_qty"] -= sold
        if not s["open_qty"]:
            s["avg_cost"] = 0.0

    rows = fills.select(key, *order, is_buy, qty, cost).where(f"{key} is not null and {is_buy} is not null and {qty} is not null and {cost} is not null")
    return ordered_fold(rows, [key], order, start, step, f"{key} string, open_qty bigint, avg_cost double, realised double, n_clamped bigint")
