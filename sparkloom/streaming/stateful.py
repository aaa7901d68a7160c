"""Streaming forms of the sequential operators. Batch and stream share their state classes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom import config


def stream_first_wins(rows: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key of a stream; with ``time``, state older than the watermark is dropped."""
    if time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


ABORT = "run string, seq long, barren long, saved long"
_STATE = "barren long, saved long, aborted boolean"


def stream_abort(outcomes: DataFrame, after: int = config.ABORT_AFTER, ratio: int = config.ABORT_RATIO) -> DataFrame:
    """Runs of a stream ``run, seq, outcome`` that stop, once each, at the barren page that makes them stop.

    The tallies of a run are its state; the rows of a micro-batch are taken in ``seq`` order.
    """

    def apply(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        barren, saved, aborted = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, outcome in zip(rows["seq"], rows["outcome"]):
            if aborted:
                break
            saved += outcome == "saved"
            if outcome == "barren":
                barren += 1
                if barren >= after and saved * ratio < barren:
                    aborted = True
                    out.append((key[0], int(seq), barren, saved))
        state.update((int(barren), int(saved), bool(aborted)))
        yield pd.DataFrame(out, columns=["run", "seq", "barren", "saved"])

    return outcomes.groupBy("run").applyInPandasWithState(apply, ABORT, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_outcome_counts(outcomes: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Outcomes of a stream by window of event time; rows later than the watermark are left out."""
    return outcomes.withWatermark(time, delay).groupBy(F.window(time, window), "outcome").agg(F.count("*").alias("n"))
