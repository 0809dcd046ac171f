"""Accumulating state by conversation: turns arrive in any order, in any number of
batches, some of them twice; what is known of a conversation is put out after every
batch that adds to it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


RESULT = "conv_id long, n_turns long, n_chars long, first_turn long, last_turn long, roles string, closed boolean"


def _turns(idle: int | None):
    """State: the turns seen, by number, with role and length; a turn that arrives
    again replaces itself, so that a replay changes nothing. With ``idle``, a timer
    closes what had no new turn for so many milliseconds: its last row says so, and
    its state goes."""

    def row(key: tuple, held: dict, closed: bool) -> pd.DataFrame:
        numbers = sorted(map(int, held))
        roles = ",".join(sorted({r for r, _ in held.values() if r is not None}))
        return pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(held)], "n_chars": [sum(n for _, n in held.values())], "first_turn": [numbers[0]], "last_turn": [numbers[-1]], "roles": [roles], "closed": [closed]})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield row(key, held, True)
            return
        new = dict(held)
        for part in parts:
            for turn, role, n in zip(part["turn"], part["role"], part["n_chars"], strict=True):
                new[str(int(turn))] = [None if pd.isna(role) else str(role), int(n)]
        if idle:
            state.setTimeoutDuration(idle)
        if new != held:
            state.update((json.dumps(new),))
            yield row(key, new, False)

    return step


def accumulated(turns: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of (conv_id, turn, role, text) as a stream of ``RESULT``: a row for a
    conversation whenever a batch adds to it. Null roles are no role, null texts have
    no characters; rows without a conversation or turn number are left out."""
    rows = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return rows.groupBy("conv_id").applyInPandasWithState(_turns(idle), RESULT, "turns string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def started(turns: DataFrame, out: str, checkpoint: str, idle: int | None = None, **trigger):
    """The running stream, whose rows are appended to ``out`` by batch; a batch that is
    run again replaces its own. State and progress are in the checkpoint. A stream with
    timers never has nothing to do, so ``idle`` goes with a ``processingTime`` trigger."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = accumulated(turns, idle).writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replay(turns: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the stream over what is new, to its end."""
    started(turns, out, checkpoint, availableNow=True).awaitTermination()


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each conversation, of rows with their batch."""
    best = rows.groupBy("conv_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("conv_id", "batch")]), "batch").alias("r"))
    return best.select("conv_id", "r.*")
