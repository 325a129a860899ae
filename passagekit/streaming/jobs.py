"""Jobs as an automaton over their events: illegal transitions are refused, retries counted, progress carried."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What may follow each state; a job begins as queued.
NEXT = {
    "": ("queued",),
    "queued": ("downloading", "processing", "failed", "needs_auth", "cancelled"),
    "downloading": ("transcribing", "done", "failed", "needs_auth", "cancelled"),
    "transcribing": ("processing", "failed", "cancelled"),
    "processing": ("done", "failed", "cancelled"),
    "failed": ("queued",),
    "needs_auth": ("queued",),
    "done": (),
    "cancelled": (),
}
#: Progress on reaching a state; a state that is told again while it lasts moves to the second.
PROGRESS = {"downloading": (10, 10), "transcribing": (25, 30), "processing": (40, 80), "done": (100, 100)}
RETRIED = ("failed", "needs_auth")

State = tuple[str, int, int]
COLUMNS = "status string, accepted boolean, state string, progress int, retries int"


def step(state: State, status: str | None) -> tuple[bool, State]:
    """Whether an event is accepted, and (state, progress, retries) after it.

    A running state may be told again; anything else that may not follow, unknown and null states too, changes nothing.
    """
    at, progress, retries = state
    if status == at and at in PROGRESS and NEXT[at]:
        return True, (at, PROGRESS[at][1], retries)
    if status not in NEXT[at]:
        return False, state
    return True, (status, PROGRESS.get(status, (0, 0))[0], retries + (at in RETRIED))


def transitions(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """Each event (job, order, status) with whether it was accepted, and the job's state, progress and retries after it.

    Events are walked in order as they stream through a task, which holds one job's state, however many events it has.
    """
    names = [job, *order]
    schema = ", ".join([*(f"{c} {events.schema[c].dataType.simpleString()}" for c in names), COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, ("", 0, 0)
        for batch in batches:
            out = []
            for own, status in zip(batch.column(0).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if own != now:
                    now, state = own, ("", 0, 0)
                ok, state = step(state, status)
                out.append((ok, *state))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, "accepted", "state", "progress", "retries"])

    return events.where(f"{job} IS NOT NULL").select(*names, "status").repartition(job).sortWithinPartitions(*names).mapInArrow(run, schema)


def stream_transitions(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("at", "event_id"), forget: int | None = None) -> DataFrame:
    """The same over a stream whose batches come in order; the state of a job is three values.

    Terminal states are kept, so that what follows them is refused; with ``forget`` a job that has ended goes so many
    milliseconds later.
    """
    names = [job, *order]
    schema = ", ".join([*(f"{c} {events.schema[c].dataType.simpleString()}" for c in names), COLUMNS])

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if forget and held.hasTimedOut:
            held.remove()
            return
        state = tuple(held.get) if held.exists else ("", 0, 0)
        new = pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")
        out = []
        for status in new["status"]:
            ok, state = step(state, status)
            out.append((ok, *state))
        held.update(state)
        if forget and not NEXT[state[0]]:
            held.setTimeoutDuration(forget)
        told = pd.DataFrame(out, columns=["accepted", "state", "progress", "retries"], index=new.index)
        yield pd.concat([new[names], new[["status"]], told], axis=1)

    return events.groupBy(job).applyInPandasWithState(run, schema, "state string, progress int, retries int", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
