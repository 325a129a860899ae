"""Answers as they stream: citations parsed across delta boundaries, content blocks, job states, repeated chunks.

Every operator takes a streaming or a batch frame, but for ``parse_stream``, whose batch form is ``functions.citations``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.citations import events, feed

EVENT = "message_id long, ord long, kind string, content string"
STATE = "messages string"
ENDED = -1  # in place of the next delta: the message is complete
BITS = 7  # 128 neighbouring messages are one group: a call for each costs far more than its deltas do


def _drained(at: int, ord_: int, held: str, waiting: dict[str, list]) -> tuple[tuple, list[tuple[str, str]]]:
    """A message after all deltas whose turn it is, and their events."""
    out = []
    while str(at) in waiting:
        delta, last, known = waiting.pop(str(at))
        new, held = feed(held, delta, set(known))
        if last:
            new, held = [*new, *events(held, set())], ""
        out += new
        at += 1
        if last:
            at, waiting = ENDED, {}
    return (at, ord_ + len(out), held, waiting), out


def parse_stream(deltas: DataFrame, forget: int | None = None, clock: str | None = None) -> DataFrame:
    """(message_id, pos, delta, last, known) -> events of each message: text, or the number of a known section.

    An end that may become a citation is held in the state until more comes; the delta marked ``last`` lets all go.
    Deltas that arrive before their turn wait; deltas that arrive again change nothing.  The state of a message that has
    ended is a mark alone; with ``forget`` it goes so many milliseconds later (for queries that never end: a query that
    takes what is there would wait for it).

    With ``clock``, a column of event times that has a watermark, ``forget`` counts in that time: the state of any message,
    ended or not, goes once the watermark has passed its latest delta by so many milliseconds, and with it what still waits
    for its turn.  So state is bounded by the messages of one such span, in a query that ends too.

    The messages of a range of 2**BITS ids lie in one group's state, each with its own time to go (``kept_messages``).
    """
    timed = bool(forget and clock)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # id -> next delta, number of events, what is held, what waits by its place, time to go
        messages = json.loads(state.get[0]) if state.exists else {}
        touched: dict[str, int] = {}
        now = state.getCurrentWatermarkMs() if timed else state.getCurrentProcessingTimeMs() if forget else 0
        for batch in [] if state.hasTimedOut else batches:
            ids = [""] * len(batch) if pd.isna(key[0]) else batch["message_id"].astype("int64").astype(str)
            times = batch["_at"] if timed else [0] * len(batch)
            for own, pos, delta, last, known, time in zip(ids, batch["pos"], batch["delta"], batch["last"], batch["known"], times, strict=True):
                at, _, _, waiting, _ = messages.setdefault(own, [0, 0, "", {}, 0])
                touched[own] = max(touched.get(own, 0), 0 if pd.isna(time) else int(time))
                if at != ENDED and pos >= at:
                    waiting[str(int(pos))] = [delta or "", bool(last), [int(x) for x in known]]
        out: list[tuple] = []
        for own, latest in touched.items():
            *before, until = messages[own]
            if before[0] != ENDED:
                after, told = _drained(*before)
                out += [(own, before[1] + i, kind, content) for i, (kind, content) in enumerate(told)]
                if after[0] == ENDED and forget and not timed:
                    until = now + forget
                before = after
            if timed:
                until = max(until, latest + forget, now + 1)
            messages[own] = [*before, until]
        if forget:
            messages = {m: x for m, x in messages.items() if m in touched or not 0 < x[4] < now}
        if messages:
            state.update((json.dumps(messages),))
            ends = [x[4] for x in messages.values() if x[4]]
            if timed:
                state.setTimeoutTimestamp(max(min(ends), now + 1))
            elif ends:
                state.setTimeoutDuration(max(1, min(ends) - now))
        elif state.exists:
            state.remove()
        if out:
            ids, places, kinds, contents = zip(*out, strict=True)
            yield pd.DataFrame({"message_id": pd.array([int(i) if i else None for i in ids], "Int64"), "ord": places, "kind": kinds, "content": contents})

    rows = deltas.withColumn("_range", F.shiftright("message_id", BITS))
    if timed:
        rows = rows.withColumn("_at", F.unix_millis(clock))
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return rows.groupBy("_range").applyInPandasWithState(run, EVENT, STATE, "append", timeout)


def kept_messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The ids of messages whose state ``parse_stream`` has kept."""
    ids = spark.read.format("statestore").load(checkpoint).select(F.explode(F.json_object_keys("value.groupState.messages")).alias("id"))
    return ids.select(F.expr("try_cast(id AS long)").alias("message_id"))


def sse_text(payload: Column) -> Column:
    """A payload as a server sends it: its data line and a blank one."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


SSE_STATE = "next long, ord long, carry string, early string"


def sse_payloads(pieces: DataFrame) -> DataFrame:
    """(stream_id, pos, piece) -> (stream_id, ord, payload): the data lines of a text that arrives in pieces.

    A line that is not yet whole is carried to the next piece; comments and other fields go; pieces that arrive before
    their turn wait, pieces that arrive again change nothing.  What follows the last line break stays in the state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ord_, carry, early = state.get if state.exists else (0, 0, "", "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for batch in batches:
            waiting.update((int(pos), piece or "") for pos, piece in zip(batch["pos"], batch["piece"], strict=True) if pos >= at)
        while at in waiting:
            carry += waiting.pop(at)
            at += 1
        *lines, carry = carry.split("\n")
        out = [x.removesuffix("\r")[5:].removeprefix(" ") for x in lines if x.startswith("data:")]
        state.update((at, ord_ + len(out), carry, json.dumps(waiting)))
        yield pd.DataFrame({"stream_id": key[0], "ord": range(ord_, ord_ + len(out)), "payload": out})

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, ord long, payload string", SSE_STATE, "append", GroupStateTimeout.NoTimeout)


def content_blocks(parsed: DataFrame) -> DataFrame:
    """Events to blocks: neighbouring text is one, a citation ends it; text is cut at blank lines, empty parts go."""
    w = Window.partitionBy("message_id").orderBy("ord")
    cut = F.when((F.col("kind") == "text") & (F.lag("kind").over(w) == "text"), 0).otherwise(1)
    block = parsed.withColumn("_cut", cut).withColumn("block", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = F.array_sort(F.collect_list(F.struct("ord", "content")))
    whole = block.groupBy("message_id", "block").agg(F.min("kind").alias("kind"), F.array_join(F.transform(pairs, lambda x: x["content"]), "").alias("content"))
    parts = F.when(F.col("kind") == "text", F.filter(F.split("content", r"\n{2,}"), lambda x: x != "")).otherwise(F.array("content"))
    return whole.select("message_id", "block", "kind", F.posexplode(parts).alias("part", "content"))


def job_states(events_: DataFrame) -> DataFrame:
    """The latest state of each job, kept up to date (output mode update or complete)."""
    return events_.groupBy("entity").agg(F.max_by("status", F.struct("updated_at", "job_id")).alias("status"), F.max("updated_at").alias("updated_at"))


def unseen(hits: DataFrame, delay: str | None = None) -> DataFrame:
    """Each chunk of a turn once; with ``delay``, state older than it goes (event time in ``at``)."""
    if delay:
        return hits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["turn_id", "chunk_id"])
    return hits.dropDuplicates(["turn_id", "chunk_id"])


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote.  Complete output is written anew with each batch."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    else:
        put = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
