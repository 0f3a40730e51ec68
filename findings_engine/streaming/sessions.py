"""Edit sessions as streams: capture prompts, consults and refreshes.

A session's state is three facts: were there edits, did the register grow since
the first of them, and has the one prompt been spent. A stop with edits and
without growth asks once; growth closes the cycle; a start clears everything.
``fold`` is the rule, used by the stateful stream and by the batch form alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDIT, GROW, STOP, START = "edit", "grow", "stop", "start"
STATE = "edited boolean, grown boolean, prompted boolean"
DECISION = "session string, event_id bigint, decision string"
FRESH = (False, False, False)


def fold(state: tuple[bool, bool, bool], kind: str, continuing: bool = False) -> tuple[tuple[bool, bool, bool], str | None]:
    """(state, decision): block, pass or None where nothing is decided."""
    edited, grown, prompted = state
    if kind == START:
        return FRESH, None
    if kind == EDIT:
        return (True, grown, prompted), None
    if kind == GROW:  # growth before the first edit is part of the baseline
        return (edited, grown or edited, prompted), None
    if kind != STOP:
        return state, None
    if continuing or not edited:
        return state, "pass"
    if grown:
        return FRESH, "pass"
    return (edited, grown, True), "pass" if prompted else "block"


def _decided(rows: pd.DataFrame, state: tuple[bool, bool, bool], session: str):
    out = []
    rows = rows.sort_values(["ts", "event_id"])
    for event_id, kind, continuing in zip(rows["event_id"], rows["kind"], rows["continuing"], strict=True):
        state, decision = fold(state, kind, bool(continuing))
        if decision:
            out.append((session, event_id, decision))
    return state, pd.DataFrame(out, columns=["session", "event_id", "decision"])


def capture_stream(events: DataFrame) -> DataFrame:
    """Streaming (session, ts, event_id, kind, continuing) to a decision for each stop.

    Rows arrive session by session in small batches; the state of a session is
    three booleans however long it lasts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState):
        state = tuple(held.get) if held.exists else FRESH
        for rows in [pd.concat(list(batches))]:
            state, out = _decided(rows, state, key[0])
            yield out
        held.update(state)

    return events.groupBy("session").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


STATES = [(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)]
_PART = "session string, event_id bigint, decision string, options string, part int, last boolean"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A part's decisions; of its first session, which an earlier part may have begun, one for each of its eight states."""
    part = TaskContext.get().partitionId()
    session, head, states = None, True, list(range(len(STATES)))
    for rows in batches:
        out = []
        for s, event_id, kind, continuing in rows[["session", "event_id", "kind", "continuing"]].itertuples(index=False):
            if session is None:
                session = s
            elif s != session:
                session, head, states = s, False, [0]
            turns = [fold(STATES[x], kind, bool(continuing)) for x in states]
            states = [STATES.index(x) for x, _ in turns]
            if turns[0][1]:
                options = "".join(d[0] for _, d in turns) if head else None  # b or p for each state
                out.append((s, event_id, None if head else turns[0][1], options, part, False))
        yield pd.DataFrame(out, columns=["session", "event_id", "decision", "options", "part", "last"])
    if session is not None:  # where the part's last session stands, for each state that it may have begun in
        ends = "".join(map(str, states if head else states * len(STATES)))
        yield pd.DataFrame([(session, 1 if head else 0, None, ends, part, True)], columns=["session", "event_id", "decision", "options", "part", "last"])


def capture(events: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same over a finished table: a decision for each stop.

    A cycle ends at a stop whose effect depends on where the last one ended, so
    window sums can't tell the state. But the rule has eight states, and what a run
    of events does to them can be composed: rows are dealt by range of (session,
    time), so a hot session is split; each part folds its own run, the first
    session's from all eight states; then parts are put together by a row each.
    ``store`` writes a table and reads it back.
    """
    dealt = events.repartitionByRange("session", "ts", "event_id").sortWithinPartitions("session", "ts", "event_id")
    rows = store(dealt.mapInPandas(_run, _PART), "capture")
    begin, session, state = {}, None, 0
    for r in sorted(rows.where("last").collect(), key=lambda r: r.part):  # a row a part
        whole = r.event_id == 1  # the part has one session
        begin[r.part] = (session, state)
        state = int(r.options[state if whole and session == r.session else 0])
        session = r.session
    starts = rows.sparkSession.createDataFrame([(k, s, i) for k, (s, i) in begin.items()], "part int, before string, state int")
    asked = rows.where("not last").join(F.broadcast(starts), "part")
    at = F.when(F.col("before") == F.col("session"), F.col("state")).otherwise(0)
    open_ = F.when(F.substr("options", at + 1, F.lit(1)) == "b", "block").otherwise("pass")
    return asked.select("session", "event_id", F.coalesce("decision", open_).alias("decision"))


#: A session starts anew at these sources of a start event; one that is resumed or compacted goes on.
CLEARING = ("startup", "clear")


def start_kind(source: Column) -> Column:
    """The kind of a start event by its source."""
    return F.when(source.isin(*CLEARING), START).otherwise("other")


def growth(stops: DataFrame, baselines: DataFrame) -> DataFrame:
    """stops (session, ts, register_sha: null if there is no register) that show growth since the session's baseline.

    baselines (session, exists, sha256) are frozen at a session's first edit. Only
    proof counts: a register that wasn't there and is, or whose digest is another.
    """
    both = stops.join(baselines, "session")
    return both.where(F.col("register_sha").isNotNull() & (~F.col("exists") | (F.col("sha256") != F.col("register_sha")))).select(*stops.columns)


def refresh_on(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str):
    """One refresh a micro-batch that has edits, however many; the batch's edits are consumed first."""

    def turn(batch: DataFrame, number: int) -> None:
        edits = batch.where(F.col("kind") == EDIT)
        if not edits.isEmpty():
            refresh(edits, number)

    return events.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consult_stream(edits: DataFrame, contexts: DataFrame) -> DataFrame:
    """Streaming edits (path, ...) joined to the known contexts (path, context) of a static table; unknown paths are silent."""
    return edits.join(contexts, "path")
