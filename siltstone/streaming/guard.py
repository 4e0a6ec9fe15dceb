"""The edit guard: findings of changed files per micro-batch, and a loop guard with keyed state."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import findings as V

EVENT_SCHEMA = "hook_event_name string, tool_name string, cwd string, session_id string, stop_hook_active boolean, tool_input string"
OFF_VARIABLE = "SILTSTONE_DISABLE"
MAX_TARGETS = 40
REPORT = "session string, seq long, digest string, n long"


def first_reports(rows: DataFrame) -> DataFrame:
    """Batch form: rows (session, seq, digest) whose digest differs from the session's one before."""
    w = Window.partitionBy("session").orderBy("seq")
    return rows.withColumn("_before", F.lag("digest").over(w)).where("not (digest <=> _before)").drop("_before")


def parse_events(lines: DataFrame) -> DataFrame:
    """Edit events from JSON lines (value): malformed ones and those that are already being handled pass unseen.

    The order of a session is ``seq`` where the lines have it. A missing session is named nosession.
    """
    kept = [c for c in ("seq",) if c in lines.columns]
    rows = lines.select(*kept, F.from_json("value", EVENT_SCHEMA).alias("e")).select(*kept, "e.*")
    rows = rows.where(~F.coalesce("stop_hook_active", F.lit(False)))
    rows = rows.where(F.coalesce("hook_event_name", "tool_name", "cwd", "session_id", "tool_input").isNotNull())
    return rows.withColumn("session_id", F.coalesce("session_id", F.lit("nosession")))


def is_turn_end(event: str | None) -> bool:
    """The end of a turn looks at functions too; so does an event without a name."""
    return not event or event.startswith("Stop")


def digest(findings: DataFrame) -> DataFrame:
    """session, seq, digest, n of each event's blocking set, whatever the order of its findings."""
    line = F.format_string("%s:%d: [%s] %s: %s", "file", "line", "severity", "rule", "message")
    return findings.groupBy("session", "seq").agg(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("digest"), F.count("*").alias("n"))


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    before = rows["digest"].shift(1)
    if len(rows):
        before.iloc[0] = last
        state.update((rows["digest"].iloc[-1],))
    yield rows[rows["digest"].ne(before)][["session", "seq", "digest", "n"]]


def guard(stream: DataFrame) -> DataFrame:
    """Streaming form of ``first_reports`` over the rows of ``digest``: one digest of state a session, no event time."""
    return stream.select("session", "seq", "digest", "n").groupBy("session").applyInPandasWithState(_remember, REPORT, "digest string", "append", GroupStateTimeout.NoTimeout)


def edit_microbatch(events: DataFrame, files: DataFrame, analyse: Callable[[DataFrame, DataFrame, bool], DataFrame], fail_on: str = "warn") -> DataFrame:
    """session, seq and the blocking findings of one batch of events (session_id, seq, event, path).

    ``files`` (path, text) are the changed files with their context. ``analyse`` takes the files, the
    paths to report and whether functions are compared, which only the end of a turn asks for; each
    kind of event is analysed once, however many events the batch has.
    """
    level = fail_on if fail_on in ("warn", "error") else "warn"
    out = None
    for whole, rows in ((False, events.where("not turn_end")), (True, events.where("turn_end"))):
        found = V.at_or_above(analyse(files, rows.select("path").distinct(), whole), level)
        part = found.join(rows.select(F.col("session_id").alias("session"), "seq", F.col("path").alias("file")).distinct(), "file")
        out = part if out is None else out.unionByName(part)
    return out


def watch(lines: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the guard: each micro-batch of events is analysed, and a failure lets the batch pass.

    ``analyse`` turns events into findings with a ``session``; ``sink`` gets those that block. Nothing
    is looked at while the variable OFF_VARIABLE is set.
    """

    def each(batch: DataFrame, number: int) -> None:
        if os.environ.get(OFF_VARIABLE):
            return
        try:
            sink(analyse(parse_events(batch)), number)
        except Exception as error:  # the guard must never stop an edit for its own faults
            print(f"guard: batch {number} passed unseen: {error!r}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def swallowed_unless_new(session: str, digest_now: str, folder: str) -> bool:
    """For one process without a stream: whether this set was the session's last, kept in a file of the folder.

    A folder that cannot be read or written counts as a repetition, since a loop could not be stopped.
    """
    import hashlib

    name = os.path.join(folder, "turn-" + hashlib.sha256(session.encode()).hexdigest()[:16])
    try:
        os.makedirs(folder, exist_ok=True)
        if os.path.exists(name):
            with open(name) as f:
                if f.read().strip() == digest_now:
                    return True
        with open(name, "w") as f:
            f.write(digest_now)
    except OSError:
        return True
    return False
