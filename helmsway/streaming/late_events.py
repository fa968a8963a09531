"""Streaming form of the late-event operator: a reorder buffer per key in Structured Streaming state.

Samples come as they arrive. Each key's state holds the samples of its recent periods: those in the
reorder buffer, whose bound has not passed, and those released from it, in order of event time, to the
final aggregation. Rows out are samples with their fate, provisional period values (first and
corrected) while the buffer holds, and closed figures once it has let go of a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helmsway.operators.late_events import PERIOD_NS, SLACK_NS
from helmsway.operators.scan import NS

FIGURES = ["n", "first_event_ns", "last_event_ns", "max_step_ns"]
OUT = "kind string, seq bigint, event_ns bigint, period bigint, fate string, " + ", ".join(f"{c} bigint" for c in FIGURES)
STATE = "frontier bigint, clock bigint, samples array<struct<event bigint, seq bigint, release bigint>>, closed map<bigint, bigint>, seen map<bigint, bigint>"


def _figures(events: list[int]) -> tuple[int, int, int, int | None]:
    """Count, first, last and longest step of events in order of time: the final, order-sensitive aggregation."""
    return len(events), events[0], events[-1], max((b - a for a, b in zip(events, events[1:])), default=None)


def kslack_stream(
    samples: DataFrame, keys: list[str], seq: str = "seq", slack_ns: int = SLACK_NS, period_ns: int = PERIOD_NS, undated_ns: int = 3600 * NS, copies_ns: int = 600 * NS
) -> DataFrame:
    """Rows (keys, ``kind, seq, event_ns, period, fate`` and figures) of a stream of (keys, seq, event_ns, due_ns, arrival_ns).

    ``kind``: ``sample`` with its fate; ``published`` with a period's count ``n`` when a later period
    first shows, and again for each correction; ``closed`` with a period's count, first and last event
    and longest step when all its samples have left the buffer, and again if a sample within its own
    bound still comes; the last such row stands.

    Within a micro-batch samples are taken by arrival; batches must come in order of arrival. Of the
    copies of a sample the first arrival counts; copies are known for ``copies_ns`` after it. A sample
    without a due time waits ``undated_ns``. A key's clock is its latest arrival; if nothing arrives for a key, the
    arrivals of others move the watermark, which releases what the key still holds. So that the end of a
    stream does the same, it may end with a heartbeat: a row with an arrival but no seq. State is bounded:
    a period is forgotten when it has been closed for ``copies_ns``.
    """
    kinds = dict(samples.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frontier, clock, held, closed, seen = state.get if state.exists else (None, None, [], {}, {})
        held, closed, seen = [tuple(b) for b in held], dict(closed), dict(seen)
        out: list[tuple] = []
        nothing = (None,) * len(FIGURES)

        def count(period):
            return sum(b[0] // period_ns == period for b in held)

        def release(now):
            waiting = {b[0] // period_ns for b in held if b[2] > now}
            for p in sorted({b[0] // period_ns for b in held} - waiting):
                events = sorted(b[0] for b in held if b[0] // period_ns == p)
                if closed.get(p) != len(events):
                    closed[p] = len(events)
                    out.append(("closed", None, None, p, None, *_figures(events)))

        if state.hasTimedOut:
            clock = max(clock or 0, state.getCurrentWatermarkMs() * 1_000_000)
            release(clock)
        else:
            rows = pd.concat(list(frames)).dropna(subset=["arrival_ns"]).sort_values(["arrival_ns", seq])
            for arrival, same in rows.groupby("arrival_ns", sort=True):
                arrival = int(arrival)
                release(arrival - 1)
                before = frontier
                for s, event, due in zip(same[seq], same["event_ns"], same["due_ns"]):
                    if pd.isna(s) or pd.isna(event) or int(s) in seen:
                        continue
                    s, event = int(s), int(event)
                    seen[s] = arrival
                    period = event // period_ns
                    late = not pd.isna(due) and arrival > int(due) + slack_ns
                    fate = "too_late" if late else "corrects" if before is not None and before > period else "in_time"
                    out.append(("sample", s, event, period, fate, *nothing))
                    if not late:
                        held.append((event, s, arrival + undated_ns if pd.isna(due) else int(due) + slack_ns))
                        if fate == "corrects":
                            out.append(("published", None, None, period, None, count(period), *nothing[1:]))
                    frontier = period if frontier is None else max(frontier, period)
                if before is not None and frontier > before:
                    out += [("published", None, None, p, None, count(p), *nothing[1:]) for p in sorted({b[0] // period_ns for b in held}) if before <= p < frontier]
                clock = arrival
        now = clock or 0
        last = {}
        for event, _, bound in held:
            last[event // period_ns] = max(last.get(event // period_ns, 0), bound)
        gone = {p for p, bound in last.items() if p in closed and bound + copies_ns < now}
        held = [b for b in held if b[0] // period_ns not in gone]
        closed = {p: n for p, n in closed.items() if p not in gone}
        seen = {s: at for s, at in seen.items() if at + copies_ns >= now}
        state.update((frontier, clock, held, closed, seen))
        bounds = [b[2] for b in held if b[2] >= now and closed.get(b[0] // period_ns) != count(b[0] // period_ns)]
        if bounds:
            state.setTimeoutTimestamp(max(min(bounds) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        told = pd.DataFrame(out, columns=["kind", "seq", "event_ns", "period", "fate", *FIGURES]).astype({c: "Int64" for c in ("seq", "event_ns", "period", *FIGURES)})
        for k, v in zip(reversed(keys), reversed(key)):
            told.insert(0, k, v)
        yield told

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + OUT
    timed = samples.select(*keys, seq, "event_ns", "due_ns", "arrival_ns", F.timestamp_micros(F.call_function("div", F.col("arrival_ns"), F.lit(1000).cast("bigint"))).alias("_arrived"))
    return timed.withWatermark("_arrived", "0 seconds").groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
