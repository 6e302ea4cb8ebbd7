"""A first-in first-out queue of jobs on a stream of events, keyed by queue.

State by queue: what waits in order, what runs, which events were seen, and the ends
of jobs before which a start may still come in.  Jobs start in order as long as there is room;
one that needs the model while another that uses it runs holds up all behind it.

Every event counts once, whenever it comes: numbers seen are kept as all up to a mark
and the few beyond it, so a repeated one is passed over within a batch and across
batches, and a late one still gets its place in the queue.  Numbers are a queue's own,
from 0 without gaps, so what is kept of them is as much as is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "waiting array<struct<seq:bigint,job:bigint,model:boolean>>, running array<struct<seq:bigint,job:bigint,model:boolean>>, ended array<struct<seq:bigint,job:bigint>>, upto bigint, beyond array<bigint>"
OUT = "queue_id long, job_id long, seq long"


class Queue(NamedTuple):
    """waiting and running hold (seq, job, uses the model), ``ended`` ends (seq, job)
    beyond ``upto``; all numbers up to that and those in ``beyond`` were seen."""

    waiting: list
    running: list
    ended: list
    upto: int
    beyond: list


def advance(state: tuple | None, events, capacity: int) -> tuple[Queue, list[int]]:
    """The state after events (seq, event, job, uses model) in order, and the jobs that
    they start; event is queued, ended or cancelled."""
    q = Queue(*state) if state else Queue([], [], [], -1, [])
    waiting, running, ended = ([tuple(x) for x in xs] for xs in q[:3])
    upto, beyond, begun = q.upto, set(q.beyond), []
    for seq, event, job, model in events:
        seq, job = int(seq), int(job)
        if seq <= upto or seq in beyond:
            continue
        beyond.add(seq)
        while upto + 1 in beyond:
            upto += 1
            beyond.remove(upto)
        if event == "queued":
            if not any(e[1] == job and e[0] > seq for e in ended):  # else an end that came first ended it
                waiting = sorted([*waiting, (seq, job, bool(model))])
        else:
            ended.append((seq, job))
            waiting, running = ([x for x in xs if x[1] != job or x[0] > seq] for xs in (waiting, running))
        while waiting and len(running) < capacity and not (waiting[0][2] and any(m for *_, m in running)):
            running.append(waiting.pop(0))
            begun.append(running[-1][1])
    ended = [e for e in ended if e[0] > upto]  # nothing before the others can still come
    return Queue(waiting, running, ended, upto, sorted(beyond)), begun


def started_jobs(events: DataFrame, capacity: int = 1) -> DataFrame:
    """A streaming table of the jobs that each batch of events starts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        new, begun = advance(state.get if state.exists else None, rows[["seq", "event", "job_id", "uses_model"]].itertuples(index=False, name=None), capacity)
        state.update(tuple(new))
        yield pd.DataFrame({"queue_id": [key[0]] * len(begun), "job_id": begun, "seq": [max([new.upto, *new.beyond])] * len(begun)})

    return events.groupBy("queue_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
