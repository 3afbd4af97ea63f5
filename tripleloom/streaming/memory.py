"""The life of remembered facts as keyed state: sessions by gaps, expiry by event time, forgetting; and the same by a batch query.

An event is ``subject, predicate, object, at, ttl, op``: it asserts a fact (``op`` 'assert', for ``ttl`` seconds or, without one, for good) or
forgets it ('forget').  Events of a subject count in the order of their times; of equal times an assertion comes before a
forgetting.  A subject's session goes on while its events are at most ``gap`` apart.  A fact asserted again takes the new time, session
and expiry.

The stream keeps each subject's live facts as its state, with the events that the watermark has not passed yet, so that they count in order
whatever order they came in; a timer stands at the next of these or the next expiry.  It emits changes: ``change`` is 'assert', 'forget'
or 'expire'.  The last change of each fact, folded by `live_of`, is what `live` computes from all events up to the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "subject string, predicate string, object string, at timestamp, ttl long, op string"
CHANGES = "subject string, predicate string, object string, change string, at timestamp, expires timestamp, session long"
STATE = "facts string, pending string, last long, session long"


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def _applied(facts: dict, last: int | None, session: int, events: list[tuple], gap: int) -> tuple[dict, int | None, int, list[tuple]]:
    """The state after the events ``(at, order, predicate, object, ttl)`` in order, and the changes."""
    out = []
    for at, forgets, p, o, ttl in sorted(events, key=lambda e: e[:4]):
        if last is None or at - last > gap:
            session += 1
        last = at if last is None else max(last, at)
        for key in [k for k, (_, end, _) in facts.items() if end is not None and end <= at]:
            out.append((*key, "expire", facts[key][1], facts[key][1], facts.pop(key)[2]))
        if forgets:
            if (p, o) in facts:
                out.append((p, o, "forget", at, None, session))
                del facts[p, o]
        else:
            end = None if ttl is None else at + 1000 * ttl
            facts[p, o] = (at, end, session)
            out.append((p, o, "assert", at, end, session))
    return facts, last, session, out


def changes(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The changes of a stream of events, each once; events later than ``late`` are dropped, and facts expire with the watermark."""
    apart = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, waiting, last, session = state.get if state.exists else ("[]", "[]", -1, 0)
        facts = {(p, o): (at, end, s) for p, o, at, end, s in json.loads(raw)}
        last = None if last < 0 else last
        some = [tuple(e) for e in json.loads(waiting)]
        for f in frames:  # one subject's new events of one trigger
            f = f[f["at"].notna()]
            some += [(_ms(at), op == "forget", p, o, None if pd.isna(ttl) else int(ttl)) for p, o, at, ttl, op in zip(f["predicate"], f["object"], f["at"], f["ttl"], f["op"], strict=True)]
        now = state.getCurrentWatermarkMs()
        facts, last, session, out = _applied(facts, last, session, [e for e in some if e[0] <= now], apart)
        some = [e for e in some if e[0] > now]
        for k in sorted(k for k, (_, end, _) in facts.items() if end is not None and end <= now):
            out.append((*k, "expire", facts[k][1], facts[k][1], facts.pop(k)[2]))
        ends = [end for _, end, _ in facts.values() if end is not None] + [e[0] for e in some]
        if last is not None or some:
            state.update((json.dumps([(*k, *v) for k, v in facts.items()]), json.dumps(some), -1 if last is None else last, session))
            if ends:  # a timer goes off once the watermark is beyond it
                state.setTimeoutTimestamp(max(min(ends) - 1, now + 1))
        if out:
            p, o, change, at, end, s = zip(*out, strict=True)
            time = lambda v: pd.to_datetime(pd.array(v, "Int64").to_numpy(dtype="float64", na_value=float("nan")), unit="ms")
            yield pd.DataFrame({"subject": key[0], "predicate": p, "object": o, "change": change, "at": time(at), "expires": time(end), "session": s})

    # a subject is a key of its own; its state is as large as its live facts
    return events.where("subject is not null").withWatermark("at", late).groupBy("subject").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_of(log: DataFrame) -> DataFrame:
    """The live facts that a log of changes leaves: ``subject, predicate, object, at, expires, session``."""
    rank = F.when(F.col("change") == "expire", 0).when(F.col("change") == "assert", 1).otherwise(2)  # what ends at a time ends before what is said at it
    last = log.groupBy("subject", "predicate", "object").agg(F.max(F.struct("at", rank.alias("r"), "change", "expires", "session")).alias("m"))
    return last.where("m.change = 'assert'").select("subject", "predicate", "object", "m.at", "m.expires", "m.session")


def live(events: DataFrame, now, gap: str = "30 minutes") -> DataFrame:
    """The live facts at ``now`` (a timestamp) from all events up to it, without state: windows over a subject for its sessions, one aggregation for its facts."""
    e = events.where(F.col("subject").isNotNull() & (F.col("at") <= F.lit(now).cast("timestamp"))).withColumn("at", F.date_trunc("millisecond", "at")).withColumn("f", (F.col("op") == "forget").cast("int"))
    order = Window.partitionBy("subject").orderBy("at", "f", "predicate", "object")
    apart = int(pd.Timedelta(gap).total_seconds() * 1000)
    new = F.coalesce(F.unix_millis("at") - F.unix_millis(F.lag("at").over(order)) > apart, F.lit(True))
    e = e.withColumn("session", F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = e.groupBy("subject", "predicate", "object").agg(F.max(F.struct("at", "f", "ttl", "session")).alias("m")).where("m.f = 0")
    ends = F.when(F.col("m.ttl").isNotNull(), F.timestamp_millis(F.unix_millis("m.at") + 1000 * F.col("m.ttl")))
    rows = last.select("subject", "predicate", "object", "m.at", ends.alias("expires"), "m.session")
    return rows.where(F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp")))
