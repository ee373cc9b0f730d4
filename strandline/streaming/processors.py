"""The machines over streams and, by the same steps, over batches.

A batch deals rows out by key, sorts them and runs through a task's keys one after the other; only the
current key's machine is in memory. Keys need no machine in a batch: they are windows. A stream's state
is the machine's fields, kept per key in the state store; rows of a key are taken in the order of their
sequence number within a micro-batch. Rows that arrive in a later micro-batch are later to the machine.
With an idle time, state of keys that are gone ends after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.streaming import machines as M

KEY_OUT = "key long, seq long, held int, pressed int, released int, repeated int, action string"
KEY_STATE = "mask int, held int, direction int, place int"
RING_OUT = "key long, seq long, verdict string, real long, ready long, refused boolean"
RING_STATE = "size long, pushed long, consumed long"
FEED_OUT = "key long, seq long, verdict string, real long, ready long, refused string, played_left string, played_right string"
FEED_STATE = "size long, pushed long, consumed long, played_left string, played_right string"
TRANSPORT_OUT = "key long, seq long, command string, step string, state string, gain int"
TRANSPORT_STATE = "state string, level int, slope int, wait int, heard_silence boolean"


def step_ring(ring: M.Ring, op: str, n: int) -> tuple[M.Ring, tuple]:
    """op: 'push', 'take', 'finish' or 'truncate'."""
    verdict, real, refused = None, 0, False
    if op == "push":
        refused = not ring.push(n)
        real = 0 if refused else n
    elif op == "truncate":
        real = ring.truncate()
    else:
        verdict, real = ring.take(n, op == "finish")
    return ring, (verdict, real, ring.ready, refused)


def step_feed(feed: M.Feed, op: str, n: int, left: list[int] | None, right: list[int] | None) -> tuple[M.Feed, tuple]:
    """op: 'push' of a frame, or 'take', 'finish' and 'truncate' as of a ring."""
    verdict, refused, real = None, None, 0
    left, right = ([] if x is None else [int(v) for v in x] for x in (left, right))  # a stream gives arrays
    if op == "push":
        refused = feed.push(left, right)
        real = 0 if refused else len(left)
    else:
        _, (verdict, real, _, _) = step_ring(feed.ring, op, n)
    return feed, (verdict, real, feed.ring.ready, refused, *(f"{d:016x}" for d in feed.digests))


def step_transport(machine: M.Transport, command: str) -> tuple[M.Transport, tuple]:
    machine, step = machine.on(command)
    return machine, (command, step, machine.state, machine.gain.level)


def _transport_state(machine: M.Transport) -> tuple:
    return machine.state, machine.gain.level, machine.gain.slope, machine.gain.wait, machine.heard_silence


#: By name: the inputs, the step, output, state, and the machine from and to its state.
MACHINES: dict[str, tuple[tuple[str, ...], Callable, str, str, Callable, Callable]] = {
    "ring": (("op", "n"), step_ring, RING_OUT, RING_STATE, lambda s: M.Ring(*s) if s else M.Ring(), astuple),
    "feed": (
        ("op", "n", "left", "right"), step_feed, FEED_OUT, FEED_STATE, lambda s: M.Feed(M.Ring(*s[:3]), tuple(int(d, 16) for d in s[3:])) if s else M.Feed(M.Ring()), lambda f: (*astuple(f.ring), *(f"{d:016x}" for d in f.digests))
    ),
    "transport": (("command",), step_transport, TRANSPORT_OUT, TRANSPORT_STATE, lambda s: M.Transport(s[0], M.Gain(*s[1:4]), s[4]) if s else M.Transport(), _transport_state),
}


def batch(rows: DataFrame, machine: str) -> DataFrame:
    """Every key's rows through a machine of its own. A key is one device's history, which is a sequence by nature."""
    if machine == "keys":
        return M.key_events(rows)
    inputs, step, out, _, start, _ = MACHINES[machine]
    names = [c.split()[0] for c in out.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = object(), None
        for part in batches:
            made = []
            for key, seq, *values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != last:
                    last, own = key, start(None)
                own, found = step(own, *values)
                made.append((key, seq, *found))
            columns = zip(*made, strict=True) if made else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    dealt = rows.select(F.col("key").cast("long"), F.col("seq").cast("long"), *inputs).repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInArrow(run, out)


def _key_rows(carried: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    found, carried = M.key_arrays(rows["mask"].to_numpy(), carried)
    out = pd.DataFrame({"key": rows["key"], "seq": rows["seq"]})
    for name, values in zip(("held", "pressed", "released", "repeated"), found, strict=True):
        out[name] = values
    out["action"] = [M.action(int(p)) for p in found[1]]
    return out, carried


def _machine_rows(machine: str, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    inputs, step, out, _, start, state_of = MACHINES[machine]
    own, made = start(state), []
    for key, seq, *values in rows[["key", "seq", *inputs]].itertuples(index=False, name=None):
        own, found = step(own, *values)
        made.append((key, seq, *found))
    return pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")]), state_of(own)


def stream(rows: DataFrame, machine: str, idle_ms: int | None = None) -> DataFrame:
    """The same over a streaming DataFrame, in append mode. An idle time needs a trigger that keeps running."""
    out, state_schema = (KEY_OUT, KEY_STATE) if machine == "keys" else MACHINES[machine][2:4]

    def group(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
        before = tuple(state.get) if state.exists else None
        found, after = _key_rows(before or M.KEYS_START, rows) if machine == "keys" else _machine_rows(machine, before, rows)
        yield found
        state.update(tuple(after))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(group, out, state_schema, "append", timeout)
