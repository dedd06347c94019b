"""Stateful steps of a stream on ``transformWithStateInPandas``: order guard, duplicates, velocity, distinct chats.

Each step is keyed, keeps a bounded state in the state store, and drops it by event-time timers, so that results do not
depend on when a batch runs. Time is the arrival in whole seconds (``ts``); ``arriving`` gives the watermark that timers
follow. Rows of one key are handled in arrival order within a micro-batch; batches follow arrival, as a queue or a growing
folder gives them. A row that arrives more than the watermark's delay before the latest one is dropped by Spark and counted
in the query's progress. Rows that an earlier step dropped (``drop_reason``) pass on and touch no state, so steps can be
chained in one query. Rows pass through pandas: an integer column that holds nulls is exact up to 2^53.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..functions import profiles as P

#: The event-time column of the steps; it carries the watermark from one to the next.
AT = "arrived_at"
#: Parts of a source that remember its fingerprints, each in a state of its own.
PARTS = 64
#: A slice of time of the velocity, in long windows; a slice of a source is a key of its own.
SLICE = 32
#: Timers are set at multiples of so many seconds, so that a key has few.
_TICK = 60


def arriving(stream: DataFrame, ts: str = "arrival_s", delay: str = "10 minutes") -> DataFrame:
    """``stream`` with the event-time column of the steps and its watermark."""
    return stream.withColumn(AT, F.timestamp_seconds(ts)).withWatermark(AT, delay)


class _Step(StatefulProcessor):
    """A step that adds columns to a key's rows in order. Subclasses give ``state`` and ``decide``."""

    def __init__(self, ts: str, order: tuple[str, ...]):
        self.ts, self.order = ts, [ts, *order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        live = frame["drop_reason"].isna() if "drop_reason" in frame else pd.Series(True, frame.index)
        frame = self.own(key, frame.assign(**self.decide(key, frame, live.tolist(), frame[self.ts].tolist())))
        if len(frame):
            yield frame

    def own(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        """The rows that the key gives back."""
        return frame

    def wake(self, second: float) -> None:
        """Fire once the watermark has passed ``second``."""
        self.handle.registerTimer((int(second) // _TICK + 1) * _TICK * 1000)

    def close(self) -> None:
        pass


def _applied(stream: DataFrame, by: list, step: _Step, added: str) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes) + f", {added}"
    return stream.groupBy(*by).transformWithStateInPandas(step, schema, "append", "EventTime", eventTimeColumnName=AT)


class _Order(_Step):
    def __init__(self, ts, order, event, tolerance, idle):
        super().__init__(ts, order)
        self.event, self.tolerance, self.idle = event, tolerance, idle

    def state(self, handle):
        self.seen = handle.getValueState("seen", "event bigint, arrival bigint")

    def decide(self, key, frame, live, times):
        seen, out = (self.seen.get()[0] if self.seen.exists() else None), []
        tolerance = self.tolerance.get(str(key[0]).lower(), 0)
        for ok, t in zip(live, frame[self.event].tolist(), strict=True):
            ok = ok and t == t
            out.append(bool(ok and seen is not None and t < seen - tolerance))
            if ok:
                seen = int(t) if seen is None else max(seen, int(t))
        if seen is not None:
            self.seen.update((seen, int(times[-1])))
            if self.idle:
                self.wake(times[-1] + self.idle)
        return {"out_of_order": out}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists() and (self.seen.get()[1] + self.idle) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        yield from ()


def order_guard(stream: DataFrame, event: str = "event_s", ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",), idle: int | None = None) -> DataFrame:
    """Adds ``out_of_order``: below the largest earlier event time of the source and asset, less the source's tolerance.

    State: one number for each source and asset; with ``idle`` it goes once none has arrived for so many seconds.
    """
    return _applied(stream, ["source", "asset"], _Order(ts, order, event, P.ORDER_TOLERANCE, idle), "out_of_order boolean")


class _Duplicates(_Step):
    def __init__(self, ts, order, fingerprint, windows, default, delay):
        super().__init__(ts, order)
        self.fingerprint, self.windows, self.default, self.delay = fingerprint, windows, default, delay

    def state(self, handle):
        self.accepted = handle.getMapState("accepted", "fingerprint string", "at bigint")

    def window(self, key) -> int:
        return self.windows.get(str(key[0]), self.default)

    def decide(self, key, frame, live, times):
        window, known, changed, out = self.window(key), {}, {}, []
        # what is remembered ends before the key's last timer, so only rows before that can meet it
        last = max(self.handle.listTimers(), default=0) // 1000
        for ok, fp, t in zip(live, frame[self.fingerprint].tolist(), times, strict=True):
            if not ok or fp is None:
                out.append(False)
                continue
            if fp not in known:
                known[fp] = self.accepted.getValue((fp,))[0] if t < last and self.accepted.containsKey((fp,)) else None
            out.append(known[fp] is not None and t <= known[fp] + window)
            if not out[-1]:
                known[fp] = changed[fp] = int(t)
        if self.delay is not None:  # rows to come are not before the latest one less the delay
            changed = {fp: t for fp, t in changed.items() if t + window >= times[-1] - self.delay}
        for fp, t in changed.items():
            self.accepted.updateValue((fp,), (t,))
        if changed:
            self.wake(max(changed.values()) + window)
        return {"duplicate": out}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.window(key)
        for fp in [fp for (fp,), (at,) in self.accepted.iterator() if at < old]:
            self.accepted.removeKey((fp,))
        yield from ()


def duplicates(stream: DataFrame, fingerprint: str = "fingerprint", windows: dict[str, int] = P.DUPLICATE_WINDOW, default: int = 300, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",), parts: int = PARTS) -> DataFrame:
    """Adds ``duplicate``: the source accepted the fingerprint within its own window of seconds, both ends included.

    State: the fingerprints of a source's window and when each was accepted, in ``parts`` maps by a hash of the
    fingerprint, so that a source is in many tasks. What no row within the watermark's delay can repeat is not stored, so
    that a batch that holds days of a backlog leaves its last minutes only. A repeat does not extend the window. Null
    fingerprints are none.
    """
    delay = stream.schema[AT].metadata.get("spark.watermarkDelayMs")
    keyed = stream.withColumns({"key_source": F.lower("source"), "key_part": F.pmod(F.xxhash64(fingerprint), F.lit(parts)).cast("int")})
    return _applied(keyed, ["key_source", "key_part"], _Duplicates(ts, order, fingerprint, windows, default, None if delay is None else delay / 1000), "duplicate boolean").drop("key_source", "key_part")


class _Velocity(_Step):
    """By key and slice of time; rows of the slice before only count in the windows."""

    def __init__(self, ts, order, profile):
        super().__init__(ts, order)
        self.p, self.span = profile, SLICE * profile["long"]

    def own(self, key, frame):
        return frame[frame[self.ts] >= key[-1] * self.span]

    def state(self, handle):
        self.ring = handle.getValueState("ring", "seconds array<bigint>, counts array<int>")

    def decide(self, key, frame, live, times):
        # seconds that the windows hold: t - s < second <= t where the lower end is open, else t - s <= second
        edge = 0 if self.p["open"] else -1
        windows = {k: [deque(), 0] for k in ("short", "long")}
        if self.ring.exists():
            for t, n in zip(*self.ring.get(), strict=True):
                for w in windows.values():
                    w[0].append([t, n])
                    w[1] += n
        out = []
        for ok, t in zip(live, times, strict=True):
            if not ok:
                out.append(None)
                continue
            for name, w in windows.items():
                held = w[0]
                if held and held[-1][0] == t:
                    held[-1][1] += 1
                else:
                    held.append([int(t), 1])
                w[1] += 1
                while held[0][0] - edge <= t - self.p[name]:
                    w[1] -= held.popleft()[1]
            rate = windows["long"][1] / self.p["long"]
            out.append(windows["short"][1] / self.p["short"] / rate if rate else float(self.p["default"]))
        held = windows["long"][0]
        if held:
            self.ring.update(([t for t, _ in held], [n for _, n in held]))
            self.wake(held[-1][0] + self.p["long"])
        return {"velocity": out}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.ring.exists() and self.ring.get()[0][-1] + self.p["long"] < expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.ring.clear()
        yield from ()


def velocity(stream: DataFrame, profile: str = "ing_tw", by: tuple[str, ...] = ("source",), ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Adds ``velocity`` as the batch operator does (unrounded): the short window's rate over the long one's; null where dropped.

    State: for each slice of time a ring of counts by second, at most as many as the long window has, whatever the rate;
    gone once it is over. The last window of a slice also goes to the next one. So a batch that holds days of a backlog is
    in as many tasks as it has slices, and a task holds the rows of one.
    """
    step = _Velocity(ts, order, P.VELOCITY[profile])
    at, live = F.floor(F.col(ts) / step.span), F.col("drop_reason").isNull() if "drop_reason" in stream.columns else F.lit(True)
    twice = live & (F.col(ts) >= (at + 1) * step.span - step.p["long"])
    keyed = stream.withColumn("key_slice", F.explode(F.when(twice, F.array(at, at + 1)).otherwise(F.array(at))))
    return _applied(keyed, [*by, "key_slice"], step, "velocity double").drop("key_slice")


class _Chats(_Step):
    def __init__(self, ts, order, chat, least, window):
        super().__init__(ts, order)
        self.chat, self.least, self.window = chat, least, window

    def state(self, handle):
        self.used = handle.getMapState("used", "chat string", "at bigint")

    def decide(self, key, frame, live, times):
        before = sorted(((at, chat) for (chat,), (at,) in self.used.iterator()))
        held: OrderedDict[str, int] = OrderedDict((chat, at) for at, chat in before)
        chats, out, i = frame[self.chat].tolist(), [], 0
        while i < len(times):
            j = i
            while j < len(times) and times[j] == times[i]:  # uses of one second see each other
                if live[j] and chats[j] is not None:
                    held[chats[j]] = int(times[j])
                    held.move_to_end(chats[j])
                j += 1
            while held and next(iter(held.values())) <= times[i] - self.window:
                held.popitem(last=False)
            out += [bool(x) and len(held) >= self.least for x in live[i:j]]
            i = j
        kept = dict(before and [(c, a) for a, c in before])
        for chat in kept.keys() - held.keys():
            self.used.removeKey((chat,))
        for chat, at in held.items():
            if kept.get(chat) != at:
                self.used.updateValue((chat,), (at,))
        self.wake(times[-1] + self.window)
        return {"coordinated": out}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.window
        for chat in [chat for (chat,), (at,) in self.used.iterator() if at < old]:
            self.used.removeKey((chat,))
        yield from ()


def coordinated(stream: DataFrame, chats: int = 3, window: int = 300, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",), chat: str = "channel") -> DataFrame:
    """Adds ``coordinated``: the phrase was used in so many chats within the last ``window`` seconds, the start excluded.

    State: for each phrase the chats of the window and when each last used it; no rows are kept. The rows of one second
    count for each other if they come in one batch.
    """
    keyed = stream.withColumn("phrase", C.fingerprint("phrase_b", text=F.col("text")))
    return _applied(keyed, ["phrase"], _Chats(ts, order, chat, chats, window), "coordinated boolean")


def windows_by_source(streams: dict[str, DataFrame], size: str = "1 minute", event: str = "event_time", arrival: str = "arrival_time") -> tuple[DataFrame, DataFrame]:
    """Counts by source, asset and window of all rows on time, and the rows that are not, each with its ``lateness``.

    Every source's stream has a watermark of its own allowed delay; the union goes by
    ``spark.sql.streaming.multipleWatermarkPolicy``: with "min", the default, a window is final once the slowest source
    has passed it. Lateness (future, late) is by the clock, so no row on time is ever dropped by a watermark: it follows the
    latest event of rows on time, and such a row is at most its source's delay behind.
    """
    tagged, timely = [], []
    for name, stream in streams.items():
        lag = F.unix_micros(arrival) / 1e6 - F.unix_micros(event) / 1e6
        lateness = F.when(lag.isNull(), "invalid").when(lag < 0, "future").when(lag > P.MAX_DELAY[name], "late")
        tagged.append(stream.withColumn("lateness", lateness))
        timely.append(tagged[-1].where("lateness is null").withWatermark(event, f"{P.MAX_DELAY[name]} seconds"))
    whole, late = timely[0], tagged[0]
    for a, b in zip(timely[1:], tagged[1:], strict=True):
        whole, late = whole.unionByName(a), late.unionByName(b)
    counts = whole.groupBy(F.window(event, size).alias("w"), "source", "asset").agg(F.count("*").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "source", "asset", "total"), late.where("lateness is not null")
