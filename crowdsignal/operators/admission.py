"""Rate limits and alert suppression: decisions that depend on earlier decisions, taken in many tasks.

What a limit decides depends on what it admitted before. But where arrivals alone stay below the limits, everything is
admitted whatever came earlier, so the state is known. Only stretches of load between such places are read in order.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profiles as P
from ..scratch import drop, materialize
from .ordered import sliced


def running(df: DataFrame, by: tuple[str, ...], part: str, order: list[Column], value: Column, name: str, later: bool = False, own: bool = False) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the rows before, or the smallest of those after, within ``by`` in ``order``.

    ``part`` divides a key into slices that follow ``order``. Each slice's extreme is carried to the others by a window over
    one row a slice; rows are ordered within a slice only. ``own`` counts the row itself.
    """
    pick = F.min if later else F.max
    rows = df.withColumn("_value", value)
    edges = rows.groupBy(*by, part).agg(pick("_value").alias("_most"))
    over = Window.partitionBy(*by).orderBy(F.col(part).desc() if later else F.col(part)).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, part))]
    carried = edges.select(*keys, pick("_most").over(over).alias("_carried"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*by, part))])
    inside = Window.partitionBy(*by, part).orderBy(*order)
    inside = inside.rowsBetween(0 if own else 1, Window.unboundedFollowing) if later else inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    extreme = (F.least if later else F.greatest)("_carried", pick("_value").over(inside))
    return rows.join(carried, same, "left").withColumn(name, extreme).drop("_value", "_carried", *[f"_k{i}" for i in range(len(keys))])


def _before(by: tuple[str, ...], width: int, order: tuple[str, ...]) -> Column:
    """Valid rows of the key in the last ``width`` units, the start excluded, that come before a row of ``sliced``."""
    peers = Window.partitionBy(*by, "_slice", "_t")
    upto = F.sum("_valid").over(peers.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return F.sum("_valid").over(Window.partitionBy(*by, "_slice").orderBy("_t").rangeBetween(-(width - 1), 0)) - F.sum("_valid").over(peers) + upto - F.col("_valid")


def admit_jointly(df: DataFrame, by: tuple[str, ...], limit: int | str, scope: tuple[str, ...] = (), overall: int | None = None, window: int = 60, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id", "replay")) -> DataFrame:
    """Adds ``rate_reason``: source_rate, global_rate, or null for rows that both limits admit; ``admitted`` says the same.

    A row is admitted if fewer than ``limit`` rows of its ``by`` (a number, or a column of ``df``) and fewer than
    ``overall`` of its ``scope`` were admitted in the last ``window`` seconds, the start excluded. Only a row that passes
    both counts for either. ``scope`` is part of ``by``; without ``overall`` it may be all of it.

    A row is surely admitted if even all arrivals of its window are below both limits; others are *busy*. A row with no
    busy one in its window meets a known state, all arrivals of the window. So a stretch begins with a busy row that has
    none in its window and ends ``window`` after its last busy row. Rows outside stretches are settled by counts; each
    stretch is read in order by one task, with the arrivals of the window before it, all admitted, as its state. Counts,
    the last busy row and the stretch's start are found within slices of time, so that no task holds a key. Only a load
    that stays above a limit without end is one stretch; its state is bounded by the limits.

    Rows without a time or with a null in ``by`` belong to no window: both columns are null. Equal times follow ``order``.
    """
    if any(c not in by for c in scope):
        raise ValueError("the scope must be part of the key")
    names = [c for c in df.columns if c not in ("rate_reason", "admitted")]
    valid = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, ts)])
    rows = df.select(*names).withColumn("_t", F.col(ts).cast("long")).withColumn("_valid", valid.cast("int"))
    most = F.lit(limit) if isinstance(limit, int) else F.coalesce(F.col(limit), F.lit(0))
    rows = sliced(rows, "_t", window).withColumn("_most", most.cast("long"))
    full = _before(by, window, order) >= F.col("_most")
    if overall is not None:
        full = full | (_before(scope, window, order) >= overall)
    rows = rows.withColumn("_busy", full & (F.col("_valid") == 1)).where(~F.col("_ghost")).drop("_ghost")

    sort = [F.col("_t"), *[F.col(c) for c in order]]
    rows = running(rows, scope, "_slice", sort, F.when(F.col("_busy"), F.col("_t")), "_last")
    loaded = (F.col("_t") - F.col("_last") < window) & (F.col("_valid") == 1)
    rows = rows.withColumn("_loaded", F.coalesce(loaded, F.lit(False)))
    starts = F.when(F.col("_busy") & ~F.col("_loaded"), F.col("_t"))
    rows = running(rows, scope, "_slice", sort, starts, "_from", own=True)
    rows = running(rows, scope, "_slice", sort, starts, "_next", later=True)
    rows = rows.withColumn("_stretch", F.when(F.col("_busy") | F.col("_loaded"), F.col("_from")))
    ahead = (F.col("_next") - F.col("_t") < window) & (F.col("_valid") == 1)
    copies = F.when(ahead, F.array(F.struct(F.col("_stretch").alias("of"), F.lit(False).alias("ghost")), F.struct(F.col("_next").alias("of"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("_stretch").alias("of"), F.lit(False).alias("ghost"))))
    rows = rows.withColumn("_place", F.explode(copies)).select(*names, "_t", "_valid", "_most", "_slice", F.col("_place.of").alias("_of"), F.col("_place.ghost").alias("_ghost"))
    return _folded(rows, names, by, scope, overall, window, order)


def _folded(rows: DataFrame, names: list[str], by: tuple[str, ...], scope: tuple[str, ...], overall: int | None, window: int, order: tuple[str, ...]) -> DataFrame:
    """The stretches (``_of``) read in order, others passed on as admitted; rows marked ``_ghost`` are known to be admitted."""
    spread = F.when(F.col("_of").isNull(), F.col("_slice"))
    rows = rows.withColumn("_spread", spread).repartition(*scope, "_of", "_spread").sortWithinPartitions(*scope, F.col("_of"), "_t", *order)
    at = {c: i for i, c in enumerate(rows.columns)}
    inner = [at[c] for c in by]
    key = [*(at[c] for c in scope), at["_of"]]
    kept_columns = [at[c] for c in names]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("rate_reason", T.StringType()), T.StructField("admitted", T.BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, kept, counts = None, deque(), Counter()
        for batch in batches:
            column = lambda i, b=batch: b.column(i).to_pylist()
            groups, keys = list(zip(*map(column, inner), strict=True)), list(zip(*map(column, key), strict=True))
            reasons, ghosts = [], column(at["_ghost"])
            for t, ok, most, group, own, ghost in zip(column(at["_t"]), column(at["_valid"]), column(at["_most"]), groups, keys, ghosts, strict=True):
                if not ok or own[-1] is None:
                    reasons.append(None)
                    continue
                if own != stretch:
                    stretch, kept, counts = own, deque(), Counter()
                while kept and kept[0][0] <= t - window:
                    counts[kept.popleft()[1]] -= 1
                reason = None if ghost else "source_rate" if counts[group] >= most else "global_rate" if overall is not None and len(kept) >= overall else None
                if reason is None:
                    kept.append((t, group))
                    counts[group] += 1
                reasons.append(reason)
            admitted = [None if not ok else r is None for ok, r in zip(column(at["_valid"]), reasons, strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept_columns), pa.array(reasons, pa.string()), pa.array(admitted, pa.bool_())], names=schema.fieldNames())
            yield out.filter(pa.array([not g for g in ghosts]))

    return rows.mapInArrow(fold, schema)


def admit(df: DataFrame, by: tuple[str, ...], limit: int | str, window: int = 60, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id", "replay")) -> DataFrame:
    """Adds ``admitted``: fewer than ``limit`` rows of the key were admitted in the last ``window`` seconds, the start excluded.

    As ``admit_jointly`` with one limit: a key is in as many tasks as it has stretches of load.
    """
    return admit_jointly(df.drop("rate_reason"), by, limit, by, None, window, ts, order).drop("rate_reason")


def _slices_of(times: DataFrame, quiet: int, span: int) -> DataFrame:
    """``times(..., _t)`` with ``_slice`` and ``_own``: each slice has its own times, those of a pause before it and of two after it."""
    at = lambda shift: F.floor((F.col("_t") + shift) / span)
    return times.withColumn("_slice", F.explode(F.sequence(at(-2 * quiet), at(quiet)))).withColumn("_own", F.col("_slice") == at(0))


def _walk(table: pa.Table, quiet: int) -> tuple[pa.Table, list[int], list[int | None], list[bool], list[bool]]:
    """A slice's times in order, each with the place of its next step, whether it begins an orbit, and whether it is its own."""
    table = table.sort_by("_t")
    t, own = table.column("_t").to_numpy(), table.column("_own").to_pylist()
    place = np.searchsorted(t, t + quiet)
    steps = [int(p) if p < len(t) and t[p] < x + 2 * quiet else None for p, x in zip(place.tolist(), t.tolist(), strict=True)]
    begins = np.diff(t, prepend=t[0] - quiet) >= quiet
    return table, t.tolist(), steps, begins.tolist(), own


def _ways(times: DataFrame, by: list[str], quiet: int, span: int) -> DataFrame:
    """(by, _t, _to, _seed): where a slice is left by, for each time it may be entered by and for each orbit that begins in it."""
    schema = T.StructType([*(times.schema[c] for c in by), *T.StructType.fromDDL("_t long, _to long, _seed boolean")])

    def follow(table: pa.Table) -> pa.Table:
        table, t, steps, begins, own = _walk(table, quiet)
        leaves: list[int | None] = [None] * len(t)
        for i in range(len(t) - 1, -1, -1):
            if own[i] and (to := steps[i]) is not None:
                leaves[i] = leaves[to] if own[to] else t[to]
        start = table.column("_slice")[0].as_py() * span
        enters = [i for i in range(len(t)) if own[i] and leaves[i] is not None and (begins[i] or t[i] < start + 2 * quiet)]
        keys = table.select(by).take(pa.array(enters, pa.int64()))
        return pa.Table.from_arrays([*keys.columns, pa.array([t[i] for i in enters], pa.int64()), pa.array([leaves[i] for i in enters], pa.int64()), pa.array([begins[i] for i in enters], pa.bool_())], names=schema.fieldNames())

    return times.groupBy(*by, "_slice").applyInArrow(follow, schema)


def _entered(ways: DataFrame, by: list[str]) -> DataFrame:
    """(by, _t): the times by which orbits enter slices. Each round doubles how far all ways reach."""
    reached = materialize(ways.where("_seed").select(*by, F.col("_to").alias("_t")).distinct(), "alert-entries")
    jumps = ways.select(*by, "_t", "_to")
    while True:
        further = reached.join(jumps, [*by, "_t"]).select(*by, F.col("_to").alias("_t"))
        now = materialize(reached.union(further).distinct(), "alert-entries")
        after = jumps.select(*by, F.col("_t").alias("_to"), F.col("_to").alias("_then"))
        twice = materialize(jumps.join(after, [*by, "_to"]).select(*by, "_t", F.col("_then").alias("_to")), "alert-ways")
        drop(reached, jumps)
        reached, jumps = now, twice
        if jumps.isEmpty():
            drop(jumps)
            return reached


def _sent_times(times: DataFrame, by: list[str], quiet: int) -> DataFrame:
    """The times of ``times(by, _t, _slice, _own, _in)`` that are on an orbit: those that begin one, are entered by, or follow."""
    schema = T.StructType([*(times.schema[c] for c in by), T.StructField("_t", T.LongType())])

    def mark(table: pa.Table) -> pa.Table:
        table, t, steps, begins, own = _walk(table, quiet)
        on = [o and (b or i) for o, b, i in zip(own, begins, table.column("_in").to_pylist(), strict=True)]
        for i, to in enumerate(steps):
            if on[i] and to is not None and own[to]:
                on[to] = True
        return table.select([*by, "_t"]).filter(pa.array(on, pa.bool_()))

    return times.groupBy(*by, "_slice").applyInArrow(mark, schema)


def suppress_alerts(df: DataFrame, by: tuple[str, ...] = ("alert_key",), quiet: int = 600, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",), slices: int = 64) -> DataFrame:
    """Adds ``sent``: false within ``quiet`` seconds of the key's last sent alert; suppressed ones do not extend the pause.

    The sent alert after one at t is the first at or past t + ``quiet``: sent alerts are the orbit of the first one under
    this step. An alert without another in the ``quiet`` seconds before it is sent for sure and begins an orbit, so only
    steps of less than two pauses need following. A key's distinct times are cut into slices of ``slices`` pauses. In each,
    the times by which an orbit may enter, a thirty-second of all, are followed to where they leave; which of these ways
    are taken is found by pointer doubling, joins that double the reach of every way at once, in as many rounds as the
    logarithm of a key's slices. Then each slice marks its times from where it is entered. A key that never pauses is in
    as many tasks as it has slices; a slice holds distinct seconds, 64 pauses of them at most, and never all rows.

    Rows without a time or with a null in ``by`` are null. Of rows of one time the first in ``order`` is the one sent.
    """
    names, span = [c for c in df.columns if c != "sent"], slices * quiet
    keys = [f"_k{i}" for i in range(len(by))]
    valid = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, ts)])
    rows = df.select(*names).withColumns({"_t": F.when(valid, F.col(ts).cast("long")), **{k: F.col(c) for k, c in zip(keys, by, strict=True)}})
    times = materialize(rows.where("_t is not null").select(*keys, "_t").distinct(), "alert-times")
    ways = materialize(_ways(_slices_of(times, quiet, span), keys, quiet, span), "alert-ways")
    entered = _entered(ways, keys)
    known = times.join(entered.withColumn("_in", F.lit(True)), [*keys, "_t"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    sent = materialize(_sent_times(_slices_of(known, quiet, span), keys, quiet), "alert-sent")
    drop(times, entered)
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(*order)) == 1
    out = rows.join(sent.withColumn("_on", F.lit(True)), [*keys, "_t"], "left").withColumn("sent", F.when(F.col("_t").isNotNull(), F.coalesce("_on", F.lit(False)) & first))
    return out.select(*names, "sent")


def flag_duplicates(df: DataFrame, fingerprint: str = "fingerprint", source: str = "source", windows: dict[str, int] = P.DUPLICATE_WINDOW, ts: str = "arrival_s", order: tuple[str, ...] = ("event_id", "replay")) -> DataFrame:
    """Adds ``duplicate``: the source accepted the fingerprint within its window of whole seconds, both ends included.

    A repeat does not extend the window, so accepted rows follow each other as sent alerts do. Sources are named in any
    case; rows of others, without a time or a fingerprint are null.
    """
    names = [c for c in df.columns if c != "duplicate"]
    own = F.lower(source)
    parts = [suppress_alerts(df.select(*names).where(own == name), (fingerprint,), window + 1, ts, order) for name, window in windows.items()]
    rest = df.select(*names).where(own.isNull() | ~own.isin(*windows)).withColumn("sent", F.lit(None).cast("boolean"))
    return reduce(DataFrame.union, [*parts, rest]).select(*names, (~F.col("sent")).alias("duplicate"))
