"""Joins along an order: as-of joins, and joins of overlapping intervals.

Rows of both sides are dealt into ranges of about equal size by key and time
together, so a key that has a third of all rows lies in many ranges.  Each range
is one pass over sorted rows.  What a range needs from those before it is carried
to it: one row for an as-of join, the intervals that reach it for overlaps.  The
driver sees one row for each range, never more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import materialize


def fresh_names(frames: Sequence[DataFrame], *bases: str) -> list[str]:
    """Column names that none of the frames has."""
    taken, out = {c.lower() for df in frames for c in df.columns}, []
    for base in bases:
        name = f"millrace_{base}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def ranges_of(rows: DataFrame, order: Sequence[Column | str], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` as a shared table with the column ``name``: the number of the range that a row lies in, by ``order``.

    Ranges follow each other in the order and are of about equal size; rows that
    are equal in all of ``order`` are in one range.  There are ``ranges`` at
    most, as many as shuffles have partitions otherwise.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()))


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str] | str, left_time: str, right_time: str, right_order: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of the same key that isn't later, or with nulls.

    The result has the columns of ``left`` and those of ``right`` that aren't in
    ``on``; the two sides must have no others in common.  Of right rows of one
    time the last in ``right_order`` counts, and of rows equal in that too the
    last by a hash of the row.  Rows whose key has a null, or that have no time,
    match nothing: left ones are kept, with nulls.  Repeated left rows each get
    their match.
    """
    on = [on] if isinstance(on, str) else list(on)
    extra = [c for c in right.columns if c not in on]
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in extra}:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    key, time, side, ties, hashed, row, match, part, found = fresh_names([left, right], "key", "time", "side", "ties", "hash", "row", "match", "range", "found")
    spoken = lambda df, t: df.select(*on).columns and (F.greatest(*(F.col(c).isNull() for c in (*on, t))) if on else F.col(t).isNull())
    keys = F.struct(*on)
    of_right = F.struct(*(F.col(c) for c in extra))
    mine = left.select(keys.alias(key), F.col(left_time).alias(time), F.lit(1).alias(side), F.struct(*(F.col(c) for c in left.columns if c not in on)).alias(row))
    theirs = right.where(~spoken(right, right_time)).select(keys.alias(key), F.col(right_time).alias(time), F.lit(0).alias(side), F.struct(*right_order).alias(ties) if right_order else F.lit(0).alias(ties), of_right.alias(match))
    rows = mine.unionByName(theirs, allowMissingColumns=True).withColumn(hashed, F.xxhash64(row, match))
    order = [key, time, side, ties, hashed]
    dealt = ranges_of(rows, order, part, ranges)

    # One pass over each range: the last right row so far, whatever its key.
    so_far = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col(side) == 0, F.struct(F.col(key).alias("key"), F.col(match).alias("match"))), ignorenulls=True).over(so_far)
    passed = dealt.withColumn(found, last).where(F.col(side) == 1)

    # And what the ranges before have last, one row for each range.
    ends = dealt.where(F.col(side) == 0).groupBy(part).agg(F.max_by(F.struct(F.col(key).alias("key"), F.col(match).alias("match")), F.struct(*order)).alias("carried"))
    numbers = dealt.select(part).distinct().join(ends, part, "left")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.select(F.col(part), F.last("carried", ignorenulls=True).over(before).alias("carried"))
    # As many rows as ranges.
    told = passed.join(F.broadcast(carried), part, "left").withColumn(found, F.coalesce(found, "carried"))
    whole = ~F.greatest(*(F.col(key)[c].isNull() for c in on), F.col(time).isNull()) & (F.col(found)["key"] == F.col(key))
    given = F.when(whole, F.col(found)["match"])
    columns = [(F.col(key)[c] if c in on else F.col(row)[c]).alias(c) for c in left.columns]
    return told.select(*columns, *(given[c].alias(c) for c in extra))


#: Rows of a block in a sweep.
SWEEP_ROWS = 512
_FIELDS = ("key", "start", "end", "id", "carried")


def _ordinal(df: DataFrame, name: str) -> Column:
    """A time or number as a number."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(name)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(name).cast("bigint")
    return F.col(name).cast("bigint" if kind in ("byte", "short", "integer", "long") else "double")


def _both(x: dict, y: dict) -> dict:
    return {f: np.concatenate([x[f], y[f]]) for f in _FIELDS}


def _taken(x: dict, which: np.ndarray) -> dict:
    return {f: x[f][which] for f in _FIELDS}


def _begun(first: dict, later: dict, equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one key in which ``first`` begins before ``later`` (or, where ``equal``, with it), and hasn't ended when that one begins."""
    a, z = first["start"][:, None], later["start"][None]
    return np.nonzero((first["key"][:, None] == later["key"][None]) & ((a <= z) if equal else (a < z)) & (first["end"][:, None] >= z) & ~later["carried"][None])


def _met(held: list[dict], new: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of which the later one is new: the right one if they begin together, unless it was there before."""
    (held_l, held_r), (new_l, new_r) = held, new
    left, right, out = _both(held_l, new_l), _both(held_r, new_r), []
    i, j = _begun(left, new_r, True)
    out.append((left["id"][i], new_r["id"][j]))
    j, i = _begun(right, new_l, False)
    out.append((new_l["id"][i], right["id"][j]))
    j, i = _begun(held_r, new_l, True)
    same = held_r["start"][j] == new_l["start"][i]
    out.append((new_l["id"][i[same]], held_r["id"][j[same]]))
    return out


def _swept(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids from rows of bin, keys, start, end, side, id and carried, which come by bin, keys and start."""
    import pyarrow.compute as pc

    held, code, before = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.slice(0, 1) if before is None else before
        changed = np.zeros(batch.num_rows, bool)
        for k in range(n_keys + 1):
            prior = pa.concat_arrays([own.column(k), batch.column(k).slice(0, batch.num_rows - 1)])
            changed |= np.asarray(pc.not_equal(batch.column(k), prior))
        before = batch.slice(batch.num_rows - 1, 1)
        codes = code + np.cumsum(changed)
        code = int(codes[-1])
        start, end, side, ids, carried = (batch.column(n_keys + k).to_numpy(zero_copy_only=False) for k in range(1, 6))
        rows = {"key": codes, "start": start, "end": end, "id": ids, "carried": carried}
        held = [_taken(rows, np.zeros(0, int))] * 2 if held is None else held
        for at in range(0, batch.num_rows, SWEEP_ROWS):
            part = _taken(rows, np.arange(at, min(at + SWEEP_ROWS, batch.num_rows)))
            new = [_taken(part, side[at : at + SWEEP_ROWS] == s) for s in (0, 1)]
            yield from _met(held, new)
            # What has another key, or has ended, meets nothing more.
            held = [_taken(x, (x["key"] == part["key"][-1]) & (x["end"] >= part["start"][-1])) for x in (_both(h, x) for h, x in zip(held, new, strict=True))]


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], left_id: str, right_id: str, ranges: int | None = None) -> DataFrame:
    """``left_id`` and ``right_id`` of all rows of one key whose spans of time have an instant in common, each pair once.

    Spans include both ends; ids are integers, and names of the two must differ.
    Rows with a null in the key or the span, and spans that end before they
    begin, overlap nothing.  Both sides are cut into ranges of equal size by key
    and begin; a span that goes on is carried to the ranges that it reaches, and
    a pair is made in that of the later begin, by one sweep over sorted rows that
    holds only the spans under way.  Rows of one key and begin are in one range.
    """
    on = list(on)
    bin_, begin, end, side, ident, last = fresh_names([left, right], "bin", "begin", "end", "side", "id", "last")

    def one(df: DataFrame, span: tuple[str, str], id_col: str, which: int) -> DataFrame:
        rows = df.select(*on, _ordinal(df, span[0]).alias(begin), _ordinal(df, span[1]).alias(end), F.lit(which).alias(side), F.col(id_col).cast("bigint").alias(ident))
        return rows.dropna(subset=[*on, begin, end]).where(F.col(begin) <= F.col(end))

    rows = ranges_of(one(left, left_span, left_id, 0).union(one(right, right_span, right_id, 1)), [*on, begin], bin_, ranges)
    bounds = rows.groupBy(bin_).agg(F.min(F.struct(*on, begin)).alias("first"))
    after = Window.orderBy(bin_)
    # One row for each range from here to the list of where they begin.
    following = bounds.select(bin_, F.lead("first").over(after).alias(last))
    whole = F.broadcast(bounds.agg(F.sort_array(F.collect_list(F.struct(F.col(bin_).alias("bin"), "first"))).alias("bounds")))
    reached = F.struct(*on, F.col(end).alias(begin))
    beyond = rows.join(F.broadcast(following), bin_).where(F.col(last) <= reached).drop(last)
    spread = beyond.join(whole, F.lit(True)).withColumn("to", F.filter("bounds", lambda b: (b["bin"] > F.col(bin_)) & (b["first"] <= reached)))
    carried = spread.select(F.explode(F.transform("to", lambda b: b["bin"])).alias(bin_), *on, begin, end, side, ident, F.lit(True).alias("carried"))
    # A carried row begins before the range does, so it comes before those of its key.
    dealt = rows.select(bin_, *on, begin, end, side, ident, F.lit(False).alias("carried")).union(carried)
    ordered = dealt.repartition(bin_).sortWithinPartitions(bin_, *on, begin, side, ident)
    n_keys = len(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _swept(batches, n_keys):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], [left_id, right_id])

    return ordered.mapInArrow(run, f"{left_id} bigint, {right_id} bigint")
