"""Three-way merges of two branches of a table of texts, by operational transformation.

A branch is what it does to each base row: a value for each column or none, and
for the lines of the text one operation a line (retain, delete or replace) and
the lines that it inserts in each gap.  Both branches' operations stand over the
base's own indices, so concurrent ones meet at an index: the right one is
transformed to what is left to do once the left one is done, and both are
composed onto the base in one pass.  A row is merged where it lies; only rows
that a branch adds are shuffled, by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import bounded_batches, fresh

RETAIN, DELETE, REPLACE = "retain", "delete", "replace"
#: The operation of a line, and those of a text's lines; gaps are one more, the first before all lines.
OPERATION = "struct<op: string, line: string>"
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


@dataclass(frozen=True)
class Branch:
    """A branch's operations, as columns of the base.

    ``drop``: whether the row goes.  ``values``: by column its new value; a null,
    like the base's own value, changes nothing.  ``lines``: an array with an
    ``OPERATION`` for each line.  ``gaps``: an array with an array of inserted
    lines (or null) for each gap, one more than lines.
    """

    drop: Column
    lines: Column
    gaps: Column
    values: dict[str, Column] = field(default_factory=dict)


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def operation(op: Column | str, line: Column | None = None) -> Column:
    return F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), (F.lit(None).cast("string") if line is None else line).alias("line"))


def _plain(base: Column, ops: Column) -> Column:
    """Operations by value: a replacement by the same line retains it."""
    same = lambda x, o: F.when((o["op"] == REPLACE) & (o["line"] == x), operation(RETAIN)).otherwise(o)
    return F.zip_with(base, ops, same)


def _inserted(gaps: Column) -> Column:
    return F.transform(gaps, lambda g: F.coalesce(g, F.array().cast("array<string>")))


def transform_right(left: Column, right: Column) -> Column:
    """What the right lines' operations still do after the left ones: nothing where the left has changed the line."""
    return F.zip_with(left, right, lambda a, b: F.when(a["op"] == RETAIN, b).otherwise(operation(RETAIN)))


def _compose(left: Column, after: Column) -> Column:
    return F.zip_with(left, after, lambda a, b: F.when(b["op"] == RETAIN, a).otherwise(b))


def _apply(base: Column, ops: Column, gaps: Column) -> Column:
    """The lines that operations and insertions make of the base's; no lines are an empty text."""
    kept = F.zip_with(base, ops, lambda x, o: F.when(o["op"] == RETAIN, F.array(x)).when(o["op"] == REPLACE, F.array(o["line"])).otherwise(F.array().cast("array<string>")))
    shifted = F.concat(F.array(F.array().cast("array<string>")), kept)
    return F.array_join(F.flatten(F.zip_with(shifted, gaps, lambda x, g: F.concat(x, g))), "\n")


def _number(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("bigint")


#: What a unit of the merge counts as.
_NONE, _CLEAN, _EDIT_EDIT, _EDIT_DELETE, _INSERT_INSERT = range(5)


def _verdict(left: Column, right: Column, equal: Column, conflict: Column) -> Column:
    """``left`` and ``right`` tell whether each branch changes a unit."""
    return F.when(~left & ~right, F.lit(_NONE)).when(left & right & ~equal, conflict).otherwise(F.lit(_CLEAN))


def merge_rows(base: DataFrame, left: Branch, right: Branch, id_col: str = "doc_id", columns: Sequence[str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """``id_col``, ``columns``, ``text_col`` and the ``COUNTS`` of every row of ``base``, merged; a row that goes has nulls in place of its values.

    Columns, lines and gaps merge separately.  A change of one branch, or the
    same of both, counts one clean, others one conflict in which the left's
    state is taken: of two edits, an edit and a deletion, or two insertions.
    Where a branch drops the row, that alone counts: one conflict of an edit and
    a deletion if the other changes it, again with the left's state, else one
    clean.  Nulls are empty first; a null or empty text has one empty line.
    Repeated rows and null ids are merged row by row, other columns aren't read.
    """
    names = {c: fresh(base, c) for c in ("id", "old", "lines", "ops", "l", "r", "sum")}
    old, lines, ops, one, two, counts = (names[c] for c in ("old", "lines", "ops", "l", "r", "sum"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def side(b: Branch) -> Column:
        values = F.struct(F.lit(0).alias("_"), *(F.coalesce(b.values[c], empty(c)).alias(f"v{i}") if c in b.values else empty(c).alias(f"v{i}") for i, c in enumerate(columns)))
        return F.struct(F.coalesce(b.drop, F.lit(False)).alias("drop"), values.alias("values"), _plain(F.col(lines), b.lines).alias("lines"), _inserted(b.gaps).alias("gaps"))

    cut = base.withColumns({lines: F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), old: F.struct(F.lit(0).alias("_"), *(empty(c).alias(f"v{i}") for i, c in enumerate(columns)))})
    told = cut.select(F.col(id_col).alias(names["id"]), old, lines, side(left).alias(one), side(right).alias(two))

    def changed(b: str) -> Column:
        edited = F.exists(F.col(b)["lines"], lambda o: o["op"] != RETAIN) | F.exists(F.col(b)["gaps"], lambda g: F.size(g) > 0)
        return edited | ~(F.col(b)["values"] == F.col(old))

    def verdicts() -> Column:
        by_line = F.zip_with(F.col(one)["lines"], F.col(two)["lines"], lambda a, b: _verdict(a["op"] != RETAIN, b["op"] != RETAIN, (a["op"] == b["op"]) & a["line"].eqNullSafe(b["line"]), F.when((a["op"] == DELETE) | (b["op"] == DELETE), F.lit(_EDIT_DELETE)).otherwise(F.lit(_EDIT_EDIT))))
        by_gap = F.zip_with(F.col(one)["gaps"], F.col(two)["gaps"], lambda a, b: _verdict(F.size(a) > 0, F.size(b) > 0, a == b, F.lit(_INSERT_INSERT)))
        value = lambda b, i: F.col(b)["values"][f"v{i}"]
        by_column = [_verdict(value(one, i) != F.col(old)[f"v{i}"], value(two, i) != F.col(old)[f"v{i}"], value(one, i) == value(two, i), F.lit(_EDIT_EDIT)) for i in range(len(columns))]
        return F.filter(F.concat(F.array(F.lit(_NONE), *by_column), by_line, by_gap), lambda v: v != _NONE)

    l_drop, r_drop = F.col(one)["drop"], F.col(two)["drop"]
    fate = F.struct(l_drop.alias("l_drop"), r_drop.alias("r_drop"), ((l_drop & ~r_drop & changed(two)) | (r_drop & ~l_drop & changed(one))).alias("clash"))
    judged = told.withColumns({ops: fate, counts: F.when(l_drop | r_drop, F.array().cast("array<int>")).otherwise(verdicts())})
    gone = F.col(ops)["l_drop"] | (F.col(ops)["r_drop"] & ~F.col(ops)["clash"])
    alone = F.col(ops)["r_drop"]  # the left's state, as the right one is gone
    right_lines = transform_right(F.col(one)["lines"], F.col(two)["lines"])
    right_gaps = F.zip_with(F.col(one)["gaps"], F.col(two)["gaps"], lambda a, b: F.when(F.size(a) > 0, a).otherwise(b))
    text = F.when(alone, _apply(F.col(lines), F.col(one)["lines"], F.col(one)["gaps"])).otherwise(_apply(F.col(lines), _compose(F.col(one)["lines"], right_lines), right_gaps))

    def merged(i: int) -> Column:
        mine, theirs = F.col(one)["values"][f"v{i}"], F.col(two)["values"][f"v{i}"]
        return F.when(alone | (mine != F.col(old)[f"v{i}"]), mine).otherwise(theirs)

    dropped = F.col(ops)["l_drop"] | F.col(ops)["r_drop"]
    row = {c: F.lit(0) for c in COUNTS} | {"n_clean": (~F.col(ops)["clash"]).cast("bigint"), "n_edit_delete": F.col(ops)["clash"].cast("bigint")}
    number = {c: F.when(dropped, row[c]).otherwise(_number(F.col(counts), _is(k))).cast("bigint") for k, c in enumerate(COUNTS, _CLEAN)}
    return judged.select(
        F.col(names["id"]).alias(id_col),
        *(F.when(~gone, merged(i)).alias(c) for i, c in enumerate(columns)),
        F.when(~gone, text).alias(text_col),
        *(number[c].alias(c) for c in COUNTS),
    )


def _is(kind: int):
    return lambda v: v == kind


def merge_added(left: DataFrame, right: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """Rows that branches add, merged whole by id, with the columns of ``merge_rows``.

    A row of one branch, or the same of both, counts one clean; two that differ
    count one conflict of two insertions, and the left one stays.  Nulls are
    empty first.  Where a branch adds an id more than once, its least row (by
    columns, then text) counts.
    """
    value = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*columns, text_col)))
    rows = left.select(F.col(id_col), value.alias("row"), F.lit(True).alias("first")).union(right.select(F.col(id_col), value, F.lit(False)))
    met = rows.groupBy(id_col).agg(F.min(F.when(F.col("first"), F.col("row"))).alias("l"), F.min(F.when(~F.col("first"), F.col("row"))).alias("r"))
    clash = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r"))
    number = {"n_clean": ~clash, "n_insert_insert": clash}
    kept = met.select(id_col, F.coalesce("l", "r").alias("row"), *(number.get(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS))
    return kept.select(id_col, *(F.col("row")[c].alias(c) for c in (*columns, text_col)), *COUNTS)


def merge(base: DataFrame, left: Branch, right: Branch, left_added: DataFrame, right_added: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """``merge_rows`` of the base and ``merge_added`` of the rows that branches add; an added id that the base has stays a row of its own."""
    kept = merge_rows(base, left, right, id_col, columns, text_col)
    return kept.unionByName(merge_added(left_added, right_added, id_col, columns, text_col))


def line_operations(old: Sequence[str], new: Sequence[str]) -> tuple[list[tuple[str, str | None]], list[list[str]]]:
    """The operations and insertions that make ``new`` of ``old``.

    Lines equal at both ends are retained, and between them those found once on
    either side that come in the same order (the longest such sequence).
    Between two retained lines as many are replaced as there are on both sides;
    the others are deleted, or inserted after the last of them.
    """
    from bisect import bisect_left

    head, m, n = 0, len(old), len(new)
    while head < min(m, n) and old[head] == new[head]:
        head += 1
    while m > head and n > head and old[m - 1] == new[n - 1]:
        m, n = m - 1, n - 1

    def once(lines: Sequence[str], a: int, z: int) -> dict[str, int]:
        found: dict[str, int] = {}
        for i in range(a, z):
            found[lines[i]] = -1 if lines[i] in found else i
        return {x: i for x, i in found.items() if i >= 0}

    mine, theirs = once(old, head, m), once(new, head, n)
    common = sorted((i, theirs[x]) for x, i in mine.items() if x in theirs)
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    ops: list[tuple[str, str | None]] = [(RETAIN, None)] * len(old)
    gaps: list[list[str]] = [[] for _ in range(len(old) + 1)]
    i, j = head, head
    for x, y in [*reversed(chain), (m, n)]:
        both = min(x - i, y - j)
        for k in range(both):
            if old[i + k] != new[j + k]:
                ops[i + k] = (REPLACE, new[j + k])
        for k in range(i + both, x):
            ops[k] = (DELETE, None)
        gaps[i + both] += new[j + both : y]
        i, j = x + 1, y + 1
    return ops, gaps


def merge_tables(base: DataFrame, left: DataFrame, right: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """``merge`` of two tables that both began as ``base``; ids must not repeat within a table, and aren't null.

    Rows of an id that the base lacks are added ones, ids that a branch lacks
    are dropped.  What a branch has done to a text is found by
    ``line_operations`` within the row.  Each table is shuffled once, by id.
    """
    value = lambda p: F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*columns, text_col))).alias(p)
    met = base.select(id_col, value("old")).join(left.select(id_col, value("l")), id_col, "left").join(right.select(id_col, value("r")), id_col, "left")
    rows = bounded_batches(met).select("*", F.col("old")[text_col].alias("t"), F.col("l")[text_col].alias("lt"), F.col("r")[text_col].alias("rt"))
    made = f"array<{OPERATION}>"
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, l_lines {made}, l_gaps array<array<string>>, r_lines {made}, r_gaps array<array<string>>"
    fields = {f"o{i}": F.col("old")[c] for i, c in enumerate((*columns, text_col))} | {f"{s}{i}": F.col(s)[c] for s in "lr" for i, c in enumerate(columns)} | {f"{s}_gone": F.col(s).isNull() for s in "lr"}
    extra = ", ".join(f"{c} {'boolean' if c.endswith('gone') else 'string'}" for c in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, old, mine, theirs, *rest = batch.columns
            sides = []
            for new in (mine, theirs):
                found = [line_operations(t.split("\n"), t.split("\n") if x is None else x.split("\n")) for t, x in zip(old.to_pylist(), new.to_pylist(), strict=True)]
                sides.append([[{"op": o, "line": x} for o, x in ops] for ops, _ in found])
                sides.append([gaps for _, gaps in found])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(sides, wanted, strict=True)), *rest], names)

    one = pa.list_(pa.struct([("op", pa.string()), ("line", pa.string())]))
    many = pa.list_(pa.list_(pa.string()))
    wanted = [one, many, one, many]
    names = ["id", "l_lines", "l_gaps", "r_lines", "r_gaps", *fields]
    found = rows.select(id_col, "t", "lt", "rt", *(v.alias(k) for k, v in fields.items())).mapInArrow(run, f"{schema}, {extra}")
    named = found.select(F.col("id").alias(id_col), *(F.col(f"o{i}").alias(c) for i, c in enumerate((*columns, text_col))), *(c for c in found.columns if not (c == "id" or c.startswith("o") and c[1:].isdigit())))
    branch = {s: Branch(F.col(f"{s}_gone"), F.col(f"{s}_lines"), F.col(f"{s}_gaps"), {c: F.col(f"{s}{i}") for i, c in enumerate(columns)}) for s in "lr"}
    added = [t.join(base.select(id_col), id_col, "left_anti") for t in (left, right)]
    return merge(named, branch["l"], branch["r"], *added, id_col, columns, text_col)
