"""Records of CSV files whose quoted cells may hold line breaks.

Files stay splittable: lines are read in parallel, and a line maps the state at its begin (inside a quoted
cell or not) to the state at its end. The maps of all lines of a file split compose to one map, and the
maps of a file's splits, in order, tell in which state each split begins. With that known, each task
joins its lines to records as they come; only the pieces of records that cross a split border are
brought together, by the running number of the record in its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cargolens.plans.staging import stage
from cargolens.schema import SchemaError

PLACE = ["ingest_file", "ingest_block", "ingest_seq"]
_LINES = "line string, ingest_file string, ingest_block long, ingest_seq long"

# a quote opens a cell only at the cell's begin; behind the closing quote all is plain up to the comma
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_CELLS = re.compile(f"{_CELL}(?:,{_CELL})*+")
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+')


def inside_after(line: str, inside: bool) -> bool:
    """Is the end of ``line`` inside a quoted cell, given whether its begin is?"""
    at = 0
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        at = closing.end()
        if at == len(line):
            return False
        at += 1  # the comma
    return _CELLS.match(line, at).end() < len(line)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of one file split at a time: (file, block) and the rows, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column("ingest_file")).run_ends.to_pylist()
        blocks = pc.run_end_encode(batch.column("ingest_block")).run_ends.to_pylist()
        begin = 0
        for end in sorted({*ends, *blocks}):
            rows = batch.slice(begin, end - begin)
            yield (rows.column("ingest_file")[0].as_py(), rows.column("ingest_block")[0].as_py()), rows
            begin = end


def _quoted(rows: pa.RecordBatch) -> list[int]:
    """Numbers of the lines with a quote."""
    return pc.indices_nonzero(pc.match_substring(rows.column("line"), '"')).to_pylist()


def _split_maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a split: its map, its first filled line, and whether a line ends inside."""
    for (file, block), rows in _pieces(batches):
        lines = rows.column("line")
        states, spans = [False, True], [False, True]
        for k in _quoted(rows):
            line = lines[k].as_py()
            states = [inside_after(line, state) for state in states]
            spans = [span or state for span, state in zip(spans, states)]
        filled = pc.index(pc.not_equal(pc.utf8_trim(lines, " "), ""), True).as_py()
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "ingest_file": file,
                    "ingest_block": block,
                    "ingest_seq": rows.column("ingest_seq")[0].as_py(),
                    "header": lines[filled].as_py() if filled >= 0 else None,
                    "from_outside": states[0],
                    "from_inside": states[1],
                    "spans_outside": spans[0],
                    "spans_inside": spans[1],
                }
            ],
            schema=pa.schema(
                [("ingest_file", pa.string()), ("ingest_block", pa.int64()), ("ingest_seq", pa.int64()), ("header", pa.string())]
                + [(c, pa.bool_()) for c in ("from_outside", "from_inside", "spans_outside", "spans_inside")]
            ),
        )


def split_maps(lines: DataFrame) -> list[Row]:
    """The maps of all file splits in order, one row for each batch of lines a split has.

    That is a few rows for each split, which the driver lists itself to plan the scan.
    """
    kind = (
        "ingest_file string, ingest_block long, ingest_seq long, header string,"
        " from_outside boolean, from_inside boolean, spans_outside boolean, spans_inside boolean"
    )
    return sorted(lines.mapInArrow(_split_maps, kind).collect(), key=lambda r: (r["ingest_file"], r["ingest_block"], r["ingest_seq"]))


def first_lines(maps: list[Row]) -> dict[str, str]:
    """The first filled line of each file."""
    heads: dict[str, str] = {}
    for row in maps:
        if row["header"] is not None:
            heads.setdefault(row["ingest_file"], row["header"])
    return heads


def _begin_states(maps: list[Row]) -> tuple[dict[tuple, bool], bool]:
    """Whether each split begins inside a quoted cell, and whether any line ends inside one."""
    begins, spans = {}, False
    file, state = None, False
    for row in maps:
        if row["ingest_file"] != file:
            if state:
                raise SchemaError(f"a quoted cell of {file} is not closed")
            file, state = row["ingest_file"], False
        key = (file, row["ingest_block"])
        begins.setdefault(key, state)
        spans = spans or row["spans_inside" if state else "spans_outside"]
        state = row["from_inside" if state else "from_outside"]
    if state:
        raise SchemaError(f"a quoted cell of {file} is not closed")
    return begins, spans


_WHOLE, _OPEN, _MIDDLE = 0, 1, 2


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task to records: whole ones, and the first and later pieces of those that cross a border."""
    split, state, kind = None, False, _WHOLE
    held: list[str] = []  # the lines of the record that is open
    place: tuple = ()
    out: list[tuple] = []

    def finish(kind: int) -> None:
        out.append(("\n".join(held), *place, kind))
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["line", *PLACE, "piece"])

    for key, rows in _pieces(batches):
        if key != split:
            if held:
                finish(_OPEN if kind == _WHOLE else _MIDDLE)
            split, state = key, rows.column("begins_inside")[0].as_py()
            if state is None:
                raise RuntimeError("the file splits have changed since the file was opened; read it again")
            kind = _MIDDLE if state else _WHOLE
        quoted = _quoted(rows)
        if not quoted and not state:  # plain lines pass as they are
            if out:
                yield batch()
            whole = pa.array([_WHOLE] * rows.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("line", *PLACE)), whole], names=["line", *PLACE, "piece"])
            continue
        marked = set(quoted)
        for k, (line, *at) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("line", *PLACE)))):
            if not held:
                place = tuple(at)
            held.append(line)
            if k in marked:
                state = inside_after(line, state)
            if not state:
                finish(kind)
                kind = _WHOLE
        if out:
            yield batch()
    if held:
        finish(_OPEN if kind == _WHOLE else _MIDDLE)
        yield batch()


def join_records(lines: DataFrame, maps: list[Row]) -> tuple[DataFrame, bool]:
    """Lines as records (line, ingest columns) without blank ones, and whether any holds a line break.

    Where no cell has a line break the result is a lazy filter. Otherwise records are written once,
    as the maps hold for the file splits of this moment.
    """
    filled = F.trim("line") != ""
    begins, spans = _begin_states(maps)
    if not spans:
        return lines.where(filled), False
    # a row for each split, as in the maps; a task's lines look up their own instead of carrying the list of all
    kind = f"{PLACE[0]} string, {PLACE[1]} long, begins_inside boolean"
    states = lines.sparkSession.createDataFrame([(*key, state) for key, state in begins.items()], kind)
    known = lines.join(F.broadcast(states), PLACE[:2], "left").select("line", *PLACE, "begins_inside")
    pieces = stage(known.mapInArrow(_joined, _LINES + ", piece int"), "csv-records")
    number = F.sum((F.col("piece") == _OPEN).cast("long")).over(
        Window.partitionBy("ingest_file").orderBy("ingest_block", "ingest_seq")
    )
    cut = pieces.where(F.col("piece") != _WHOLE).withColumn("number", number)
    parts = F.sort_array(F.collect_list(F.struct("ingest_block", "ingest_seq", "line")))
    cut = cut.groupBy("ingest_file", "number").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    cut = cut.select(text.alias("line"), "ingest_file", *(F.col("parts")[0][c].alias(c) for c in PLACE[1:]))
    return pieces.where((F.col("piece") == _WHOLE) & filled).select("line", *PLACE).unionByName(cut), True
