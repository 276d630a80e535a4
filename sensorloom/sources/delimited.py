"""Logger and plant exports: delimited text whose header row moves.

Files are read as splittable text, so one large file is many tasks. Only the
first lines of each file are looked at for the header (a per-file top-k). The
header rows, one short row per file, meet the lines by a broadcast once they are
counted, so the lines themselves aren't shuffled; what stands up to the header
is skipped by its line number. A line's number is counted from the start of its
block, and the first block starts with its file, so what one job finds holds in
the next one, however that one splits the files. No data line reaches the driver.
Fields are parsed once into the widest layout, then named per distinct header.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import tidy_name
from sensorloom.functions.timekit import parse_time
from sensorloom.operators.clean import first_per_time
from sensorloom.sources.sinks import settle

FILE, BLOCK, ORDER, LINE = "file", "block", "seq", "line"
#: Header rows are broadcast up to this many files; beyond it the join is the planner's.
BROADCAST_FILES = 20_000
#: Lines after the header in which a file's first valid time is looked for before the whole file is.
TIME_SCAN_LINES = 64


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, block, seq, line)``: the place of a block in its file, the number of a line in its block.

    ``(block, seq)`` orders the lines of a file. ``seq`` is counted in the task that reads the block.
    """
    text = spark.read.text(path if isinstance(path, str) else list(path))
    lines = text.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.regexp_replace("value", "\r$|^﻿", "").alias(LINE),
    )
    return lines.mapInArrow(_numbered, f"{FILE} string, {BLOCK} long, {ORDER} long, {LINE} string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each block from 0; the lines of a block follow each other."""
    last, count = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column(0), batch.column(1)
        new = np.ones(n, dtype=bool)
        new[0] = (file[0].as_py(), block[0].as_py()) != last
        if n > 1:
            other = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
            new[1:] = other.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        seq = np.arange(n) - np.repeat(starts, np.diff([*starts, n])) if new[0] else None
        if seq is None:  # goes on with the block of the batch before
            edges = np.concatenate([[0], starts])
            seq = np.arange(n) - np.repeat(edges, np.diff([*edges, n]))
            seq[: starts[0] if len(starts) else n] += count
        last, count = (file[n - 1].as_py(), block[n - 1].as_py()), int(seq[-1]) + 1
        yield pa.RecordBatch.from_arrays([file, block, pa.array(seq), batch.column(2)], names=[FILE, BLOCK, ORDER, LINE])


def file_heads(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every file with their 0-based number, also as ``seq`` of block 0.

    No more than ``n`` lines per block are looked at, and the rank limit is applied before the shuffle.
    """
    order = Window.partitionBy(FILE).orderBy(BLOCK, ORDER)
    number = F.col("line_no") - 1
    return (
        lines.where(F.col(ORDER) < n)
        .withColumn("line_no", F.row_number().over(order))
        .where(F.col("line_no") <= n)
        .select(FILE, number.alias("line_no"), F.lit(0).cast("long").alias(BLOCK), number.cast("long").alias(ORDER), LINE)
    )


def _cells(line: str | Column) -> Column:
    """Cells of a header line. Header cells hold no quoted commas in these exports."""
    text = F.col(line) if isinstance(line, str) else line
    return F.transform(F.split(text, ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))


def _cells_with(cells: Column, word: str) -> Column:
    return F.size(F.filter(cells, lambda c: c.contains(word)))


def _top_of_file(heads: DataFrame, header_no: Column) -> DataFrame:
    """``(file, header_no, header)`` from head lines: the header's number and text."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", LINE)))
    chosen = heads.groupBy(FILE).agg(header_no.cast("int").alias("header_no"), lines.alias("__top"))
    row = F.element_at(F.filter("__top", lambda x: x["line_no"] == F.col("header_no")), 1)
    return chosen.select(FILE, "header_no", F.when(F.col("header_no").isNotNull(), row[LINE]).alias("header"))


def fixed_header(lines: DataFrame, skip: int = plant.PREAMBLE_LINES) -> DataFrame:
    """The header follows a fixed preamble; NULL in shorter files."""
    return _top_of_file(file_heads(lines, skip + 1), F.max(F.when(F.col("line_no") == skip, F.lit(skip))))


def marker_header(lines: DataFrame, marker: str = "ISO time", within: int = plant.MARKER_SCAN_LINES) -> DataFrame:
    """First line among ``within`` that holds the marker and a comma; 0 where none does."""
    hit = F.col(LINE).contains(marker) & F.col(LINE).contains(",")
    first = F.coalesce(F.min(F.when(hit, F.col("line_no"))), F.lit(0))
    return _top_of_file(file_heads(lines, within), first)


def best_header(
    lines: DataFrame, terms: Sequence[str] | None = None, within: int = plant.HEADER_SCAN_LINES
) -> DataFrame:
    """Among lines with a "time" cell: most expected terms, fewest cells called unnamed, then the lowest line.

    A file without such a line gets a NULL header.
    """
    words = list(terms or plant.FLOW_HEADER_TERMS)
    low = F.transform(_cells(LINE), F.lower)
    score = sum((_cells_with(low, w) for w in words), F.lit(0))
    unnamed = F.size(F.filter(low, lambda c: c.startswith("unnamed")))
    timed = F.exists(low, lambda c: c.contains("time"))
    rank = F.when(timed, F.struct(score.alias("s"), (-unnamed).alias("u"), F.col("line_no").alias("k")))
    return _top_of_file(file_heads(lines, within), F.max_by("line_no", rank))


def first_cell_header(lines: DataFrame, label: str = "Time") -> DataFrame:
    """The first of the two top lines whose first cell is the label; NULL where neither is."""
    hit = F.element_at(_cells(LINE), 1) == label
    return _top_of_file(file_heads(lines, 2), F.min(F.when(hit, F.col("line_no"))))


def positional_names(headers: DataFrame, expected: Sequence[str] = tuple(plant.FLOW_EXPORT_COLUMNS)) -> DataFrame:
    """The first cells of each header under the expected names, by position; cells beyond them go."""
    names = ",".join(expected)
    wide = F.size(_cells("header")) >= len(expected)
    return headers.withColumn("header", F.when(wide, F.lit(names)).otherwise(F.col("header")))


def parse_lines(
    lines: DataFrame,
    headers: DataFrame,
    *,
    time_label: str,
    ts: str = "ts",
    prefix: str = "",
    keep_bad: bool = False,
) -> DataFrame:
    """Named text columns plus a parsed time. ``headers`` gives the header of each file.

    Settle ``headers`` first when the files are large: it is one short row per file.
    The distinct header texts are read by the driver (metadata, one short line per layout).
    Lines of the first block up to the header are skipped by number, whatever they hold; in a block too small for them the
    rest of them goes for want of a valid time.
    With ``keep_bad`` rows without a valid time stay, for quality tables.
    """
    tops = headers.where("header_no IS NOT NULL").select(
        FILE, F.col("header").alias("__header"), F.col("header_no").alias("__no")
    )
    per_layout = tops.groupBy("__header").count().collect()
    layouts = [r[0] for r in per_layout]
    if not layouts:
        raise ValueError("no file has a header")
    if sum(r[1] for r in per_layout) <= BROADCAST_FILES:
        tops = F.broadcast(tops)
    named = {h: _layout(h, time_label, prefix) for h in sorted(layouts)}
    width = max(len(n) for n in named.values())
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = (
        lines.join(tops, FILE)
        .where(((F.col(BLOCK) > 0) | (F.col(ORDER) > F.col("__no"))) & (F.trim(LINE) != ""))
        .withColumn("__c", F.from_csv(LINE, F.lit(schema), {"mode": "PERMISSIVE", "ignoreTrailingWhiteSpace": "true"}))
    )
    wanted: dict[str, None] = {}
    for names in named.values():
        wanted.update(dict.fromkeys(n for n in names if n))

    def value(name: str) -> Column:
        picks = F
        for h, names in named.items():
            if name in names:
                picks = picks.when(F.col("__header") == h, F.col(f"__c.c{names.index(name)}"))
        return picks.otherwise(F.lit(None).cast("string")).alias(name)

    table = rows.select(
        FILE, BLOCK, ORDER, LINE, parse_time(value("__time")).alias(ts), *[value(n) for n in wanted]
    )
    repeated = F.coalesce(F.trim("__time") == time_label, F.lit(False))
    table = table.where(~repeated).drop("__time")
    return table if keep_bad else table.where(F.col(ts).isNotNull()).drop(LINE)


def _layout(header: str, time_label: str, prefix: str) -> list[str]:
    """Column names by position; repeated and empty names are dropped, the time column is marked."""
    names: list[str] = []
    for cell in header.split(","):
        cell = cell.strip().strip('"').strip()
        name = tidy_name(cell)
        if name == tidy_name(time_label):
            name = "__time"
        elif name:
            name = prefix + name
        names.append("" if name in names else name)
    if "__time" not in names:
        raise ValueError(f"header without {time_label!r}: {header}")
    return names


def one_per_time(parsed: DataFrame, ts: str = "ts") -> DataFrame:
    """First row per time stamp in file and line order, without the bookkeeping columns."""
    kept = first_per_time(parsed, ts, [FILE, BLOCK, ORDER])
    return kept.drop(FILE, BLOCK, ORDER, LINE)


def load_sensor_logs(spark: SparkSession, path: str | Sequence[str], prefix: str, ts: str = "ts") -> DataFrame:
    """Gas logger files: fixed preamble, ``Time Stamp`` column, prefixed names, one row per stamp."""
    lines = read_lines(spark, path)
    headers = settle(fixed_header(lines))
    parsed = parse_lines(lines, headers, time_label="Time Stamp", ts=ts, prefix=prefix)
    require_times(lines, headers, parsed, ts, time_label="Time Stamp")
    return one_per_time(parsed, ts)


def load_flow_exports(spark: SparkSession, path: str | Sequence[str], ts: str = "ts") -> DataFrame:
    """Plant flow exports whose header row is found by its terms."""
    lines = read_lines(spark, path)
    headers = settle(best_header(lines))
    if headers.where("header_no IS NULL").limit(1).count():
        raise ValueError("a file has no header row")
    return one_per_time(parse_lines(lines, headers, time_label="Time", ts=ts), ts)


def load_positional_exports(spark: SparkSession, path: str | Sequence[str], ts: str = "ts") -> DataFrame:
    """Plant exports whose header is one of the first two lines; the first cells get the expected names by position.

    A file without such a header gives no row here; ``quality_tables`` names it.
    """
    lines = read_lines(spark, path)
    headers = settle(positional_names(first_cell_header(lines)))
    return one_per_time(parse_lines(lines, headers, time_label=plant.FLOW_EXPORT_COLUMNS[0], ts=ts), ts)


def load_marked_table(spark: SparkSession, path: str | Sequence[str], marker: str = "ISO time", ts: str = "ts") -> DataFrame:
    """Files whose header is found by a marker text, which is also the time column."""
    lines = read_lines(spark, path)
    parsed = parse_lines(lines, settle(marker_header(lines, marker)), time_label=marker, ts=ts)
    return parsed.drop(FILE, BLOCK, ORDER)


def require_times(lines: DataFrame, headers: DataFrame, parsed: DataFrame, ts: str, *, time_label: str) -> None:
    """Fail when a file has no valid time at all.

    Looks at the first lines after each header; only files without a valid time there are read in full.
    """
    scan = plant.PREAMBLE_LINES + 1 + TIME_SCAN_LINES
    tops = parse_lines(file_heads(lines, scan), headers, time_label=time_label, ts=ts)
    early = tops.select(FILE).distinct()
    open_files = [r[0] for r in headers.select(FILE).join(early, FILE, "left_anti").limit(BROADCAST_FILES + 1).collect()]
    if open_files:
        late = parsed if len(open_files) > BROADCAST_FILES else parsed.where(F.col(FILE).isin(open_files))
        files = headers.select(FILE).join(early, FILE, "left_anti")
        empty = files.join(late.select(FILE).distinct(), FILE, "left_anti").limit(1).collect()
        if empty:
            raise ValueError(f"no valid time in {empty[0][0]}")


def quality_tables(lines: DataFrame, headers: DataFrame, *, time_label: str, expected: Sequence[str]) -> dict[str, DataFrame]:
    """Side tables of a multi-file load.

    ``data``: good rows. ``bad_rows``: rows without a valid time. ``diagnostics``:
    rows, range and column count per file. ``skipped``: files without a good row and
    why. ``presence``: which expected columns each file's header has.
    """
    table = parse_lines(lines, headers, time_label=time_label, keep_bad=True)
    good = table.where(F.col("ts").isNotNull())
    bad = table.where(F.col("ts").isNull()).select(FILE, LINE)
    head = headers.where("header_no IS NOT NULL").select(FILE, _cells("header").alias("cells"))
    per_file = good.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    diagnostics = per_file.join(head.select(FILE, F.size("cells").alias("columns_present")), FILE, "left")
    files = lines.select(FILE).distinct()
    skipped = (
        files.join(per_file.select(FILE), FILE, "left_anti")
        .join(headers, FILE, "left")
        .select(
            FILE,
            F.when(F.col("header_no").isNull(), "No header row.").otherwise("No valid timestamp rows.").alias("reason"),
        )
    )
    presence = head.select(FILE, *[F.array_contains("cells", c).alias(c) for c in expected])
    return {"data": good.drop(LINE), "bad_rows": bad, "diagnostics": diagnostics, "skipped": skipped, "presence": presence}
