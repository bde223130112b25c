"""A1: CSV with line breaks inside quoted cells, read in splits.

A split can't tell whether it starts inside a quoted cell. So each split is read for both cases at once: a line
takes "outside" and "inside" to what holds at its end, and a split's lines compose to one such pair. The
pairs of a file's splits (one row a split, written once) give every split its starting state; a second pass then
cuts the lines into records, which are written once, too. A task takes many small splits, one after another. A record that goes over the end of a split leaves a piece there, and pieces (at most two
a split, or a split that is all one cell) are put together by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..operators.sizing import is_small
from ..session import materialize

ship_by_value(__name__)

TASK_BYTES = 32 << 20  # of small splits that a task takes


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``. A quote opens a cell at its start only; two in a quoted cell
    stand for one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at += not inside
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if not line.startswith('"', at + 1):
                    break
                at += 2
            inside, at = False, at + 1
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """The rows of a task, split by split: a split's rows lie together and in order."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

    it = rows()
    row = next(it, None)
    while row is not None:
        key = row[:2]

        def mine() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row
                row = next(it, None)

        yield key, mine()


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _splits(batches):
        state = [False, True]
        for row in rows:
            state = [ends_inside(row[3], s) for s in state]
        out.append((*key, *state))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                                     ["_file", "_block", "from_outside", "from_inside"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, mid, part, text): whole records (part 0), the rest of one begun before (1), the start of one that
    goes on (2), a split that lies in one record altogether (3). ``mid`` counts the records that start in the
    split from 0; pieces of earlier ones have -1."""
    names = ["_file", "_block", "_mid", "_part", "_text"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    out = []
    for key, rows in _splits(batches):
        held, began, n = [], True, 0
        inside = None
        for _, _, _, line, start in rows:
            if inside is None:
                inside, began = start, not start
            if not held and not inside and not line.strip():
                continue
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                out.append((*key, n if began else -1, 0 if began else 1, "\n".join(held)))
                held, began, n = [], True, n + began
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
                    out = []
        if held:
            out.append((*key, n if began else -1, 2 if began else 3, "\n".join(held)))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of files with many small splits to a task, still split by split: as many tasks as make ``TASK_BYTES`` each, but a few
    for every core at least. Splits of that size stay as they are."""
    spark, n = rows.sparkSession, rows.rdd.getNumPartitions()
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    split = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n * split // TASK_BYTES))
    return rows.coalesce(tasks) if tasks < n else rows


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, _block, _mid, _text)``: the records of CSV files, line breaks in quoted cells kept (as line feeds), with the
    place where they start (``_mid``: from 0 in each split). A file that ends inside a quoted cell ends with that record."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("_line"))
    lines = _gathered(lines)
    ends = materialize(lines.mapInArrow(_outcomes, "_file string, _block long, from_outside boolean, from_inside boolean"), "csv-split-ends")
    # the state before a split: that after the last split which ends in one state from both, turned by every later one that swaps them
    of_file = Window.partitionBy("_file").orderBy("_block")
    swaps = F.sum(F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)).over(of_file)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("inside"), F.col("_swaps").alias("swaps")))
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    begin = (ends.withColumn("_swaps", swaps).withColumn("_fixed", fixed)
             .withColumns({"_last": F.last("_fixed", ignorenulls=True).over(before), "_turned": F.coalesce(F.max("_swaps").over(before), F.lit(0))})
             .select("_file", "_block", (F.coalesce(F.col("_last.inside"), F.lit(False))
                                         != ((F.col("_turned") - F.coalesce(F.col("_last.swaps"), F.lit(0))) % 2 == 1)).alias("_start")))
    few = is_small(begin, 1_000_000)  # a row for each split; a join by shuffle would lose the lines' order
    known = lines.join(F.broadcast(begin) if few else begin, ["_file", "_block"]).select("_file", "_block", "_mid", "_line", "_start")
    known = known if few else known.sortWithinPartitions("_file", "_block", "_mid")
    cut = materialize(known.mapInArrow(_records, "_file string, _block long, _mid long, _part int, _text string"), "csv-records")
    cut = _gathered(cut)
    pieces = cut.where("_part > 0")
    w = Window.partitionBy("_file").orderBy("_block", "_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (pieces.withColumn("_record", F.sum(F.when(F.col("_part") == 2, 1).otherwise(0)).over(w)).groupBy("_file", "_record")
              .agg(F.array_sort(F.collect_list(F.struct("_block", "_mid", "_text"))).alias("p"))
              .select("_file", F.col("p")[0]["_block"].alias("_block"), F.col("p")[0]["_mid"].alias("_mid"),
                      F.array_join(F.transform("p", lambda x: x["_text"]), "\n").alias("_text")))
    return cut.where("_part = 0").select("_file", "_block", "_mid", "_text").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every cell a string, as the plain reader gives it, with the file position columns. The header is
    the first line of each file; short rows end in NULLs, cells beyond the header are dropped."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    r = read_records(spark, path)
    body = r.where("_block > 0 or _mid > 0")
    cells = F.from_csv("_text", schema, {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return body.select(cells.alias("c"), "_file", "_block", "_mid").select("c.*", "_file", "_block", "_mid")
