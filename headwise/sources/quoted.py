"""Delimited text whose quoted fields may hold line breaks, read in splits.

Whether a line begins a record depends on all lines before it, but only through one bit: is a
quoted field open? Each line maps that bit to the bit behind it, such maps compose, and so a
chunk of up to 1,024 lines of a split is known by its map: a running composition over the
chunks (one row each) tells how every chunk begins, and every chunk then finds its own record
starts. No task reads a whole file, and no window holds more than a chunk, whatever the size of
the splits. Lines that are records by themselves pass straight through; only the lines of
records over several lines are grouped, by record, also where one goes on in later chunks.

Files in which no line ends inside a quoted field, which is nearly all of them, are found by
one pass over the quotes and go to the plain reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headwise.functions.columns import required
from headwise.sources.store import Stage

# Fixed value: so many lines of a split, as a power of two, are looked through at once.
CHUNK_BITS = 10
CHUNK = ["chunk", "block", "file"]  # the number first, by which rows sort fastest
BROKEN = "_broken"  # the text of a record with too few or too many fields
# Possessive throughout: one way to read a line, and no recursion over long ones. A quote opens a
# field at its beginning only; what follows a closing quote belongs to the field as it stands.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_UNCLOSED = rf'\A(?:{_FIELD},)*+"[^"]*+(?:""[^"]*+)*+\z'


def _open_after(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return F.contains(line, F.lit('"')) & line.rlike(_UNCLOSED)


def _lines(spark: SparkSession, path: str, separator: str | None = "\n") -> DataFrame:
    lines = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether any line ends inside a quoted field. Without one, every line is a record."""
    return not _lines(spark, path, None).filter(_open_after(F.col("value"))).isEmpty()


def _composed(frame: DataFrame, order: Window) -> DataFrame:
    """Adds `_fixed` (state before the row whatever the beginning was, or NULL) and `_odd`
    (whether an odd number of flips lies between)."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = frame.withColumn("_flips", F.coalesce(F.sum(F.col("flip").cast("int")).over(before), F.lit(0)))
    mark = F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").alias("state"), F.col("_flips").alias("flips")))
    marked = counted.withColumn("_mark", F.last(mark, True).over(before))
    since = (F.col("_flips") - F.coalesce(F.col("_mark.flips"), F.lit(0))) % 2 == 1
    return marked.withColumn("_fixed", F.col("_mark.state")).withColumn("_odd", since).drop("_mark")


def _through(state: Column) -> Column:
    """The state behind a row's map (`fixed`, `flip`), given the state before it."""
    return F.coalesce(F.col("fixed"), F.when(F.col("flip"), ~state).otherwise(state))


def _state(start: Column) -> Column:
    """The state before a row of `_composed`, given the state before the first row."""
    base = F.coalesce(F.col("_fixed"), start)
    return F.when(F.col("_odd"), ~base).otherwise(base)


def records(spark: SparkSession, path: str, cut=None) -> DataFrame:
    """`record` text of every record but the first one of each file, which is the header.

    Breaks inside quotes are kept as they are; a line break is a line feed, with or without a
    carriage return before it. Blank records are left out. A quoted field that is still open
    where its file ends is an error. Lines are staged once, dealt by chunk.
    """
    cut = cut or Stage(spark)
    line = F.col("value")
    outside, inside = _open_after(line), _open_after(F.concat(F.lit('"'), line))
    lines = (
        _lines(spark, path)
        .withColumn("at", F.monotonically_increasing_id())  # ascends within a split
        .withColumn("chunk", F.shiftright("at", CHUNK_BITS))
        .withColumns({"o": outside, "i": F.when(F.contains(line, F.lit('"')), inside).otherwise(True)})
        .select("value", *CHUNK, "at", F.when(F.col("o") == F.col("i"), F.col("o")).alias("fixed"), (F.col("o") & ~F.col("i")).alias("flip"))
    )
    by_chunk = Window.partitionBy(*CHUNK).orderBy("at")
    staged = cut("lines", _composed(lines, by_chunk).withColumn("_top", F.row_number().over(by_chunk) == 1))

    # The map of a chunk is what stands before a row behind its last one.
    last = F.max(F.struct("at", "_fixed", "_odd", "fixed", "flip"))
    ends = staged.groupBy(*CHUNK).agg(last.alias("l")).select(*CHUNK, "l.*")
    known = F.when(F.col("_odd"), ~F.col("_fixed")).otherwise(F.col("_fixed"))
    maps = ends.select(
        *CHUNK, _through(known).alias("fixed"),
        (F.col("fixed").isNull() & F.col("_fixed").isNull() & (F.col("_odd") != F.col("flip"))).alias("flip"),
    )
    by_file = Window.partitionBy("file").orderBy("block", "chunk")
    starts = _composed(maps, by_file).withColumns({"begins": _state(F.lit(False)), "_leads": F.row_number().over(by_file) == 1})
    ends_open = F.lead("block").over(by_file).isNull() & _through(F.col("begins"))
    starts = required(
        starts.withColumn("_ends_open", ends_open), ~F.col("_ends_open"), f"A quoted field of {path} is never closed."
    ).select(*CHUNK, "begins", "_leads")

    placed = staged.join(starts, CHUNK).withColumns({"before": _state(F.col("begins")), "_first": F.col("_top") & F.col("_leads")})
    placed = placed.withColumn("after", _through(F.col("before")))
    # As a value that hangs on the states, so that no later check is moved to before them.
    whole = ~F.col("before") & ~F.col("after") & ~F.col("_first")
    single = placed.select(F.when(whole, F.col("value")).alias("record")).filter("record IS NOT NULL")

    parts = placed.filter(F.col("before") | F.col("after")).select(*CHUNK, "at", "value", "before", "_first")
    start = F.when(~F.col("before"), F.struct("block", "at", F.col("_first").alias("header")))
    own = parts.withColumn("own", F.last(start, True).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    last_of = own.groupBy(*CHUNK).agg(F.max("own").alias("own"))
    carried = last_of.select(
        *CHUNK, F.last("own", True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    )
    keyed = own.join(carried, CHUNK).withColumn("_record", F.coalesce("own", "carried"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = keyed.groupBy("file", "_record").agg(pieces.alias("p")).filter("NOT _record.header").select(
        F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("record")
    )
    both = single.unionAll(joined).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
    return both.filter(F.col("record") != "")


def read_delimited(spark: SparkSession, path: str, cut=None) -> DataFrame:
    """Delimited files with a header as text columns; an empty field is empty text or NULL as
    Spark reads it. A record with fewer or more fields than the header is an error, whatever
    columns are read afterwards."""
    plain = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    if not plain.columns:
        return plain
    schema = ", ".join(f"`{c}` string" for c in [*plain.columns, BROKEN])
    n = len(plain.columns)
    problem = f"A record of {path} does not have {n} fields."
    if has_broken_lines(spark, path):
        count = F.regexp_count("record", F.lit(f"(?:\\A|,){_FIELD}"))
        sound = required(records(spark, path, cut), (F.coalesce("record", F.lit("")) == "") | (count == n), problem)
        schema = ", ".join(f"`{c}` string" for c in plain.columns)
        return sound.select(F.from_csv("record", schema, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    schema = ", ".join(f"`{c}` string" for c in [*plain.columns, BROKEN])
    # All fields are parsed even if few are read, or records could not be counted.
    rows = (
        spark.read.schema(schema).option("columnPruning", "false")
        .csv(path, header=True, escape='"', columnNameOfCorruptRecord=BROKEN)
    )
    # With a field beside it, since Spark refuses to read the text of broken records alone.
    broken = F.when(F.col(BROKEN).isNotNull(), F.coalesce(F.char_length(F.col(f"`{plain.columns[0]}`")), F.lit(0)) >= 0)
    return required(rows, ~F.coalesce(broken, F.lit(False)), problem).drop(BROKEN)
