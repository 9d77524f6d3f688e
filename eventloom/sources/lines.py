"""Numbers for the lines of text files, dense and in input order, without moving a line.

Files are read in splits. A first pass counts the lines of each split; offsets are running sums over the splits in
the order of their files' paths and places; a second pass adds a line's place within its split. So what is gathered and
broadcast is a row a split, of which there are as many as tasks at most, never a line; and no task sees all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = "_file string, _start long, _first long, _lines long, _line_before long, _first_event long, _ordinal_before long"
#: White space of which a blank line consists.
BLANK = " \t\r\n\x0b\x0c"
#: Rows' numbers (of ``monotonically_increasing_id``) have their partition above so many bits.
PARTITION_BITS = 33


def blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK)) == ""


def placed(lines: DataFrame) -> DataFrame:
    """Lines of a file source, batch or streaming, with the split that each is from."""
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def numbered_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = False) -> DataFrame:
    """``value, file, line, ordinal`` of every line that isn't blank: ``line`` counts all lines of its file from 1,
    ``ordinal`` those that aren't blank of all files from 0, files in the order of their paths. With ``keep_blank`` blank lines
    stay, and there is no ordinal.

    Both passes have to read the same splits: the second raises where a file or its splits changed in between."""
    return numbered(placed(spark.read.text(path)), keep_blank)[0]


def numbered(read: DataFrame, keep_blank: bool = False) -> tuple[DataFrame, int]:
    """``numbered_lines`` of ``placed`` lines, and how many there are that aren't blank."""
    place = F.monotonically_increasing_id()  # within a partition it rises by one from line to line
    read = read.withColumn("_at", place)
    found = read.groupBy("_file", "_start").agg(F.min("_at").alias("first"), F.count("*").alias("lines"), F.count_if(~blank(F.col("value"))).alias("events")).collect()
    # Where the lines that aren't blank begin, once they are numbered alone.
    part, at, first_event = None, 0, {}
    for r in sorted(found, key=lambda r: r["first"]):
        if (mine := r["first"] >> PARTITION_BITS) != part:
            part, at = mine, mine << PARTITION_BITS
        first_event[r["_file"], r["_start"]] = at
        at += r["events"]
    rows, file, line, ordinal = [], None, 0, 0
    for r in sorted(found, key=lambda r: (r["_file"], r["_start"])):
        line = line if r["_file"] == file else 0
        file = r["_file"]
        rows.append((file, r["_start"], r["first"], r["lines"], line, first_event[file, r["_start"]], ordinal))
        line, ordinal = line + r["lines"], ordinal + r["events"]
    splits = F.broadcast(read.sparkSession.createDataFrame(rows, SPLITS))
    x = read if keep_blank else read.where(~blank(F.col("value"))).withColumn("_event_at", place)
    x = x.join(splits, ["_file", "_start"], "left")
    within = F.col("_at") - F.col("_first")
    kept = F.coalesce((within >= 0) & (within < F.col("_lines")), F.lit(False))
    sound = F.when(kept, within).otherwise(F.raise_error(F.concat(F.lit("the splits changed between two passes over "), "_file")).cast("long"))
    named = [F.col("_file").alias("file"), (F.col("_line_before") + sound + 1).alias("line")]
    if not keep_blank:
        named.append((F.col("_ordinal_before") + F.col("_event_at") - F.col("_first_event")).alias("ordinal"))
    return x.select("value", *named), ordinal
