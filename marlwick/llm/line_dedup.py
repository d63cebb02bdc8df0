"""Line dedup over overlapping three-line windows, with DataFrame operations only.

Every run of ``size`` consecutive lines is hashed. Windows that occur more than
once are found with one aggregation (hot windows are combined on the map side);
every occurrence but the first, by (doc_id, text, line number), is marked, and the
marked windows of a document are merged into the set of lines to remove.

A document is a doc_id with a text, so different texts with one doc_id are
documents of their own, in the order of a hash of the text.

A line that goes has an equal line at an earlier place. So the first place of
every distinct line is kept, whatever windows overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_PARTS, attach, written

#: Line numbers stay under this, as Spark's arrays do; so does the hash that orders the texts of one doc_id.
LINES = 1 << 31
#: Rows of one document that a task joins with the lines to remove, about.
GROUP = 4096


def occurrences(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, line, h1, h2 (128 bits of hash) of every window of ``documents`` (doc_id, text_hash, text) that isn't blank."""
    lines = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_hash", F.split("text", "\n").alias("lines"))
    window = ", ".join(f"lines[i + {j}]" for j in range(size))
    blank = " AND ".join(f"trim(lines[i + {j}]) = ''" for j in range(size))
    made = lines.where(F.size("lines") >= size).select(
        "doc_id", "text_hash",
        F.expr(
            f"inline(filter(transform(sequence(0, size(lines) - {size}), i -> "
            f"struct(i AS line, xxhash64({window}) AS h1, xxhash64({size}, {window}) AS h2, {blank} AS blank)), w -> NOT w.blank))"
        ),
    )
    return made.drop("blank")


def repeated_lines(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, removed: the line numbers (from 0) that later occurrences of windows cover, ascending."""
    lines = F.lit(LINES).cast("decimal(10,0)")
    place = (F.col("doc_id").cast("decimal(20,0)") * lines + F.pmod("text_hash", F.lit(LINES))) * lines + F.col("line")
    found = occurrences(documents, size).withColumn("place", place.cast("decimal(38,0)"))
    repeated = written(
        found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "windows",
    )
    later = attach(found, repeated, ["h1", "h2"], "n", ["doc_id", "text_hash", "line"]).where(F.col("place") > F.col("first"))
    covered = F.explode(F.sequence("line", F.col("line") + (size - 1)))
    return later.select("doc_id", "text_hash", covered.alias("line")).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def heavy_rows(keys: DataFrame) -> DataFrame:
    """(_doc_id, _text_hash, _rows): the documents that stand in more than one in HOT_PARTS of the rows, and in over GROUP."""
    most = max(GROUP, keys.count() // HOT_PARTS)
    return written(keys.groupBy("_doc_id", "_text_hash").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most), "heavy")


def dedup_lines(documents: DataFrame, size: int = 3) -> DataFrame:
    """``documents`` (doc_id, text, ...) with text cut and the columns n_lines and n_removed added.

    Lines are parts between newlines, compared as they are; windows of white
    space alone don't count. Texts of under ``size`` lines have no window and
    stay as they are. Rows with a null doc_id or text have no place or lines:
    they pass unchanged (n_lines null for a null text). Rows that repeat a
    doc_id with its text share its places, so a repeated row isn't later than
    itself; other texts with that doc_id have places of their own.
    """
    own = documents.drop("n_lines", "n_removed")  # columns of these names are replaced
    found = repeated_lines(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), size)
    keys = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    heavy = heavy_rows(keys)
    kept = own.withColumns({"_doc_id": F.col("doc_id"), "_text_hash": F.xxhash64("text")}).join(F.broadcast(heavy), ["_doc_id", "_text_hash"], "left")
    kept = kept.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.expr(f"coalesce(_rows, 0) div {GROUP} + 1"))).drop("_rows")
    gone = found.toDF("_doc_id", "_text_hash", "_removed").join(F.broadcast(heavy), ["_doc_id", "_text_hash"], "left")
    gone = gone.withColumn("_salt", F.explode(F.expr(f"sequence(0L, coalesce(_rows, 0L) div {GROUP})"))).drop("_rows")
    joined = kept.join(gone, ["_doc_id", "_text_hash", "_salt"], "left")
    hit = F.col("_removed").isNotNull()
    cut = F.expr(
        "array_join(transform(array_except(sequence(0, size(_lines) - 1), _removed), i -> _lines[i]), '\n')"
    )
    return joined.withColumn("_lines", F.when(hit, F.split("text", "\n"))).select(
        *(F.when(hit, cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in own.columns),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"),
    )
