"""Line deduplication over a whole corpus, without moving or returning text.

Lines become 96-bit hashes of their keys. The hashes are range-partitioned, with document and position as secondary
sort keys, so that the occurrences of a line stand together in order: one pass over the sorted partitions sees where a
new document begins, counts a line's documents and knows its first occurrence; nothing is dealt anew for that. Lines
with a large share of a partition, as a sample shows, are left out of the ranges: they are few, their documents are
counted by partial aggregates, and what is found is broadcast to their occurrences. The result is a compressed keep
bitmap per document: words of 64 lines, of which those that keep all lines are left out. Only `apply_bitmaps` touches
texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scimap.llm.common import SPACE, ascii_lower, col, fresh, meet, written

#: Lines in a range; rows of the sample for each range, and how many of them make a line too frequent for the ranges.
RANGE, SAMPLE, OFTEN = 1 << 20, 64, 32


def lines_of(text: Column) -> Column:
    """The text split at \\n; null and empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, id, pos, text_hash) for each line with a key, as a written table: texts are split once."""
    # hashed and split below the generator: above it, a text would be hashed again for each of its lines
    text = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_hash"), lines_of(col(text_col)).alias("lines"))
    line = text.select("id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    line = line.withColumn("key", key).where(F.col("key") != "")
    return written(line.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "id", "pos", "text_hash"))


def frequent(line: DataFrame, ranges: int, n: int) -> DataFrame:
    """(h1, h2) of the lines that would have about half a range or more, by a seeded sample of SAMPLE rows for each of
    `ranges` ranges of n lines: 2 * ranges rows at most."""
    some = line.sample(min(1.0, SAMPLE * ranges / max(1, n)), 11)
    often = some.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= OFTEN)
    return written(often.select("h1", "h2"), small=True)


def in_ranges(line: DataFrame, ranges: int) -> DataFrame:
    """line with n_docs and first (struct<id, pos>) of the line's key, streamed from sorted ranges of (h1, h2).

    The windows want their rows dealt by (h1, h2) and sorted by (h1, h2, id, pos), as they are.
    """
    s = line.repartitionByRange(ranges, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    here = Window.partitionBy("h1", "h2").orderBy("id", "pos")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("before", F.lag(F.struct("id")).over(here))
    new = F.when(F.col("before").isNull() | ~F.col("before")["id"].eqNullSafe(F.col("id")), 1)
    return s.withColumn("n_docs", F.count(new).over(whole)).withColumn("first", F.first(F.struct("id", "pos")).over(whole)).drop("before")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Which lines stay, as rows (id, text_hash, words): words is array<struct<word int, bits bigint>>, bit i of word w
    being line 64 w + i. Words that keep all of their lines are left out, and documents that have no others.

    A line's key is the line without white space at both ends, A-Z in lower case; empty keys never count. Lines whose
    key is in at least min_docs documents are dropped everywhere; with keep_first, their first occurrence by document
    and position stays. Rows with one id are one document; null is an id like any other, the smallest. An empty table
    gives no rows.
    """
    line = line_hashes(docs, id_col, text_col)
    n = line.count()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    hot = F.broadcast(frequent(line, ranges, n))  # two rows for each range at most
    rest = in_ranges(line.join(hot, ["h1", "h2"], "left_anti"), ranges)
    many = line.join(hot, ["h1", "h2"])
    per_doc = many.groupBy("h1", "h2", "id").agg(F.min("pos").alias("pos"))
    found = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("id", "pos")).alias("first"))
    many = many.join(F.broadcast(found), ["h1", "h2"])
    hit = rest.unionByName(many).where(F.col("n_docs") >= min_docs)
    if keep_first:
        hit = hit.where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    word = hit.groupBy("id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits")
    )
    return word.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (the other lines, joined by \\n; empty if none is left).

    All of docs' columns and rows stay; result columns that clash with one of docs get underscores added.
    """
    n_lines, n_dropped, kept, words, th, lines, own, own_th = fresh(docs, "n_lines", "n_dropped", "kept_text", "words", "text_hash", "lines", "own_id", "own_hash")
    b = bitmaps.select(F.col("id").alias(own), F.col("text_hash").alias(own_th), F.col("words").alias(words))
    d = meet(docs.withColumn(th, F.xxhash64(col(text_col))), b, col(id_col).eqNullSafe(F.col(own)) & (F.col(th) == F.col(own_th)), "left")
    d = d.withColumn(lines, lines_of(col(text_col)))
    # the bits of all lines' words, so that a line finds its own by position: words stand in order, gaps between them keep all
    gap = f"array_repeat(-1L, x.word - if(i = 0, 0, `{words}`[i - 1].word + 1))"
    ends = f"array_repeat(-1L, CAST((size(`{lines}`) - 1) div 64 AS INT) - element_at(`{words}`, -1).word)"
    dense = F.expr(f"concat(flatten(transform(`{words}`, (x, i) -> concat({gap}, array(x.bits)))), {ends})")
    d = d.withColumn(words, F.when(F.col(words).isNotNull(), dense))
    left = F.expr(f"filter(`{lines}`, (x, i) -> (shiftright(`{words}`[i div 64], i % 64) & 1L) = 1L)")
    return d.select(
        *[col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.aggregate(words, F.lit(0), lambda s, x: s + 64 - F.bit_count(x)), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(words).isNull(), F.coalesce(col(text_col), F.lit(""))).otherwise(F.array_join(left, "\n")).alias(kept),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """keep_bitmaps, then apply_bitmaps."""
    return apply_bitmaps(docs, written(keep_bitmaps(docs, id_col, text_col, min_docs, keep_first)), id_col, text_col)
