"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scimap.llm.common import col, count_words, fresh, meet, written


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """parties with column out: each group's seats dealt to its rows by highest quotients weight / (2 s + 1).

    The seats of a row differ from its exact share by a few at most (the more, the larger its share and the group), so
    only the quotients about the share are ranked; below them all seats are sure. Ties go by the row's own order key,
    the column `key`. Weights of zero get no seats.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumn("_sum", F.sum(weight).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    part = F.coalesce(F.try_divide(F.col(weight), F.col("_sum")), F.lit(0.0))
    p = p.withColumn("_slack", (F.lit(2) + F.ceil(F.col("_n") * part)).cast("long"))
    p = p.withColumn("_base", F.greatest(F.lit(0).cast("long"), F.floor(part * F.col(seats)).cast("long") - F.col("_slack")))
    p = p.withColumn("_rest", F.col(seats) - F.sum("_base").over(w))
    q = p.where(F.col(weight) > 0).withColumn("_s", F.explode(F.expr("sequence(_base, _base + 2 * _slack)")))
    rank = F.row_number().over(w.orderBy((F.col(weight) / (2 * F.col("_s") + 1)).desc(), "key", "_s"))
    won = q.withColumn("_r", rank).where(F.col("_r") <= F.col("_rest")).groupBy(*group, "key").agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_won_{c}") for c in [*group, "key"]], "_won")
    on = F.lit(True)
    for c in [*group, "key"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_won_{c}"))
    keep = [F.col(c) for c in parties.columns]
    return p.join(won, on, "left").select(*keep, (F.when(F.col(weight) > 0, F.col("_base")).otherwise(F.lit(0)) + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(key, source_size) -> with target: the sources share the sum of all sizes by weight.

    Sources by code point, null last, have the weights in turn. No target is above most times its source's size; the
    excess goes to the others by weight. With the sources in the order of the level at which they are full, the level
    that holds is the first that does not exceed the next source's: no repeated rounds are needed.
    """
    order = Window.partitionBy("_one").orderBy(F.col("key").asc_nulls_last())
    s = sizes.withColumn("_one", F.lit(1)).withColumn("_i", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * most).withColumn("_full", F.col("_cap") / F.col("weight"))
    up = Window.partitionBy("_one").orderBy("_full", "_i")
    all_ = Window.partitionBy("_one")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_all", F.sum("source_size").over(all_))
    spent, gone = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", (F.col("_all") - spent) / (F.sum("weight").over(all_) - gone))
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_i", "_level"))).over(all_)["_level"]
    return s.select("key", "source_size", "_all", F.least(F.col("_cap"), level * F.col("weight")).alias("target"))


#: Equal rows that go to one shard together.
ALIKE = 256


def counted(d: DataFrame) -> DataFrame:
    """d's distinct rows in blocks of at most ALIKE equal ones: _block is the block's number, _alike how many it has.

    Equal rows are counted by partial aggregates first, so that no group of copies is one task's.
    """
    rows = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {ALIKE})")))
    return rows.withColumn("_alike", F.expr(f"least({ALIKE}L, _copies - _block * {ALIKE})")).drop("_copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block_words: int = 16, shard_words: int = 1 << 19, most_shards: int = 1 << 16, seed: int = 7) -> DataFrame:
    """docs' ids and sizes with what the mix takes: id, size, source_size, target, taken, source key, text hash and times.

    Sizes are words. Each source's documents are dealt by hash, equal rows in blocks, to shards of about shard_words words (of more, if these
    were more than most_shards: the shards of a source are apportioned together); in a shard, in seeded order, they are
    a stream cut into blocks of block_words words (the last may be shorter). Highest quotients
    give each source a number of blocks by its target, and of these each shard its quota by its size. A shard takes
    all its blocks as often as its quota's words hold its size, and as many blocks as are left of the quota once more,
    evenly spaced from a seeded start. taken counts a document's
    words in taken blocks, at most `most` times its size. times is taken / size rounded up or down, so that whole
    documents come near the quota too: in each shard, by size, the fractions are added up, and who passes a whole number
    is rounded up. The words so gained or lost in a shard are no more than its longest document's. Documents of size 0
    are in no block; their times are 1. Texts are read once: then only ids, sizes and hashes are written and move.

    Null texts have size 0, null sources are a source of their own, null ids and repeated rows are documents like any
    other; equal rows need not be taken alike. An empty table gives no rows. If all sizes are 0, all targets are 0.
    """
    d = docs.select(col(id_col).alias("id"), col(source_col).alias("source"), count_words(col(text_col)).alias("size"), F.xxhash64(col(text_col)).alias("text_hash"))
    d = written(d)
    sources = source_targets(d.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("_one", F.lit(1)).withColumn("_seats", F.round(F.col("_all") / block_words).cast("long"))
    sources = apportion(sources, ["_one"], "target", "_seats", "blocks")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(most_shards), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    d = counted(d).join(sources.drop("_one", "_seats", "_all"), F.col("source").eqNullSafe(F.col("key"))).drop("key")
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash") + F.col("_block"), F.col("shards")))
    # blocks of equal rows are rows again only where their shard is
    d = d.repartition("source", "shard").withColumn("_copy", F.explode(F.expr("sequence(1L, _alike)"))).drop("_block", "_alike", "_copy")
    cell = Window.partitionBy("source", "shard")
    stream = cell.orderBy("order", "id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = d.groupBy("source", F.col("shard").alias("key")).agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quota = apportion(sums, ["source"], "shard_size", "blocks", "quota").select(F.col("source").alias("_s"), F.col("key").alias("_k"), "shard_size", "quota")
    d = d.withColumn("order", F.xxhash64(F.lit(seed + 1), "id", "text_hash")).withColumn("end", F.sum("size").over(stream))
    d = d.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")))
    d = d.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long"))
    d = d.withColumn("words", F.col("quota") * block_words)
    d = d.withColumn("passes", F.least(F.lit(most).cast("long"), F.coalesce(F.expr("try_divide(words, shard_size)").cast("long"), F.lit(0))))
    rest = F.least(F.col("n"), F.round((F.col("words") - F.col("passes") * F.col("shard_size")) / block_words).cast("long"))
    d = d.withColumn("rest", F.when(F.col("passes") < most, rest).otherwise(0))
    d = d.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n")))

    def upto(x: str) -> str:
        """SQL: the words before the stream's word x that lie in blocks taken once more."""
        b = f"({x} div {block_words})"
        count = lambda b: f"(({b} * rest + start) div n)"
        return f"({count(b)} * {block_words} + ({count(f'({b} + 1)')} - {count(b)}) * ({x} % {block_words}))"

    taken = F.expr(f"passes * size + {upto('end')} - {upto('(end - size)')}")
    d = d.withColumn("taken", taken.cast("long"))
    # in 32768ths, so that sums are exact
    part = F.when(F.col("size") > 0, F.expr("((taken % size) * 32768L) div size")).otherwise(0)
    by_size = cell.orderBy("size", "order", "id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "shard"), F.lit(32768))
    d = d.withColumn("part", part).withColumn("sum", F.sum("part").over(by_size) + start)
    up = F.expr("sum div 32768L - (sum - part) div 32768L")
    d = d.withColumn("times", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("taken div size") + up).cast("int"))
    return d.select("id", "source", "text_hash", "size", "source_size", F.col("target").cast("double"), "taken", "times")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it whole: `times` of mix().

    So a source's words come near its target, and no row is there more than `most` times. Rows of size 0 are not part
    of any block; they stay once. Repeated rows get the same number, that of the one with most. Columns are those of docs.
    """
    th, times, own, own_source, own_th = fresh(docs, "text_hash", "times", "own_id", "own_source", "own_hash")
    m = mix(docs, id_col, text_col, source_col, **options)
    m = m.groupBy(F.col("id").alias(own), F.col("source").alias(own_source), F.col("text_hash").alias(own_th)).agg(F.max("times").alias(times))
    m = written(m, small=True)
    on = col(id_col).eqNullSafe(F.col(own)) & col(source_col).eqNullSafe(F.col(own_source)) & (F.col(th) == F.col(own_th))
    d = meet(docs.withColumn(th, F.xxhash64(col(text_col))), m, on)
    d = d.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return d.select(*[col(c) for c in docs.columns])
