"""Mix sources to target weights on a low-discrepancy schedule, with DataFrame functions only.

Every source's documents, shuffled by a digest of their id, form a stream of
words that is cut into blocks of equal length. Slot ``k`` of the schedule goes
to the source whose interval of the cumulative slot shares holds the
golden-ratio point ``frac(k * 0.618...)``; the slots of a source are ranked and
the r-th takes the r-th block of its stream, starting again after the last
block. Slots after a source's target are left out and its last slot is cut, so
a source gives its target to the word (rounded down).

Ranks and stream positions are prefix sums in two levels (chunks of slots,
digest buckets of documents), so no task ever sorts a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from respondex.llm.base import count_words, stored

GOLDEN = 0.6180339887498949
#: No source waits longer than 1.9 / share points between two of its own (three-gap theorem).
POINTS_PER_SLOT = 4
CHUNK = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeat: int) -> DataFrame:
    """One row per source with ``sidx`` (code point order, null last), ``source_size`` and ``target``.

    Targets are ``least(max_repeat * source_size, level * weight)``: giving a
    capped source's excess to the others by weight until none is above its cap
    ends at that level, found here from sums over the sources sorted by
    cap / weight.
    """
    w = F.array(*[F.lit(int(x)) for x in weights])
    src = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sidx", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("weight", F.element_at(w, (F.col("sidx") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = W.orderBy("ratio", "sidx")
    src = (
        src.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("position", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    )
    first_fit = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("position"))).over(W.partitionBy())
    return (
        src.withColumn("level", first_fit)
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")))
        .select("source", "sidx", "source_size", "target", "total")
    )


def plan_slots(targets: DataFrame, blocks_per_source: int, max_block_words: int) -> DataFrame:
    """Block length, number of blocks and of slots, and the interval of every source."""
    by_index = W.orderBy("sidx").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    n_sources = F.count(F.lit(1)).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(max_block_words), F.floor(F.col("total") / (n_sources * blocks_per_source)))).cast("long")
    return (
        targets.withColumn("block_words", block)
        .withColumn("goal", F.floor("target").cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("n_slots", F.col("rounds") * F.col("n_blocks") + F.ceil((F.col("goal") - F.col("rounds") * F.col("source_size")) / F.col("block_words")).cast("long"))
        .withColumn("all_slots", F.sum("n_slots").over(everything))
        .withColumn("slots_before", F.coalesce(F.sum("n_slots").over(by_index), F.lit(0)))
        .withColumn("low", F.col("slots_before") / F.greatest(F.col("all_slots"), F.lit(1)))
        .withColumn("high", (F.col("slots_before") + F.col("n_slots")) / F.greatest(F.col("all_slots"), F.lit(1)))
        .drop("slots_before", "total")
    )


def source_schedule(plan: DataFrame) -> DataFrame:
    """The mix in order: ``slot, sidx, round, block, block_words_taken``.

    The source of a point is found by an equality join on cells of the unit
    interval; a cell meets few source intervals.
    """
    spark = plan.sparkSession
    head = plan.agg(F.max("all_slots").alias("k"), F.count(F.lit(1)).alias("n")).first()
    points, cells = POINTS_PER_SLOT * int(head["k"] or 0), 16 * max(int(head["n"]), 1)
    intervals = plan.where("n_slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    x = F.col("slot") * F.lit(GOLDEN)
    slots = (
        spark.range(points).select(F.col("id").alias("slot"))
        .withColumn("u", x - F.floor(x))
        .withColumn("cell", F.floor(F.col("u") * cells))
        .join(intervals, "cell")
        .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    )
    before = (
        slots.groupBy("sidx", "chunk").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("sidx").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    ranked = (
        slots.join(before, ["sidx", "chunk"])
        .withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("sidx", "chunk").orderBy("slot")) - 1)
        .where(F.col("rank") < F.col("n_slots"))
        .withColumn("round", F.floor(F.col("rank") / F.col("n_blocks")))
        .withColumn("block", F.col("rank") - F.col("round") * F.col("n_blocks"))
    )
    start = F.col("block") * F.col("block_words")
    length = F.least(F.col("block_words"), F.col("source_size") - start)
    left = F.col("goal") - F.col("round") * F.col("source_size") - start
    return ranked.select("slot", "sidx", "round", "block", length.alias("block_length"), F.least(length, left).alias("words_taken"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    blocks_per_source: int = 1000,
    max_block_words: int = 65536,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs`` (columns doc_id, text, source).

    ``taken`` counts the words of the row in the mix, repeats included, and is
    ``max_repeat`` times its size at most. Null and empty texts have size and
    taken 0; a null source is a source of its own, the last; a null doc_id is
    shuffled like an empty one; repeated rows are rows of their own; an empty
    table gives an empty result; other columns are ignored. Sources are a
    dimension: one row each is sorted in one task.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), digest.alias("digest")), "mix-sizes")
    plan = stored(plan_slots(source_targets(sizes, weights, share, max_repeat), blocks_per_source, max_block_words), "mix-plan")
    takes = (
        source_schedule(plan).groupBy("sidx", "block")
        .agg(F.count(F.when(F.col("words_taken") == F.col("block_length"), 1)).alias("whole"), F.max(F.when(F.col("words_taken") < F.col("block_length"), F.col("words_taken"))).alias("part"))
    )
    rows = (
        sizes.withColumnRenamed("source", "_source")
        .join(plan.select("source", "sidx", "source_size", "target", "block_words"), F.col("_source").eqNullSafe(F.col("source")))
        .drop("_source")
        .withColumn("bucket", F.substring("digest", 1, 3))
    )
    buckets = (
        rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("sidx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    inside = W.partitionBy("sidx", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(buckets, ["sidx", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    first, last = F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start") - F.col("block") * F.col("block_words"), F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * F.col("block_words"), F.col("block_words"))
    words = (high - low) * F.coalesce(F.col("whole"), F.lit(0)) + F.greatest(F.lit(0), F.least(high, F.coalesce(F.col("part"), F.lit(0))) - low)
    key = ["sidx", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = pieces.join(takes, ["sidx", "block"], "left").groupBy(*key).agg(F.sum(words).cast("long").alias("taken"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return taken.select(*out).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixing_sql(weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, blocks_per_source: int = 1000, max_block_words: int = 65536, seed: str = "mix") -> str:
    """The same mix in DuckDB SQL, with plain windows over whole sources."""
    w = ", ".join(map(str, weights))
    return f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx FROM sizes GROUP BY source),
s1 AS (SELECT *, [{w}][sidx % {len(weights)} + 1] AS weight, source_size * {max_repeat} AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * {share}::DOUBLE AS total FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, sidx) AS position,
  (total - coalesce(sum(cap) OVER (ORDER BY ratio, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, position) FROM s3 WHERE level <= ratio) AS found FROM s3),
s5 AS (SELECT source, sidx, source_size, coalesce(least(cap::DOUBLE, found * weight), cap::DOUBLE) AS target,
  greatest(1, least({max_block_words}, floor(total / (count(*) OVER () * {blocks_per_source}))))::BIGINT AS bw FROM s4),
s6 AS (SELECT *, floor(target)::BIGINT AS goal, ceil(source_size / bw)::BIGINT AS n_blocks, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds FROM s5),
s7 AS (SELECT *, rounds * n_blocks + ceil((goal - rounds * source_size) / bw)::BIGINT AS n_slots FROM s6),
plan AS (SELECT *, coalesce(sum(n_slots) OVER (ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(n_slots) OVER (), 1) AS low,
  sum(n_slots) OVER (ORDER BY sidx) / greatest(sum(n_slots) OVER (), 1) AS high FROM s7),
points AS (SELECT slot, slot * {GOLDEN!r}::DOUBLE - floor(slot * {GOLDEN!r}::DOUBLE) AS u FROM (SELECT unnest(range((SELECT {POINTS_PER_SLOT} * sum(n_slots)::BIGINT FROM plan))) AS slot)),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY sidx ORDER BY slot) - 1 AS rank FROM points JOIN plan p ON u >= low AND u < high AND n_slots > 0),
slots AS (SELECT *, rank // n_blocks AS round, rank % n_blocks AS block FROM ranked WHERE rank < n_slots),
takes AS (SELECT sidx, block, count(*) FILTER (taken = length) AS whole, max(taken) FILTER (taken < length) AS part FROM
  (SELECT *, least(bw, source_size - block * bw) AS length, least(bw, source_size - block * bw, goal - round * source_size - block * bw) AS taken FROM slots) GROUP BY ALL),
placed AS (SELECT doc_id, size, sidx, source_size, target, bw, coalesce(sum(size) OVER (PARTITION BY sidx ORDER BY digest, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  row_number() OVER () AS r FROM sizes z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source),
pieces AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // bw, (start + size - 1) // bw + 1) ELSE [NULL::BIGINT] END) AS block FROM placed),
cut AS (SELECT *, greatest(start - block * bw, 0) AS lo, least(start + size - block * bw, bw) AS hi FROM pieces)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  coalesce(sum((hi - lo) * coalesce(whole, 0) + greatest(0, least(hi, coalesce(part, 0)) - lo)), 0)::BIGINT AS taken
FROM cut LEFT JOIN takes ON cut.sidx = takes.sidx AND cut.block = takes.block GROUP BY r, doc_id"""
