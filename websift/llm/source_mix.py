"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a keyed hash and laid end to end as one stream of words, read at most twice and
cut into blocks of equally many words. Slots of the schedule get the points ``frac((i + 1) * golden ratio)``; a
point falls into one source's part of the cumulative weights, so every stretch of the schedule holds the sources
close to their weights. A slot's rank among its source's slots names the block that it takes.

Native DataFrame operations only. Running sums and ranks are made in two levels (buckets, then rows in a
bucket), so no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import stored

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 256
CELLS = 4096                # of the unit interval, to find a point's source by an equality join
CHUNK = 1 << 16             # slots ranked together
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows of ``source`` and ``size``.

    Sources by code point, null last, take the weights in turn. Of ``share`` times all words each gets its weight's
    part, up to ``most`` times its own size; what is over goes to the others by weight until none is above. With
    sources by ``cap / weight``, that is one water level: the first source whose cap is above the level of the rest sets it.
    One row per source stands in these windows.
    """
    by_name, by_ratio, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = (s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
         .withColumn("cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share))))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
         .withColumn("place", F.row_number().over(by_ratio)))
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(whole)
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """``sizes`` plus ``start``: words before the row in its source's shuffled stream."""
    bucket = sizes.withColumn("bucket", F.substring("h", 1, 3))
    sums = bucket.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = bucket.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("base") + F.col("inner")).drop("s", "b", "bucket", "base", "inner"))


def _slots(targets: DataFrame, block_words: int) -> DataFrame:
    """``slot``, ``source``, ``rank``: as many slots for each source as its target has blocks."""
    spark = targets.sparkSession
    t = targets.withColumn("need", F.ceil(F.floor("target") / F.lit(block_words)))
    total = t.agg(F.sum("need")).first()[0] or 0
    w = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    parts = t.withColumn("hi", F.sum("need").over(w) / F.lit(max(total, 1))).withColumn("lo", F.col("hi") - F.col("need") / F.lit(max(total, 1)))
    cells = parts.where("need > 0").select("source", "lo", "hi", "need", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    points = (spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN)).alias("x"))
              .select("slot", (F.col("x") - F.floor("x")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS)))
    # rounding leaves no point without a source: what lies between two parts is dropped here and added below
    hit = points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source", "need", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = hit.withColumn("inner", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = (own.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("k")))
              .select("slot", "source", (F.col("base") + F.col("inner")).alias("rank"), "need").where("rank < need").drop("need"))
    # the points leave each source a few slots above or below its need: above are dropped, below follow at the end
    had = hit.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("had"))
    missing = (t.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
               .select("source", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")))
    return ranked.unionByName(missing.select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(taken, pieces)``.

    ``taken``: per row ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words of the mix, repeats counted),
    ``first_slot`` and ``last_slot`` (of the schedule; -1 where nothing is taken) and the ``carried`` columns, which may not name another one.
    ``pieces``: ``slot``, ``source``, ``doc_id``, ``pass`` (0 or 1), ``words``: the schedule itself.

    Null texts have no words and are never taken; a null source is a source. Rows of one id are told apart by text; equal
    rows share their result in any order. Long texts are counted whole; no rows give none. Reruns agree: the shuffle is a hash of ``seed``, id and text,
    so rows without an id spread as well.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                        F.xxhash64(text_col).alias("tie"), F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit("")))), 1, 16).alias("h"), *carried)
    sizes = stored(sizes.repartition("h"), "mix-sizes")          # the words are counted once
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    placed = _offsets(sizes).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    limit = F.floor("target")
    spans = (placed.where("size > 0").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size"))
             .withColumn("hi", F.least(F.col("lo") + F.col("size"), limit)).where("hi > lo")
             .withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}")))))
    slots = _slots(targets, block_words).withColumnRenamed("source", "s").withColumnRenamed("rank", "r")
    met = spans.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    pieces = met.select("row", "slot", "source", "doc_id", "pass",
                        (F.least("hi", (F.col("rank") + 1) * block_words) - F.greatest("lo", F.col("rank") * block_words)).alias("words"))
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    taken = placed.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                                                    F.coalesce("first_slot", F.lit(-1)).alias("first_slot"), F.coalesce("last_slot", F.lit(-1)).alias("last_slot"), *carried)
    return taken, pieces.drop("row")


# Words taken in closed form (a source's stream from its start up to the target); the schedule's slots point by point.
ORACLE = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, ''))[1:16] as h
  from documents),
named as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sizes group by source),
caps as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio,
         sum(source_size) over ()::double * 1.5::double as budget from named),
levels as (
  select *, row_number() over w as place,
         (budget - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (w rows between current row and unbounded following) as level
  from caps window w as (order by ratio, source nulls last)),
targets as (
  select source, source_size,
         least(cap, coalesce((select level from levels where ratio >= level order by place limit 1) * weight, cap)) as target from levels),
needs as (
  select source, ceil(floor(target) / 256)::bigint as need, (sum(ceil(floor(target) / 256)) over ())::bigint as total from targets),
parts as (
  select source, need, total, (sum(need) over (order by source nulls last rows unbounded preceding))::double / greatest(total, 1) as hi,
         need::double / greatest(total, 1) as part from needs),
points as (
  select slot, (slot + 1) * 6.180339887498949e-1 - floor((slot + 1) * 6.180339887498949e-1) as x
  from (select unnest(range((select max(total) from needs))) as slot)),
hit as (
  select slot, source, need, row_number() over (partition by source order by slot) - 1 as rank
  from points join parts on x >= hi - part and x < hi where need > 0),
had as (select source, count(*) as n from hit group by source),
slots as (
  select slot, source, rank from hit where rank < need
  union all
  select total + rank, source, rank
  from (select total, needs.source, unnest(range(coalesce(n, 0), need)) as rank from needs left join had on needs.source is not distinct from had.source)),
placed as (
  select row_number() over () as r, doc_id, source, size,
         coalesce(sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sizes),
passes as (
  select r, placed.source, start + pass * source_size as lo, least(start + pass * source_size + size, floor(target)::bigint) as hi
  from placed join targets on placed.source is not distinct from targets.source, (values (0), (1)) as t(pass)),
spans as (select r, source, unnest(range(lo // 256, (hi - 1) // 256 + 1)) as rank from passes where hi > lo),
seen as (
  select r, min(slot) as first_slot, max(slot) as last_slot
  from spans join slots on spans.source is not distinct from slots.source and spans.rank = slots.rank group by r),
words as (select r, sum(greatest(0, hi - lo))::bigint as taken from passes group by r)
select doc_id, size, source_size, target, taken, coalesce(first_slot, -1) as first_slot, coalesce(last_slot, -1) as last_slot
from placed join targets on placed.source is not distinct from targets.source join words using (r) left join seen using (r)
"""
