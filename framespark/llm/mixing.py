"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only.

Each source's documents are shuffled by a hash and laid end to end; the words are cut into blocks of equal length. Slots
of the schedule are points of a golden-ratio sequence, mapped through the sources' cumulative weights, so any stretch of
the schedule mixes sources nearly in proportion. The k-th slot of a source takes its k-th block; blocks start over when a
source is used up. Slots that a source gets beyond its number go to sources that got fewer, and the last block of a pass
is cut where the target ends, so every source gives its target to the word; the points decide the order of the mix, which
is that of the slots and, in a slot, of the block's words.

Positions are prefix sums in two levels (bucket totals, then within a bucket), so no source lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 1024
SEED = "mix"
#: Rows in a bucket of the shuffled order, on average.
BUCKET_ROWS = 500
#: The golden-ratio sequence on a lattice of a prime number of points: point j is j * GOLDEN mod POINTS.
POINTS, GOLDEN = 2_147_483_647, 1_327_217_884
CELLS = 1024
SLOT_CHUNK = 20_000


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Weights repeat over the sources in code-point order, null last. The total is share * all words. A source's target is
    min(repeats * size, level * weight): the level at which the targets sum to the total, which is where resharing the
    excess by weight ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    s = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")).alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("full_at", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * share)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    # these levels rise up to that of the first source that the total doesn't fill, and fall from there
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def shuffled_spans(sized: DataFrame, rows: int, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `start`, the words before a document in its source's shuffled order, to (doc_id, source, size, tie, nth).

    The order is that of a hash of the id; rows without one, or whose id more than a bucket's rows share, are shuffled by
    their texts too (rows that are the same in all stay in one bucket, as numbers).
    """
    buckets = max(1, min(1 << 20, rows // bucket_rows))
    often = materialize(sized.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where(F.col("m") > bucket_rows).select("doc_id", F.lit(True).alias("often")), "mix_often")
    sized = sized.join(often, "doc_id", "left") if often.limit(1).count() else sized.withColumn("often", F.lit(None).cast("boolean"))
    by = F.when(F.col("doc_id").isNull() | F.col("often"), F.concat_ws(":", F.col("doc_id").cast("string"), "tie")).otherwise(F.col("doc_id").cast("string"))
    sized, h = sized.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), by))).drop("often"), F.col("h")
    # the order is that of the hash, so the bucket is its leading part, scaled
    lead = F.conv(F.substring(h, 1, 7), 16, 10).cast("long")
    keyed = sized.select("*", F.floor(lead * buckets / (1 << 28)).cast("long").alias("bucket"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("ts"), F.col("bucket").alias("tb"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tie", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(totals, F.col("source").eqNullSafe(F.col("ts")) & (F.col("bucket") == F.col("tb")))
    return joined.select("doc_id", "source", "size", "nth", (F.col("offset") + F.col("inside")).alias("start"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, use, epoch, block, words): which block each slot takes and how many of its words.

    targets: (source, source_size, target), one row a source.
    """
    b = block_words
    whole = F.floor("target").cast("long")
    # a pass over a source of n words has ceil(n / b) blocks; passes before the last one are whole
    per_pass = F.ceil(F.col("source_size") / b).cast("long")
    last = F.col("source_size") * F.floor(whole / F.greatest("source_size", F.lit(1)))
    slots = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(whole / F.greatest("source_size", F.lit(1))) * per_pass + F.ceil((whole - last) / b))
    s = targets.select("source", "source_size", whole.alias("whole"), per_pass.alias("per_pass"), slots.cast("long").alias("slots")).where("slots > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("upto", F.sum("slots").over(order)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    edge = lambda c: F.round(c / F.col("all_slots") * POINTS).cast("long")
    s = s.withColumn("lo", edge(F.col("upto") - F.col("slots"))).withColumn("hi", edge(F.col("upto")))
    s = materialize(s, "mix_sources")  # one row a source
    n_slots = (s.agg(F.max("all_slots")).first()[0]) or 0
    # sources by the cells of a grid that their intervals touch: at most CELLS more rows than sources
    width = -(-POINTS // CELLS)
    cells = s.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = s.sparkSession.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS)).alias("point"))
    points = points.select("slot", "point", F.floor(F.col("point") / width).alias("cell"))
    drawn = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "source", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    # rank of a slot among its source's: chunk totals, then within a chunk
    totals = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("ts"), F.col("chunk").alias("tc"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = drawn.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(totals, F.col("source").eqNullSafe(F.col("ts")) & (F.col("chunk") == F.col("tc"))).select("slot", "source", (F.col("offset") + F.col("inside")).alias("use"))
    own = s.select(F.col("source").alias("os"), "slots", "per_pass", "whole", "source_size")
    ranked = materialize(ranked.join(own, F.col("source").eqNullSafe(F.col("os"))).drop("os"), "mix_slots")
    # the few slots beyond a source's number are dealt, in order, to the sources that lack some
    spare = ranked.where("use >= slots").select("slot", F.row_number().over(Window.orderBy("slot")).alias("nth"))
    got = ranked.groupBy(F.col("source").alias("gs")).agg(F.count("*").alias("got"))
    lack = own.join(got, F.col("os").eqNullSafe(F.col("gs")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    lack = lack.select(F.col("os").alias("source"), "slots", "per_pass", "whole", "source_size", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("use"))
    lack = lack.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last(), "use")))
    dealt = spare.join(lack, "nth").drop("nth")
    every = ranked.where("use < slots").unionByName(dealt.select(*ranked.columns))
    every = every.withColumn("epoch", F.floor(F.col("use") / F.col("per_pass"))).withColumn("block", F.col("use") % F.col("per_pass"))
    words = F.least(F.lit(b), F.col("source_size") - F.col("block") * b, F.col("whole") - F.col("epoch") * F.col("source_size") - F.col("block") * b)
    return every.select("slot", "source", "use", "epoch", "block", words.cast("long").alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, taken, slots, at) of every row.

    taken: the words of the document that the schedule takes, repeats counted; slots: those in which its first word is
    taken, in order, at most `repeats`; at: the words before it in its block. With keep=True the rows of docs instead, one
    for each slot in `slots`, in the order of the mix (slot, at), with all their columns, whatever these are called.

    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own; repeated
    rows are documents of their own; other columns are ignored; texts of any length are cut into blocks' pieces; an empty
    table gives an empty one.
    """
    nth = free_name("nth", docs)
    if keep:  # the rows are told apart by their place in docs, which is written so that it holds
        docs = materialize(docs.withColumn(nth, F.monotonically_increasing_id()), "mix_rows")
    row = F.col(nth) if keep else F.lit(0).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"), row.alias("nth"))
    sized = materialize(sized, "mix_sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "mix_targets")
    # `row` tells identical rows apart; it is fixed by writing it once
    spans = materialize(shuffled_spans(sized, sized.count(), seed).withColumn("row", F.monotonically_increasing_id()), "mix_spans")
    discard(sized)
    slots = materialize(schedule(targets, block_words), "mix_schedule")
    uses = slots.groupBy(F.col("source").alias("bs"), F.col("block").alias("bb")).agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("uses"))  # `repeats` at most
    # documents meet the blocks that they lie in; a block has a bounded number of words
    b = block_words
    pieces = spans.where("size > 0").withColumn("bb", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    met = pieces.join(uses, F.col("source").eqNullSafe(F.col("bs")) & (pieces["bb"] == uses["bb"])).select("row", "start", "size", (F.col("start") - pieces["bb"] * b).alias("at"), "uses")
    inside = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), u["words"]) - F.greatest(F.col("at"), F.lit(0))))
    # one of a row's pieces holds its first word
    first = F.when(F.col("at") >= 0, F.transform(F.filter("uses", lambda u: u["words"] > F.col("at")), lambda u: u["slot"]))
    taken = met.groupBy("row").agg(F.sum(inside).alias("taken"), F.max(first).alias("slots"))
    if keep:
        order = spans.join(taken.where("size(slots) > 0"), "row").select(F.col("nth").alias(nth), F.explode("slots").alias(slot := free_name("slot", docs)), F.pmod("start", F.lit(b)).alias(at := free_name("at", docs)))
        out = docs.join(order, nth)
        return out.orderBy(slot, at).select(*[out[c] for c in docs.columns if c != nth])
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    out = spans.join(taken, "row", "left").join(t, F.col("source").eqNullSafe(F.col("ts")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "start", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"), F.pmod("start", F.lit(b)).alias("at"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.get("slots", F.lit(0)).alias("first_slot"), F.get("slots", F.lit(1)).alias("second_slot"), "at")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
s4 AS (SELECT *, max(lv) OVER () AS level FROM s3),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM s4),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
-- the schedule: slots of each source, points of the golden-ratio sequence, ranks, slots dealt anew
n0 AS (SELECT source, source_size, CAST(floor(target) AS BIGINT) AS whole, (source_size + 1023) // 1024 AS per_pass, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS passes FROM t),
n1 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE passes * per_pass + (whole - passes * source_size + 1023) // 1024 END AS slots FROM n0),
n2 AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS all_slots FROM n1 WHERE slots > 0),
n3 AS (SELECT *, CAST(round((upto - slots) / all_slots * 2147483647) AS BIGINT) AS lo, CAST(round(upto / all_slots * 2147483647) AS BIGINT) AS hi FROM n2),
points AS (SELECT slot, slot * 1327217884 % 2147483647 AS point FROM (SELECT unnest(range((SELECT max(all_slots) FROM n3))) AS slot)),
drawn AS (SELECT n3.*, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS use FROM points JOIN n3 ON point >= lo AND point < hi),
spare AS (SELECT slot, row_number() OVER (ORDER BY slot) AS nth FROM drawn WHERE use >= slots),
got AS (SELECT source, count(*) AS got FROM drawn GROUP BY source),
lack AS (SELECT n3.*, unnest(range(coalesce(got, 0), slots)) AS use FROM n3 LEFT JOIN got ON n3.source IS NOT DISTINCT FROM got.source WHERE coalesce(got, 0) < slots),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST, use) AS nth FROM lack),
uses AS (
  SELECT source, source_size, whole, per_pass, slot, use FROM drawn WHERE use < slots
  UNION ALL SELECT source, source_size, whole, per_pass, slot, use FROM ranked JOIN spare USING (nth)),
blocks AS (SELECT *, use // per_pass AS epoch, use % per_pass AS block FROM uses),
words AS (SELECT source, slot, block, least(1024, source_size - block * 1024, whole - epoch * source_size - block * 1024) AS words FROM blocks),
firsts AS (
  SELECT p.doc_id, min(slot) AS first_slot, CASE WHEN count(*) > 1 THEN max(slot) END AS second_slot
  FROM p JOIN words w ON p.source IS NOT DISTINCT FROM w.source AND p.start // 1024 = w.block AND w.words > p.start % 1024 AND p.size > 0 GROUP BY p.doc_id)
SELECT p.doc_id, size, source_size, round(target, 6) AS target,
  CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start)) AS BIGINT) AS taken,
  first_slot, second_slot, start % 1024 AS at
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN firsts ON p.doc_id = firsts.doc_id
"""
