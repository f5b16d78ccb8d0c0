"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a random but fixed order, and queue again when all have been
served, up to three times. Serving a source takes virtual time: its words so far divided by its target.
All queues are merged by the virtual time at which a document is finished, and the merged order is cut where its
words reach the total budget, in the middle of a document if need be. By virtual time 1 every source has been
served its target, so each ends within a document or so of it.

Running sums are taken in two steps, over chunks and inside them, so that neither a source with most
of the rows nor the merged order has to pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from churnloom.llm.common import word_count
from churnloom.plans.stages import cut

REPEATS = 3
WEIGHTS = 3  # 1, 2, 3, 1, ...
LEAST_CHUNKS = 256
CHUNK_ROWS = 20_000


def source_key(source: Column) -> Column:
    """A text that is never null; null itself becomes one that no source has."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source with ``source_size`` and ``target``, the words it should give.

    ``sizes`` has ``source, source_key, size``. Sources in order of code points, null last, weigh 1, 2,
    3, 1, ... No target exceeds ``REPEATS`` times the source. The sources that reach this bound are the
    first ones in order of size by weight; the others share what is left by weight.
    """
    total = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    ranked = total.select("*", (1 + (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % WEIGHTS)
                          .cast("long").alias("weight"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    left = ranked.select(
        "*", F.row_number().over(order).alias("place"),
        F.sum("source_size").over(W.partitionBy()) .alias("budget"),
        F.coalesce(F.sum(REPEATS * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("bounded"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("weights"))
    shared = left.withColumn("unit", (F.col("budget") - F.col("bounded")) / F.col("weights"))
    fits = F.col("unit") * F.col("weight") <= REPEATS * F.col("source_size")
    first = F.min(F.when(fits, F.struct("place", "unit"))).over(W.partitionBy())
    chosen = shared.withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), (REPEATS * F.col("source_size")).cast("double")) \
        .otherwise(F.col("first.unit") * F.col("weight"))
    return chosen.select("source_key", "source_size", target.alias("target"))


def _before(df: DataFrame, group: list[str], chunk: str, amount: str) -> DataFrame:
    """For each chunk of a group the sum of ``amount`` in the chunks before it."""
    sums = df.groupBy(*group, chunk).agg(F.sum(amount).alias("chunk_sum"))
    earlier = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*group, chunk, F.coalesce(F.sum("chunk_sum").over(earlier), F.lit(0)).alias("chunk_before"))


def queue(docs: DataFrame, seed: str = "", text: str = "text") -> DataFrame:
    """Every row's size and place in the queue of its source: ``doc_id, source_key, text_hash, size,
    chunk, place, before, source_size, target``. Written once, as all that follows reads it."""
    # The text is part of the draw, so that rows of one id, or of none, do not queue in one place.
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sizes = cut(docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("source_key"), F.xxhash64(text).alias("text_hash"),
        word_count(text).alias("size"), shuffled.alias("shuffled")), "sizes")
    chunks = max(LEAST_CHUNKS, sizes.count() // CHUNK_ROWS)
    share = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    placed = sizes.drop("source").withColumn("chunk", F.floor(share * chunks / F.lit(1 << 32)).cast("long"))
    goal = targets(sizes)
    bases = _before(placed, ["source_key"], "chunk", "size").join(goal, "source_key")
    inside = W.partitionBy("source_key", "chunk").orderBy("shuffled", "size", "text_hash")
    return (placed
            .withColumn("place", F.row_number().over(inside))
            .withColumn("inside", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
            .join(bases, ["source_key", "chunk"])
            .withColumn("before", F.col("chunk_before") + F.col("inside"))
            .drop("shuffled", "inside", "chunk_before"))


def merged(queued: DataFrame) -> DataFrame:
    """The mix: one row per document and round that is served, with the ``words`` it gives and where
    they start in the mix (``mix_start``), in order of ``finish``, its virtual time. The budget is the size of all documents."""
    budget = queued.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    start = F.col("round") * F.col("source_size") + F.col("before")
    entries = (queued.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
               .withColumn("finish", (start + F.col("size")) / F.col("target")))
    # All sources progress alike, so equal spans of virtual time hold about equal numbers of words.
    bins = max(LEAST_CHUNKS, budget["rows"] // CHUNK_ROWS)
    entries = entries.withColumn("span", F.floor(F.col("finish") * bins).cast("long"))
    order = W.partitionBy("span").orderBy("finish", "source_key", "chunk", "place", "round")
    sums = entries.groupBy("span").agg(F.sum("size").alias("span_sum"))
    bases = sums.select("span", F.coalesce(
        F.sum("span_sum").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("span_before"))
    # Spans that begin beyond the budget are left out before anything is ordered.
    return (entries.join(bases.where(F.col("span_before") < budget["words"]), "span")
            .withColumn("inside", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
            .withColumn("mix_start", F.col("span_before") + F.col("inside")).where(F.col("mix_start") < budget["words"])
            .withColumn("words", F.least(F.col("size"), budget["words"] - F.col("mix_start")))
            .drop("inside", "span_before", "span"))


def mix(docs: DataFrame, seed: str = "", text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id, text, source``).

    ``taken`` counts the words that the mix takes of a row, repeats included; at most ``REPEATS``
    times its size. A null or empty text has size 0 and gives nothing. A null source is a source. Repeated
    rows queue each for itself; null ids are allowed. Other columns are not read. An empty table
    gives an empty one. The same rows give the same mix, however they are partitioned.
    """
    queued = cut(queue(docs, seed, text), "queue")
    row = ["source_key", "chunk", "place"]
    taken = merged(queued).groupBy(*row).agg(F.sum("words").alias("taken"))
    return (queued.join(taken, row, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, seed: str = "") -> DataFrame:
    """The rows of ``docs`` as the mix holds them, each as often as it is taken as a whole.

    The document that the budget cuts short is in if at least half of it is served. Texts without
    words are not in. All columns of ``docs`` are kept.
    """
    queued = cut(queue(docs, seed), "queue")
    whole = merged(queued).where("2 * words >= size")
    key = ["doc_id", "source_key", "text_hash"]
    # Rows that agree in all of this are the same document; they share what is taken of them.
    copies = whole.groupBy(*key).agg(F.count("*").alias("copies"))
    rows = queued.groupBy(*key).agg(F.count("*").alias("rows"))
    wanted = rows.join(copies, [F.equal_null(rows[c], copies[c]) for c in key]).select(
        *(rows[c].alias(f"_{c}") for c in key), "copies", "rows")
    given = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id"), source_key(F.col("source")).alias("source_key"),
        F.xxhash64("text").alias("text_hash"))
    numbered = given.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("long")
    joined = numbered.join(wanted, [F.equal_null(F.col(c), F.col(f"_{c}")) for c in key])
    return (joined.withColumn("times", times).where("times > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select("row.*"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS shuffled
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
shared AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER ()
          - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS FIRST)),
first AS (SELECT place, unit FROM shared WHERE unit * weight <= 3 * source_size ORDER BY place LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN s.place < f.place THEN (3 * source_size)::DOUBLE ELSE f.unit * weight END AS target
  FROM shared s CROSS JOIN first f),
queued AS (
  SELECT row_number() OVER () AS r, d.source, doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT r, size, before, round, coalesce('s' || source, 'n') AS source_key,
         (round * source_size + before + size)::DOUBLE / target AS finish
  FROM queued CROSS JOIN range(3) AS t(round) WHERE size > 0),
merged AS (
  SELECT r, size, (sum(size) OVER (ORDER BY finish, source_key, before, round
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS mix_start
  FROM entries),
served AS (
  SELECT r, sum(greatest(0, least(size, (SELECT sum(size) FROM sized)::BIGINT - mix_start)))::BIGINT AS taken
  FROM merged GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN served USING (r)
"""
