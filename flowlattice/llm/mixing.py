"""Mixing sources to target weights by hash-threshold histograms.

A source's target is a number of words. Whole epochs of the source come first; the rest of the budget is met by the documents whose
hash lies below a threshold, so a smaller budget takes a subset of what a larger one takes. The threshold is found without sorting:
words are summed by source and hash bucket, the running sum over a source's 4,096 buckets shows in which bucket the budget ends, and only
that bucket is cut into 4,096 again, until it holds one document. That document is taken if this comes nearer to the target.

The hash is 60 bits of the md5 of id and text, so reruns agree. Repeated rows share it; below it their buckets are cut by the number that
every row gets when the sizes are written, so of c equal rows as many are taken as fit, whichever they are.

Only DataFrame functions are used. The driver holds a few sums; sources are a table, so their number is not bounded.
"""

from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlattice.llm import common

DIGIT = 12
HASH_BITS, ROW_BITS = 60, 63
SHARE, MAX_EPOCHS = Fraction(3, 2), 2
CYCLE = (3, 1, 2)
MADE = ("size", "source_size", "target", "taken")
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs, carry=()):
    """(doc_id, source, carried columns, size, _hash, _row), written to the shared folder: one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    kept = [c for c in dict.fromkeys(("doc_id", "source", *carry)) if c not in (*MADE, "_hash", "_row")]
    return common.materialized(docs.select(
        *kept, F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("_hash"), F.monotonically_increasing_id().alias("_row")), "sized")


def cycled(sources, cycle=CYCLE):
    """(source, weight): sources by code point, null last, weigh `cycle`, repeating.

    Ranks are a range sort, a number within each part and the parts' sizes, one number per part on the driver.
    """
    part = F.shiftright("_at", 33)
    ranked = common.materialized(
        sources.select("source").distinct().orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before, places = 0, {}
    for row in sorted(ranked.groupBy(part.alias("part")).count().collect()):
        places[row["part"]], before = before, before + row["count"]
    if not places:
        return ranked.select("source", F.lit(1).alias("weight"))
    offset = F.create_map(*(F.lit(x) for pair in places.items() for x in pair))[part]
    rank = offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weights = F.array(*(F.lit(w) for w in cycle))
    return ranked.select("source", F.get(weights, F.pmod(rank, F.lit(len(cycle))).cast("int")).alias("weight"))


def targets(totals, share=SHARE, max_epochs=MAX_EPOCHS):
    """Add `target` to (source, source_size, weight): `share` of all sizes by weight, none above `max_epochs` times its size.

    The target is min(max_epochs * size, weight * level). The level rises from round to round as sources reach their ceiling and
    leave, and the driver holds two sums of each round.
    """
    ceiling = F.col("source_size") * max_epochs
    budget = share * int(totals.agg(F.sum("source_size")).first()[0] or 0)
    full, level, before = F.lit(False), 0.0, None
    while True:
        open_weight, filled = totals.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, ceiling))).first()
        if (open_weight, filled) == before or not open_weight:
            break
        before = open_weight, filled
        left = (budget - int(filled or 0)) / int(open_weight)
        level = left.numerator / left.denominator
        full = F.col("weight") * F.lit(level) > ceiling
    whole = ceiling.cast("double")
    return totals.withColumn("target", F.least(whole, F.col("weight") * F.lit(level)) if open_weight else whole)


def _digit(level):
    """Bits of the hash, then of the row number, that level `level` counts by."""
    low = HASH_BITS - DIGIT * (level + 1)
    if low >= 0:
        return F.shiftright("_hash", low).bitwiseAND(F.lit((1 << DIGIT) - 1))
    low = max(0, ROW_BITS - DIGIT * (level + 1 - HASH_BITS // DIGIT))
    return F.shiftright("_row", low).bitwiseAND(F.lit((1 << DIGIT) - 1))


LEVELS = HASH_BITS // DIGIT + -(-ROW_BITS // DIGIT)


def _histogram(rows, level):
    return rows.groupBy("source", _digit(level).alias("_bucket")).agg(
        F.sum("size").alias("_words"), F.count("*").alias("_rows"), F.max("_hash").alias("_cut_hash"), F.max("_row").alias("_cut_row"))


def _boundary(histogram, budgets):
    """Per source the bucket in which its budget `_left` ends and what is left of it there; at most 4,096 buckets a source."""
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket"))
    found = histogram.withColumn("_upto", upto).join(
        budgets.select(F.col("source").alias("_of"), "_left"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    found = found.where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_words") <= F.col("_left")))
    return common.materialized(found.withColumn("_left", F.col("_left") - (F.col("_upto") - F.col("_words"))).drop("_upto"), "boundary")


def thresholds(sizes, budgets):
    """(source, _cut_hash, _cut_row, _take): the document where each source's budget `_left` (source, _left) ends.

    Documents before it, by hash and row number, are within the budget; `_take` says whether taking it comes nearer.
    Sources whose budget is 0 or whose size is 0 may be missing.
    """
    rows, done = sizes.where("size > 0").select("source", "size", "_hash", "_row"), None
    for level in range(LEVELS):
        edge = _boundary(_histogram(rows, level), budgets)
        single = edge.where("_rows = 1").select(
            "source", "_cut_hash", "_cut_row", (F.col("_left") * 2 >= F.col("_words")).alias("_take"))
        done = single if done is None else done.unionByName(single)
        budgets = edge.where("_rows > 1")
        if budgets.isEmpty():
            return done
        inside = budgets.select(F.col("source").alias("_of"), F.col("_bucket").alias("_in"))
        rows = common.materialized(
            rows.join(inside, F.col("source").eqNullSafe(F.col("_of")) & (_digit(level) == F.col("_in"))).drop("_of", "_in"), "edge")
    raise AssertionError("row numbers are unique")


def mix(docs, weights=None, share=SHARE, max_epochs=MAX_EPOCHS, carry=()):
    """How many words of every row of `docs` (doc_id, text, source) a mix of the sources takes, and its source's target.

    `weights` is (source, weight) with positive weights; without it sources in order weigh 3, 1, 2, repeating. `share` (a Fraction) of all words are spread over
    them. Returns doc_id, source, the columns `carry`, size, source_size, target, taken: `taken` is the size times the number of times
    the mix repeats the document, at most `max_epochs`.

    A null text has size 0, as has one of white space; such rows take 0 words. The null source is a source of its own, a source
    without a weight weighs 1. Null ids are documents like others. Of repeated rows as many are taken as come nearest to the target.
    An empty table gives no rows. Other columns are not read; a carried one named as a made one gives way.
    """
    sizes = sized(docs, carry)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = (cycled(totals) if weights is None else weights).select(F.col("source").alias("_of"), "weight")
    totals = common.materialized(totals.join(weights, F.col("source").eqNullSafe(F.col("_of")), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(1)).alias("weight")), "totals")
    aimed = common.materialized(targets(totals, share, max_epochs).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")), "targets")
    cuts = thresholds(sizes, aimed.select("source", "_left").where("_left > 0")).withColumnRenamed("source", "_cut")
    plan = common.materialized(aimed.join(cuts, F.col("source").eqNullSafe(F.col("_cut")), "left").select(
        F.col("source").alias("_of"), "source_size", "target", "_epochs", "_cut_hash", "_cut_row", "_take"), "plan")
    inside = (F.col("_hash") < F.col("_cut_hash")) | (F.col("_hash") == F.col("_cut_hash")) & (
        (F.col("_row") < F.col("_cut_row")) | (F.col("_row") == F.col("_cut_row")) & F.col("_take"))
    taken = F.col("size") * (F.col("_epochs") + F.coalesce(inside, F.lit(False)).cast("bigint"))
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("_of"))).select(
        *[c for c in sizes.columns if c not in ("size", "_hash", "_row")], "size", "source_size", "target", taken.alias("taken"))


def mixed(docs, **options):
    """The mix itself: every row of `docs` as often as it is taken, with its columns; rows without words are left out."""
    made = mix(docs, carry=[c for c in docs.columns if c not in MADE], **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return made.where("taken > 0").select("*", F.explode(F.sequence(F.lit(1), times)).alias("epoch"))


def op11_mixing(spark, sf_dir):
    return mix(common.table(spark, sf_dir, "documents")).drop("source")


ORACLE_OP11 = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT a.k, (1.5 * (SELECT sum(source_size) FROM totals) - coalesce(sum(b.source_size) FILTER (b.k < a.k), 0) * 2)
      / sum(b.weight) FILTER (b.k >= a.k) AS level, any_value(2 * a.source_size / CAST(a.weight AS DOUBLE)) AS ceiling
  FROM ordered a CROSS JOIN ordered b GROUP BY a.k),
chosen AS (SELECT level FROM levels WHERE level <= ceiling ORDER BY k LIMIT 1),
aimed AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT CAST(level AS DOUBLE) FROM chosen)) AS target
  FROM ordered),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aimed),
summed AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.digest, 1, 15), d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= extra THEN 1 WHEN upto - size <= extra AND 2 * (extra - (upto - size)) >= size AND extra > 0
    THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
