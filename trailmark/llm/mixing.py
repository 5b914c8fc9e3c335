"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word budget. Inside a source a document's expected copies
are proportional to its measure, the number of binary digits of its word count,
so that long documents are likelier than short ones by the logarithm of their
size; what passes ``cap`` copies is shared by the rest. The whole part of the
expected copies is certain and allocated first. The fractional part is the
document's own inclusion probability: documents are ranked by the odds of a
random number divided by the odds of inclusion (Pareto ranks), and the lowest
ranks are taken until the words of the budget are met.

Documents of one measure share a line of the plan, at most 64 lines a source.
A source is never sorted in one task. The ranks, mapped to (0, 1), are cut into
2**10 slices, the slice in which the budget runs out into 2**10 again, by word
sums per (source, slice); only the rows of that last slice, a millionth of the
range, are ordered.

Defined results: a null text has size 0 and is never drawn; null sources form
one source, placed last; a null ``doc_id`` draws the number of the word "null";
repeated rows are rows of their own, with equal ranks; a source without words
has target 0; an empty table gives an empty result; other columns pass through
``mix_documents`` untouched, names that begin with ``mix_`` included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trailmark.llm.shared import stage, table

WORD = r"[^\x20\x09-\x0D]+"
LEAST_ID = -(2**63)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source -> words, target: budgets by weight, at most ``cap`` times the source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    per = per.withColumn("most", F.col("source_size") * cap).withColumn("full_at", F.col("most") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("most"), F.col("w") * F.col("level")), F.col("most"))
    return per.select("source", "source_size", target.alias("target"))


def expected_copies(bands: DataFrame, cap: float) -> DataFrame:
    """source, measure -> whole, part: copies proportional to the measure, at most ``cap``, that fill the target.

    ``bands`` has source, measure, words, source_size and target.
    """
    order = Window.partitionBy("source").orderBy(F.desc("measure"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    level = (F.col("target") - F.coalesce(F.sum("words").over(before), F.lit(0)) * cap) / F.sum(F.col("words") * F.col("measure")).over(after)
    found = bands.withColumn("full_at", F.lit(cap) / F.col("measure")).withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    copies = F.coalesce(F.least(F.lit(cap), F.col("measure") * F.col("level")), F.lit(cap))
    found = found.withColumn("whole", F.floor(copies).cast("long")).withColumn("part", copies - F.floor(copies))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)
    return found.select("source", "measure", "source_size", "target", "whole", "part", rest.alias("rest"))


def same_source(left: str, right: str):
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def pareto_mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", slice_bits: Sequence[int] = (10, 20)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of ``docs``.

    ``weights`` repeat over the sources in code-point order. Sources sum to
    ``share`` of all words; none exceeds ``cap`` times its own.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), ((draw + 0.5) / float(1 << 48)).alias("u"))
    rows = stage(rows.withColumn("measure", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)), "mix-sizes")
    bands = stage(rows.groupBy("source", "measure").agg(F.sum("size").alias("words")), "mix-bands")

    per = source_targets(bands.select("source", F.col("words").alias("size")), weights, share, cap)
    plan = bands.where("measure > 0").alias("b").join(per.alias("p"), same_source("b", "p")).select("b.source", "measure", "words", "source_size", "target")
    plan = stage(expected_copies(plan, cap), "mix-plan")
    of = rows.alias("r").join(plan.alias("p"), same_source("r", "p") & (F.col("r.measure") == F.col("p.measure")), "left")
    # u / (1 - u) over part / (1 - part), mapped to (0, 1) by x / (1 + x)
    odds, odds_in = F.col("u") * (1 - F.col("part")), (1 - F.col("u")) * F.col("part")
    rank = F.when(F.col("part") > 0, odds / (odds + odds_in))
    keyed = stage(of.select("doc_id", "r.source", "size", F.coalesce("whole", F.lit(0)).alias("whole"), rank.alias("rank")), "mix-ranks")

    # narrow down to the slice of each source in which the rest of its budget runs out
    cuts = plan.groupBy("source").agg(F.first("rest").alias("rest")).select("source", "rest", F.lit(0).alias("cut"), F.lit(0).cast("long").alias("before"))
    bits = 0
    for more in slice_bits:
        piece = F.floor(F.col("rank") * float(1 << more)).cast("long")
        inside = keyed.where("rank is not null").alias("k").join(cuts.alias("c"), same_source("k", "c") & (F.floor(F.col("rank") * float(1 << bits)) == F.col("cut")))
        sums = inside.groupBy("k.source", "rest", "before", piece.alias("piece")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("piece"))
        sums = sums.withColumn("upto", upto).where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        cuts = stage(sums.select("source", "rest", F.col("piece").alias("cut"), (F.col("upto") - F.col("words")).alias("before")), "mix-cuts")
        bits = more

    # within it, the last document that brings the sum nearer to the budget
    key = F.struct("rank", F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), F.col("size").alias("n"))
    last = F.floor(F.col("rank") * float(1 << bits))
    inside = keyed.alias("k").join(cuts.alias("c"), same_source("k", "c") & (last == F.col("cut"))).select("k.source", "size", "before", "rest", key.alias("key"))
    ordered = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = inside.withColumn("sum", F.col("before") + F.sum("size").over(ordered))
    ends = sums.where(2 * F.col("rest") >= 2 * F.col("sum") - F.col("size")).groupBy("source").agg(F.max("key").alias("cut_key"))
    ends = cuts.alias("c").join(ends.alias("e"), same_source("c", "e"), "left").select("c.source", "cut", "cut_key")
    per = stage(per.alias("p").join(ends.alias("e"), same_source("p", "e"), "left").select("p.source", "source_size", "target", "cut", "cut_key"), "mix-sources")

    drawn = (last < F.col("cut")) | ((last == F.col("cut")) & (key <= F.col("cut_key")))
    out = keyed.alias("k").join(per.alias("p"), same_source("k", "p"))
    copies = F.col("whole") + F.when(drawn, 1).otherwise(0)
    return out.select("doc_id", "k.source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` that have copies, each repeated so often.

    The columns of ``docs`` keep their names; copies are rows of their own.
    """
    plan = pareto_mix(docs, **options).where("copies > 0")
    # Repeated rows are one row of the plan for each of their values.
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies"))
    n = F.coalesce(F.regexp_count("d.row.text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("p.source")) & (n == F.col("p.size"))
    out = docs.select(F.struct("*").alias("row")).alias("d").join(plan.alias("p"), same)
    return out.select("d.row", F.explode(F.array_repeat(F.lit(0), F.col("p.copies")))).select("row.*")


def op10_pareto_mix(spark, sf_dir):
    mixed = pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, most / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
               - coalesce(sum(most) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / sum(w) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
b AS (SELECT arg_min(level, full_at) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, coalesce(least(most, w * (SELECT level FROM b)), most) AS target FROM l),
m AS (SELECT source, length(bin(size)) AS measure, CAST(sum(size) AS BIGINT) AS words FROM r WHERE size > 0 GROUP BY 1, 2),
c AS (SELECT m.source, measure, words, target, 2.0::DOUBLE / measure AS full_at,
             (target - coalesce(sum(words) OVER (PARTITION BY m.source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
             / CAST(sum(words * measure) OVER (PARTITION BY m.source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
d AS (SELECT source, arg_min(level, full_at) FILTER (WHERE level <= full_at) AS level FROM c GROUP BY source),
e AS (SELECT c.source, measure, words, target, coalesce(least(2.0::DOUBLE, measure * d.level), 2.0::DOUBLE) AS copies FROM c JOIN d ON c.source IS NOT DISTINCT FROM d.source),
p AS (SELECT source, measure, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS part,
             target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM e),
k AS (SELECT r.doc_id, r.source, r.size, coalesce(p.whole, 0) AS whole, p.rest,
             CASE WHEN part > 0 THEN u * (1 - part) / (u * (1 - part) + (1 - u) * part) END AS rank
      FROM r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.size > 0 AND length(bin(r.size)) = p.measure),
o AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT o.doc_id, o.size, t.source_size, t.target,
       CAST(o.size * (whole + CASE WHEN rank IS NOT NULL AND upto - size < rest AND 2 * rest >= 2 * upto - size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
