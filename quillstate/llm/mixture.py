"""Mixing sources to target weights by a low-discrepancy schedule.

The corpus is a row of slots of about ``block_tokens`` tokens. Slot ``i`` has the van der
Corput point of ``i`` (its bits mirrored behind the point), and the source whose interval of
cumulated weights holds that point; any stretch of slots then comes close to the target
weights. Slots are ranked per source, and a source's share of the whole size, its weight
times all tokens, rounded up, is dealt out evenly over its ranks: each slot is a block of equal
tokens, give or take one, and no token is lost to rounding. Ranks in a row take the tokens
of the source's shuffled documents in a row, splitting documents at block edges; after the
last token the first follows again as the next use. Tokens beyond use ``max_repeats`` do not
exist: such a slot is filled in part or not at all, and its source is short.

Ranks and token positions are prefix sums, taken in two levels (totals of bounded chunks
first, then positions inside a chunk), so a source with a third of all documents is spread
over as many tasks as it has chunks. Slots find their source by an equi-join on cells of
[0, 1), whose number is that of the sources; blocks find their documents by an equi-join on
(source, stretch of ``block_tokens`` tokens). Nothing is collected, whatever the number of
sources.

Defined results: documents of unlisted or NULL sources take no part; documents with no
tokens are in no block; repeated targets of one source count once, with the largest weight and
repeats; a listed source without documents fills no slot; a source whose weight is above 0 has
one slot at least; every token of a document is used at most ``max_repeats`` times; rows equal
in id and text are documents of their own; an empty corpus has no slots, and all shares are 0.
Weights and repeats that are NULL are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstate.session import cut

BLOCK_TOKENS = 4096
#: Slots and documents that one prefix-sum task should hold at most.
CHUNK = 1 << 16


def _targets(targets: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight"), F.lit(0.0)).cast("decimal(14,10)")
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(weight).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))


def source_sizes(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, weight, max_repeats, source_tokens, all_tokens, quota`` of every target; ``sizes``: ``source, n_tokens``.

    ``quota``: the tokens the source has to give.
    """
    per = sizes.groupBy("source").agg(F.sum("n_tokens").alias("s"))  # sources are few, rows are combined map-side
    joined = _targets(targets).join(per, "source", "left").withColumn("source_tokens", F.coalesce("s", F.lit(0)).cast("bigint")).drop("s")
    # one row per listed source, whatever the corpus
    total = joined.withColumn("all_tokens", F.sum("source_tokens").over(Window.partitionBy()))
    return total.withColumn("quota", F.ceil(F.col("weight") * F.col("all_tokens").cast("decimal(18,0)")).cast("bigint"))


def _running(df: DataFrame, groups: list[str], chunk: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before, per group: chunks first, then inside a chunk."""
    rows = df.withColumn("__a", amount)
    per = rows.groupBy(*groups, chunk).agg(F.sum("__a").alias("__t"))
    before = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*groups, chunk, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__i", F.coalesce(F.sum("__a").over(inside), F.lit(0)))
    return placed.join(base, [*groups, chunk]).withColumn(name, F.col("__base") + F.col("__i")).drop("__a", "__i", "__base", chunk)


def _point(i: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("double") / float(1 << bits)


def schedule(report: DataFrame, n_slots: int) -> DataFrame:
    """``slot, source, rank`` of every slot; ``report``: ``source, weight`` with weights of any sum."""
    spark = report.sparkSession
    upto = F.sum(F.col("weight").cast("double")).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = report.where("weight > 0").select("source", upto.alias("hi"), F.col("weight").cast("double").alias("w"))  # one row per listed source
    ends = every.withColumn("all", F.max("hi").over(Window.partitionBy())).withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy()))
    lo, hi = F.greatest(F.lit(0.0), (F.col("hi") - F.col("w")) / F.col("all")), F.col("hi") / F.col("all")
    parts = ends.select("source", lo.alias("__lo"), F.lag(hi, 1, 0.0).over(Window.orderBy("source")).alias("__from"), hi.alias("__to"), "cells")
    cells = parts.select("source", "__from", "__to", F.explode(F.sequence(F.floor(F.col("__from") * F.col("cells")), F.floor(F.col("__to") * F.col("cells")))).alias("__cell"))
    count = parts.agg(F.first("cells")).first()[0]
    bits = max(1, (max(1, n_slots) - 1).bit_length())
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("__u", _point(F.col("slot"), bits))
    slots = slots.withColumn("__at", F.floor(F.col("__u") * F.lit(count or 1)))
    picked = slots.join(cells, (F.col("__at") == F.col("__cell")) & (F.col("__from") <= F.col("__u")) & (F.col("__u") < F.col("__to")))
    picked = picked.select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("__c"))
    ranked = _running(picked, ["source"], "__c", ["slot"], F.lit(1).cast("bigint"), "rank")
    # a source too light to hold a point gets a slot behind all others
    missing = every.select("source").join(ranked.select("source").distinct(), "source", "left_anti")
    behind = missing.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("source")) - 1).cast("bigint").alias("slot"), "source", F.lit(0).cast("bigint").alias("rank"))
    return ranked.select("slot", "source", "rank").unionByName(behind)


def plan_mix(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The target report, and of every slot ``slot, source, rank, from_token, wanted, filled``.

    ``from_token`` counts the tokens of the source's earlier ranks, all uses in a row.
    """
    report = cut(source_sizes(sizes, targets))
    total = report.agg(F.max("all_tokens")).first()[0] or 0
    if not total:
        return report, report.sparkSession.createDataFrame([], "slot bigint, source string, rank bigint, from_token bigint, wanted bigint, filled bigint")
    ranks = cut(schedule(report, -(-total // block_tokens)))
    n = ranks.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    per = report.join(n, "source").select("source", "quota", "__n", (F.col("max_repeats").cast("bigint") * F.col("source_tokens")).alias("__has"))
    start, end = F.col("__each") * F.col("rank") + F.least("rank", "__more"), F.col("__each") * (F.col("rank") + 1) + F.least(F.col("rank") + 1, F.col("__more"))
    each = per.withColumn("__each", F.call_function("div", F.col("quota"), F.col("__n"))).withColumn("__more", F.col("quota") - F.col("__each") * F.col("__n"))
    dealt = ranks.join(each, "source").withColumn("from_token", start).withColumn("wanted", end - start)
    filled = F.greatest(F.lit(0).cast("bigint"), F.least("wanted", F.col("__has") - F.col("from_token")))
    return report, dealt.select("slot", "source", "rank", "from_token", "wanted", filled.alias("filled"))


def doc_positions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, doc_id, n_tokens, at``: the shuffled documents of listed sources with the tokens before each."""
    docs = sizes.where("n_tokens > 0").join(_targets(targets).select("source"), "source", "left_semi")
    extra = ["text_hash"] if "text_hash" in docs.columns else []
    # rows equal in id and text are told apart by the task that reads them, which is written down before it is used
    keyed = docs.withColumn("__h", F.xxhash64(F.lit(17), "doc_id", *extra, F.spark_partition_id())).select("source", "doc_id", "n_tokens", "__h")
    keyed = cut(keyed)
    chunks = max(1, keyed.count() // CHUNK) * 4
    chunked = keyed.withColumn("__c", F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * chunks).cast("bigint"))
    return _running(chunked, ["source"], "__c", ["__h", "doc_id", "n_tokens"], F.col("n_tokens"), "at").drop("__h")


def fill(report: DataFrame, plan: DataFrame, docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixed corpus ``slot, use, source, doc_id, doc_from, n_tokens``: stretches of documents, slot by slot."""
    size = report.where("source_tokens > 0").select("source", F.col("source_tokens").alias("__s"))
    lo, hi, s = F.col("from_token"), F.col("from_token") + F.col("filled"), F.col("__s")
    uses = plan.where("filled > 0").join(size, "source").select("slot", "source", lo.alias("__lo"), hi.alias("__hi"), "__s", F.explode(F.sequence(F.call_function("div", lo, s), F.call_function("div", hi - 1, s))).alias("use"))
    pieces = uses.select("slot", "source", "use", F.greatest(F.lit(0).cast("bigint"), F.col("__lo") - F.col("use") * s).alias("__a"), F.least(s, F.col("__hi") - F.col("use") * s).alias("__b"))

    def stretch(c: Column) -> Column:
        return F.call_function("div", c, F.lit(block_tokens).cast("bigint"))

    left = pieces.withColumn("__p", F.explode(F.sequence(stretch(F.col("__a")), stretch(F.col("__b") - 1))))
    right = docs.select(F.col("source").alias("__source"), "doc_id", F.col("at").alias("__x"), (F.col("at") + F.col("n_tokens")).alias("__y"))
    right = right.withColumn("__q", F.explode(F.sequence(stretch(F.col("__x")), stretch(F.col("__y") - 1))))
    both = left.join(right, (F.col("source") == F.col("__source")) & (F.col("__p") == F.col("__q")) & (F.col("__a") < F.col("__y")) & (F.col("__x") < F.col("__b")))
    # a pair that shares several stretches is taken in the first
    once = both.where(F.col("__p") == F.greatest(stretch(F.col("__a")), stretch(F.col("__x"))))
    first, last = F.greatest("__a", "__x"), F.least("__b", "__y")
    return once.select("slot", "use", "source", "doc_id", (first - F.col("__x")).alias("doc_from"), (last - first).alias("n_tokens"))


def mix(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The target report, the slots, and the mixed corpus; ``sizes``: ``doc_id, source, n_tokens[, text_hash]``."""
    report, plan = plan_mix(sizes, targets, block_tokens)
    return report, plan, fill(report, plan, doc_positions(sizes, targets), block_tokens)


def short_sources(plan: DataFrame) -> DataFrame:
    """``source`` of those that cannot fill all their slots: their tokens run out within their repeats.

    The slots of a source ask for its exact share, so nothing but the filling decides.
    """
    return plan.where("filled < wanted").select("source").distinct()


def shares(report: DataFrame, plan: DataFrame) -> DataFrame:
    """Wanted and actual share of every target: ``source, weight, slots, filled, tokens, share``."""
    per = plan.groupBy("source").agg(F.count(F.lit(1)).alias("slots"), F.count(F.when(F.col("filled") == F.col("wanted"), 1)).alias("filled"), F.sum("filled").alias("tokens"))
    out = report.select("source", F.col("weight").cast("double").alias("weight")).join(per, "source", "left")
    zero = F.lit(0).cast("bigint")
    out = out.select("source", "weight", F.coalesce("slots", zero).alias("slots"), F.coalesce("filled", zero).alias("filled"), F.coalesce("tokens", zero).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row per listed source
    return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
