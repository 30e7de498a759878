"""Sources mixed to target shares of the total size.

Slots of equal size follow a low-discrepancy schedule: the multiples of the golden ratio, taken
modulo 1, fall through the cumulative shares, so every stretch of slots is close to them. The r-th
slot of a source is filled by the source's r-th block of equal size, cut from its shuffled texts,
epoch after epoch. No slot needs to know another: ranks are running counts over blocks of slots,
text blocks come from running sums over blocks of texts, so a source with most of the rows is
spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.packing import few
from vellumine.llm.prefix import running_sum, shuffled_order

GOLDEN = 0.6180339887498949


def mixture_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Of each source that gives something: ``source, share, max_repeats, tokens, n, wanted``.

    With a ``total`` each source gives its share of it, or as much as ``max_repeats`` allows where
    that is less: the others are not cut for its sake, and their proportions hold among them. Without
    one, the total is the largest at which no source falls short. Target sources without text are
    left out and, without a total, the other shares scaled up to 1. Shares of 0 or less, and repeats
    below 1, give nothing and are left out as well. Targets are limited to a table of settings.
    """
    t = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    plan = [r.asDict() for r in few(t.join(sizes.filter("tokens > 0"), "source"))]
    if total is None and plan:
        whole = sum(p["share"] for p in plan)
        total = min(p["max_repeats"] * p["tokens"] * whole / p["share"] for p in plan)
        plan = [p | {"share": p["share"] / whole} for p in plan]
    return sorted((p | {"wanted": min(p["share"] * total, p["max_repeats"] * p["tokens"])} for p in plan), key=lambda p: p["source"])


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, id_col: str = "doc_id", size_col: str = "n_tokens", source_col: str = "source", block_tokens: int = 8192) -> DataFrame:
    """``(slot, source, epoch, id, n_tokens)``: the mixture in slot order.

    For ``total`` see ``mixture_plan``. A text is used at most ``max_repeats`` times, once per epoch;
    a source stops with the text that reaches its part, so it is off by less than one text. A text
    lies in the block in which it starts: one longer than a block is followed by empty slots of its
    source. Null sources and sources without a target are not mixed; null and zero sizes add nothing
    and are left out; repeated rows are texts of their own. No texts or no targets give no mixture.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    plan = mixture_plan(source_sizes(rows), targets, total)
    if not plan:
        return spark.createDataFrame([], f"slot long, source string, epoch int, {id_col} {kind}, n_tokens long")
    known = spark.createDataFrame([(p["source"], float(p["tokens"]), float(p["wanted"]), math.ceil(p["wanted"] / p["tokens"])) for p in plan], "source string, tokens double, wanted double, epochs int")
    longest = max(math.ceil(p["wanted"] / p["tokens"]) for p in plan)
    used = rows.join(F.broadcast(known), "source")  # as long as the targets, see few()
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs") - 1, F.lit(0)))))
    used = used.withColumn("order", (F.col("epoch") + shuffled_order("id", "n_tokens", "epoch")) / F.lit(float(longest)))
    blocks = running_sum(used, "source", "order", "n_tokens", "start", sum(p["n"] * math.ceil(p["wanted"] / p["tokens"]) for p in plan))
    blocks = blocks.filter("start < wanted").withColumn("block", F.floor(F.col("start") / block_tokens).cast("long"))

    # so many slots that every source has one for each of its blocks: counts of golden-ratio points in an
    # interval are off by no more than a multiple of the number's logarithm
    whole = sum(p["wanted"] for p in plan)
    need = [(math.ceil(p["wanted"] / block_tokens) + 1, p["wanted"] / whole) for p in plan]
    n_slots = max(math.ceil((n + 4 + 2 * math.log2(2 + n / s)) / s) for n, s in need)
    upper = [sum(p["wanted"] for p in plan[: i + 1]) / whole for i in range(len(plan))]
    point = F.pmod((F.col("slot") + 0.5) * GOLDEN, F.lit(1.0))
    below = F.size(F.filter(F.array(*map(F.lit, upper[:-1])).cast("array<double>"), lambda u: u <= point))
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("source", F.get(F.array(*[F.lit(p["source"]) for p in plan]), below))
    slots = slots.withColumn("order", F.col("slot") / F.lit(float(n_slots))).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sum(slots, "source", "order", "one", "block", n_slots).select("source", "block", "slot")
    out = blocks.join(ranked, ["source", "block"])
    return out.select("slot", "source", "epoch", F.col("id").alias(id_col), "n_tokens")


def shares_reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame, total: int | None = None, size_col: str = "n_tokens", source_col: str = "source") -> DataFrame:
    """``(source, target_share, actual_share, n_tokens, wanted_tokens, shortfall_tokens, n_texts, most_repeats)`` per target source, 0 where it gave nothing.

    ``wanted_tokens`` is the target share of the total; ``shortfall_tokens`` what repeats up to the
    limit cannot give of it. Without a total no source is meant to fall short but those without text.
    """
    rows = docs.select(F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    plan = mixture_plan(source_sizes(rows), targets, total)
    whole = float(total if total is not None else sum(p["wanted"] for p in plan))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"), (F.max("epoch") + 1).alias("most_repeats"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left")
    all_ = F.sum(F.coalesce("n_tokens", F.lit(0))).over(Window.partitionBy())  # one row per target source
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    wanted = F.round(F.greatest(F.col("target_share"), F.lit(0.0)) * whole).cast("long")
    short = F.greatest(wanted - F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    return t.select("source", "target_share", F.coalesce(F.col("n_tokens") / all_, F.lit(0.0)).alias("actual_share"), zero("n_tokens"), wanted.alias("wanted_tokens"), short.alias("shortfall_tokens"), zero("n_texts"), zero("most_repeats"))
