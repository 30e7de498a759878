"""One label per item from raters who disagree, with agreement and reliabilities.

Iteratively reweighted voting. A vote counts with the log-odds of its rater's accuracy over those of
the label's share, so a vote of a rater who is right no more often than chance counts nothing, and
one of a rater who is mostly wrong counts against its label. Accuracy is taken among the votes in
which the rater gave that label, smoothed towards the rater's accuracy over all votes, which is
smoothed towards all raters' accuracy; the vote's own item is left out of both (leave-one-out), so
no vote vouches for its own rater. Weighted consensus and accuracies alternate until no label changes.

One accuracy over all labels cannot tell a rater who answers ``supports`` to everything from a
careful one; for that there is ``method="rater"``. ``method="confusion"`` weighs a vote by how often
the rater gives that label where the truth is each candidate.

Everything is in long form: no item's votes and no rater's votes are gathered in one task. Votes are
written once, partitioned by item, and each round writes beliefs per item and records per rater. A
record is a few numbers, summed map-side; it is broadcast while the raters are counted to be at most
``BROADCAST_RATERS``, and joined under a salt beyond, so a rater with a third of all votes is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

SALTS = 16
BROADCAST_RATERS = 100_000
METHODS = ("label", "rater", "confusion")
#: From this round on a new belief is averaged with those before, so that items on a border cannot swing for ever.
SETTLE_AFTER, MOST_ROUNDS = 10, 100


def normal(c: str) -> Column:
    """Trimmed (all white space) and lower-cased; null where nothing is left."""
    t = F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def latest_votes(votes: DataFrame, item: list[str], rater: str, label: str, at: str, labels: list[str], not_raters: tuple[str, ...] = ()) -> DataFrame:
    """``(item.., rater, label)``: each rater's latest usable label per item.

    Raters and labels are compared trimmed and lower-cased. Votes without a usable label, without
    a rater or by one of ``not_raters`` are no votes; an undated vote is older than any dated one;
    among votes of one time the label first in ``labels`` counts.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_l"))
    rows = votes.select(*item, normal(rater).alias("_r"), normal(label).alias("_l"), F.col(at).alias("_at"))
    rows = rows.filter(F.col("_l").isin(labels) & F.col("_r").isNotNull() & ~F.col("_r").isin(list(not_raters)))
    best = F.max(F.struct(F.col("_at"), (-order).alias("o"), F.col("_l"))).alias("b")
    return rows.groupBy(*item, "_r").agg(best).select(*item, F.col("_r").alias("rater"), F.col("b._l").alias("label"))


def consensus(votes: DataFrame, item: list[str], labels: list[str], smoothing: float = 4.0, method: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(items, raters)`` from ``votes(item.., rater, label)``, one vote per item and rater.

    ``items(item.., n_raters, consensus_label, confidence)`` has one row per item with a vote;
    ``raters(rater, n_votes, reliability)``, where reliability is the rater's smoothed accuracy over
    all votes. Ties go to the label first in ``labels``. No votes give two empty tables. Rounds go on
    until no label changes; that this is not reached in ``MOST_ROUNDS`` is an error.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    k = len(labels)
    q = [f"q{i}" for i in range(k)]
    given = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    votes = cut(votes.select(F.struct(*item).alias("item"), "rater", given.alias("given")).repartition("item"))
    shares = votes.groupBy("item").agg(F.count("*").alias("n_raters"), *[F.avg((F.col("given") == i).cast("double")).alias(q[i]) for i in range(k)])
    beliefs = cut(shares.withColumn("best", _argmax(q)))

    raters = votes.select("rater").distinct().count()
    for i in range(MOST_ROUNDS):
        both = votes.join(beliefs, "item")
        # sums over all raters and items, one row, go along with the records: as columns, so that the same code runs in every round
        of_items = beliefs.agg(*[F.sum(c).alias(f"t{g}") for g, c in enumerate(q)], F.count("*").alias("t"))
        of_items = of_items.select(*[((F.coalesce(f"t{g}", F.lit(0.0)) + 1.0) / (F.col("t") + k)).alias(f"prior{g}") for g in range(k)])
        records = cut(_records(both, k, method))
        pool = records.agg(*[F.sum(c).alias(f"all_{c}") for c in records.columns if c != "rater"])
        records = records.crossJoin(F.broadcast(pool)).crossJoin(F.broadcast(of_items))  # one row each
        scored = _weighted(_with_records(both, records, raters), k, method, smoothing)
        part = 1.0 / (1 + max(0, i - SETTLE_AFTER))
        new = beliefs.withColumnsRenamed({c: f"old_{c}" for c in q} | {"best": "old"}).join(scored, "item")
        new = new.select("item", "n_raters", *[(F.col(f"old_{c}") + part * (F.col(c) - F.col(f"old_{c}"))).alias(c) for c in q], "old")
        beliefs = cut(new.withColumn("best", _argmax(q)))
        moved = beliefs.filter("best <> old").limit(1).count()
        beliefs = beliefs.drop("old")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")

    names = F.array(*[F.lit(x) for x in labels])
    items = beliefs.select("item.*", "n_raters", F.get(names, F.col("best")).alias("consensus_label"), F.greatest(*q, F.lit(0.0)).alias("confidence"))
    last = _records(votes.join(beliefs, "item"), k, method)
    n, ok = (sum((F.col(f"{x}{g}") for g in range(k)), F.lit(0.0)) for x in ("n", "ok"))
    all_ = last.agg((F.sum(ok) / F.sum(n)).alias("mean")).first().mean or 0.0
    reliabilities = last.select("rater", n.cast("long").alias("n_votes"), ((ok + smoothing * all_) / (n + smoothing)).alias("reliability"))
    return items, reliabilities


def _argmax(q: list[str]) -> Column:
    out = F.lit(len(q) - 1)
    for i in reversed(range(len(q) - 1)):
        out = F.when(F.col(q[i]) >= F.greatest(*q), F.lit(i)).otherwise(out)
    return out


def _records(both: DataFrame, k: int, method: str) -> DataFrame:
    """Per rater, of each given label: ``n``, the votes, ``ok``, the belief in them; for ``confusion`` also ``c``, the belief in each label where it was given."""
    of = lambda g, v: F.sum(F.when(F.col("given") == g, v).otherwise(0.0))
    aggs = [a for g in range(k) for a in (of(g, F.lit(1.0)).alias(f"n{g}"), of(g, F.col(f"q{g}")).alias(f"ok{g}"), *[of(g, F.col(f"q{c}")).alias(f"c{c}_{g}") for c in range(k) if method == "confusion"])]
    return both.groupBy("rater").agg(*aggs)


def _with_records(both: DataFrame, records: DataFrame, raters: int) -> DataFrame:
    if raters <= BROADCAST_RATERS:
        return both.join(F.broadcast(records), "rater")
    records = records.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return both.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")).join(records, ["rater", "salt"])


def _weighted(votes: DataFrame, k: int, method: str, smoothing: float) -> DataFrame:
    """``(item, q..)``: new beliefs from votes weighted by their raters' leave-one-out records."""
    pick = lambda x: F.coalesce(*[F.when(F.col("given") == g, F.col(x.format(g=g))) for g in range(k)])
    over = lambda x: sum((F.col(x.format(g=g)) for g in range(k)), F.lit(0.0))
    at_least_0 = lambda x: F.greatest(x, F.lit(0.0))
    hit = pick("q{g}")
    if method == "confusion":
        terms = []
        for c in range(k):
            own, every = f"c{c}_{{g}}", F.col(f"q{c}")
            base = (pick(f"all_{own}") + 1.0 / k) / (over(f"all_{own}") + 1.0)
            terms.append(F.log((at_least_0(pick(own) - every) + smoothing * base) / (at_least_0(over(own) - every) + smoothing)))
    else:
        accuracy = (at_least_0(over("ok{g}") - hit) + smoothing * over("all_ok{g}") / over("all_n{g}")) / (over("n{g}") - 1 + smoothing)
        share = F.lit(1.0 / k)
        if method == "label":
            accuracy = (at_least_0(pick("ok{g}") - hit) + smoothing * accuracy) / (pick("n{g}") - 1 + smoothing)
            share = pick("prior{g}")
        odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
        votes = votes.withColumn("weight", odds(accuracy) - odds(share))
        terms = [F.when(F.col("given") == c, F.col("weight")).otherwise(0.0) for c in range(k)]
    base = [F.lit(0.0) if method == "rater" else F.first(F.log(f"prior{c}")) for c in range(k)]
    sums = votes.groupBy("item").agg(*[(F.sum(terms[c]) + base[c]).alias(f"s{c}") for c in range(k)])
    top = F.greatest(*[F.col(f"s{c}") for c in range(k)]) if k > 1 else F.col("s0")
    part = [F.exp(F.col(f"s{c}") - top) for c in range(k)]
    return sums.select("item", *[(part[c] / sum(part, F.lit(0.0))).alias(f"q{c}") for c in range(k)])


def agreement(votes: DataFrame, item: list[str]) -> DataFrame:
    """One row ``(n_items, n_votes, observed, expected, alpha)``: Krippendorff's nominal alpha.

    Items with one vote have nothing to agree on and do not count; missing ratings need no filling
    in. ``alpha`` is null without two votes on some item, and 1 where only one label is in use.
    """
    per = votes.groupBy(*item, "label").agg(F.count("*").alias("n"))
    units = per.groupBy(*item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn")).filter("m > 1")
    seen = per.join(units.select(*item), item, "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    over = units.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_votes"), F.sum((F.col("m") * F.col("m") - F.col("nn")) / (F.col("m") - 1)).alias("off"))
    marg = seen.agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    both = over.crossJoin(marg)  # one row each
    observed = 1 - F.col("off") / F.col("n_votes")
    expected = (F.col("sq") - F.col("n_votes")) / (F.col("n_votes") * (F.col("n_votes") - 1))
    alpha = F.when(expected >= 1, F.lit(1.0)).otherwise(1 - (1 - observed) / (1 - expected))
    return both.select("n_items", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), observed.alias("observed"), expected.alias("expected"), alpha.alias("alpha"))
