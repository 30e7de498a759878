"""Texts into containers of fixed capacity, at target proportions of their sources.

Deficit round-robin in closed form. Each source with a target share is a queue, all others together
are one more at their natural share. A queue with share ``s`` is served its running sum of tokens at
the virtual time ``sum / s``; up to time ``T`` all queues together were served ``C(T)``, the sum of
``min(s T, tokens)`` over the queues, so an exhausted queue's part goes to the others in proportion
to their shares. A window is a stretch of ``C`` worth ``containers`` full containers. What a queue
got too much of in one window (its last text ran over) it gets less of in the next, because its sum
goes on: deficits carry over all windows and partitions. Each window is then packed by best fit
decreasing; the few containers it leaves open are packed once more with those of its neighbours, so
the stretches of the schedule that share a container are at most ``NEIGHBOURS`` windows apart, and
every item keeps the window in which it was served.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vellumine.llm.prefix import running_sum, shuffled_order
from vellumine.session import cut

_PACKED = "limit_id int, capacity long, window long, container string, id {kind}, part int, n_tokens int, source string, fill long"
#: A window's containers below this part of their capacity are opened and packed once more, with those of neighbouring windows.
CLOSED, NEIGHBOURS = 0.97, 16
#: Rows that the tables of limits and of shares may have; they become part of the plan.
MOST_ROWS = 1000
#: The queue of all sources without a target.
OTHERS = "(others)"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: the fullest one it fits in, larger items first."""
    out = [0] * len(sizes)
    room: list[tuple[int, int]] = []
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, c = room.pop(k)
        else:
            left, c, n = capacity, n, n + 1
        out[i] = c
        insort(room, (left - sizes[i], c))
    return out


def few(df: DataFrame) -> list[Row]:
    """The rows of a table of settings; more than ``MOST_ROWS`` are an error."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows of limits or shares")
    return rows


def _queues(sums: dict[str, int], shares: dict[str, float]) -> dict[str, tuple[int, float]]:
    """``queue: (tokens, share)``; the targets share what the others, at their natural share, leave."""
    total = sum(sums.values())
    rest = sums.get(OTHERS, 0) / total if total else 0.0
    wanted = sum(shares[q] for q in sums if q != OTHERS)
    return {q: (n, rest if q == OTHERS else (1 - rest) * shares[q] / wanted) for q, n in sums.items()}


def _served(time: Column, queues: dict[str, tuple[int, float]]) -> Column:
    """What all queues were served up to a virtual time."""
    parts = [F.least(F.lit(float(n)), time * share) for n, share in queues.values()]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def pack(items: DataFrame, limits: DataFrame, shares: DataFrame | None = None, id_col: str = "doc_id", size_col: str = "n_tokens", source_col: str = "source", containers: int = 256) -> DataFrame:
    """``(limit_id, window, container, id, part, n_tokens, source)``: every item of positive or zero size, once per limit.

    ``limits(limit_id, capacity_tokens)`` and ``shares(source, share)``, the wanted proportions, have
    at most ``MOST_ROWS`` rows. A source without a share above 0 is served with the others of its kind
    at their natural share, and without ``shares`` all are; a share without items goes to the other
    targets. Only an item above the capacity is split: into full containers and a rest that is packed
    like an item. A null size counts as 0, a null source as one without a share, repeated rows are
    items of their own, limits below 1 are no limits, and no items give no containers. Other columns
    are ignored.
    """
    kind = items.schema[id_col].dataType.simpleString()
    share = {} if shares is None else {r.source: float(r.share) for r in few(shares.filter("source is not null and share > 0").groupBy("source").agg(F.max("share").alias("share")))}
    items = items.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    queue = F.when(F.col("source").isin(*share), F.col("source")).otherwise(OTHERS) if share else F.lit(OTHERS)
    # an empty item weighs one token in the schedule, so that a window is bounded in items as well
    items = items.withColumn("queue", queue).withColumn("order", shuffled_order("id", "size")).withColumn("weight", F.greatest("size", F.lit(1).cast("long")))
    sums = items.groupBy("queue").agg(F.count("*").alias("n"), F.sum("weight").alias("tokens")).collect()  # a row per queue
    queues = _queues({r.queue: r.tokens for r in sums}, share)
    rows = running_sum(items, "queue", "order", "weight", "start", sum(r.n for r in sums))
    of_queue = F.coalesce(*[F.when(F.col("queue") == q, s) for q, (_, s) in queues.items()], F.lit(1.0))
    found = [(int(r.limit_id), int(r.capacity_tokens)) for r in few(limits.filter("capacity_tokens >= 1").select("limit_id", "capacity_tokens"))]
    each = F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in found]).cast("array<struct<limit_id: int, capacity: bigint>>")
    rows = rows.select("id", "source", "queue", "size", "start", F.inline(each))
    parts = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    done = F.col("part") * F.col("capacity")
    rows = rows.withColumn("n_tokens", F.least(F.col("capacity"), F.col("size") - done).cast("int"))
    of_queue = F.coalesce(*[F.when(F.col("queue") == q, s) for q, (_, s) in queues.items()], F.lit(1.0))
    served = _served((F.col("start") + done) / of_queue, queues)
    rows = rows.withColumn("window", F.floor(served / (F.col("capacity") * containers)).cast("long"))
    # no two items of a queue of a size above 0 start at the same token
    full = rows.filter("n_tokens = capacity").withColumn("container", F.concat_ws("-", F.lit("f"), "queue", "start", "part"))
    rest = rows.filter("n_tokens < capacity").select("limit_id", "capacity", "window", "id", "part", "n_tokens", "source")
    columns = ["limit_id", "window", "container", "id", "part", "n_tokens", "source"]
    first = cut(_packed(rest, "window", "w", kind))
    closed = F.col("fill") >= CLOSED * F.col("capacity")
    open_ = first.filter(~closed).withColumn("group", F.floor(F.col("window") / NEIGHBOURS))
    again = _packed(open_, "group", "g", kind)
    return full.select(columns).union(first.filter(closed).select(columns)).union(again.select(columns)).withColumnRenamed("id", id_col)


def _packed(rows: DataFrame, by: str, prefix: str, kind: str) -> DataFrame:
    """The rows of each limit and group in containers, with the containers' ``fill``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "part"], kind="stable", na_position="first")
        name = f"{prefix}{pdf[by].iloc[0]}-"
        pdf["container"] = [f"{name}{b}" for b in best_fit(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))]
        pdf["fill"] = pdf.groupby("container")["n_tokens"].transform("sum")
        return pdf[["limit_id", "capacity", "window", "container", "id", "part", "n_tokens", "source", "fill"]]

    return rows.groupBy("limit_id", by).applyInPandas(run, _PACKED.format(kind=kind))


def window_shares(packed: DataFrame, shares: DataFrame) -> DataFrame:
    """``(limit_id, window, source, target_share, actual_share, n_tokens, last_window)``: what each window holds of each target source.

    ``actual_share`` is of the window's tokens of target sources; a source that was used up before the
    window has none. ``last_window`` is the last window in which the source still had texts.
    """
    got = packed.join(F.broadcast(_target_rows(packed, shares)), "source").groupBy("limit_id", "window", "source", "target_share").agg(F.sum("n_tokens").alias("n_tokens"))
    last = got.groupBy("limit_id", "source").agg(F.max("window").alias("last_window"))
    of_window = got.groupBy("limit_id", "window").agg(F.sum("n_tokens").alias("all"))
    out = got.join(of_window, ["limit_id", "window"]).join(last, ["limit_id", "source"])
    return out.select("limit_id", "window", "source", "target_share", (F.col("n_tokens") / F.col("all")).alias("actual_share"), "n_tokens", "last_window")


def _target_rows(df: DataFrame, shares: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(r.source, float(r.share)) for r in few(shares.filter("source is not null and share > 0"))], "source string, target_share double")
