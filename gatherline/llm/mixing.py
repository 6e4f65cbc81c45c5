"""Mixing sources to target weights: weighted fair queueing of shuffled documents, cut at the total budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.session import stored

WEIGHTS = (1, 2, 3)
#: No document is repeated more often.
MOST = 3
#: Words of a packet: what a source may be ahead of or behind its share at the cut.
PACKET = 512
#: Entries of a bucket of the shuffled order, and packets of a range of finish times.
BUCKET, RANGE = 4_096, 1_000_000
#: Sources whose totals pass through the driver.
SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; of a null one none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """The words each source should give, all of them together as many as there are.

    Sources by code point, null last, have the weights in turn. A source that would exceed ``most`` times its size
    stops there, and what it leaves is shared by the others.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left = [(most * n / weights[i % len(weights)], i, s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    left.sort(key=lambda x: x[:2])
    rest, share = sum(n for _, n in sizes), sum(x[4] for x in left)
    out: dict[str | None, float] = {}
    for at, (_, _, s, n, w) in enumerate(left):
        if float(rest) * w / share <= most * n:  # from here on nobody exceeds
            return out | {s: float(rest) * w / share for _, _, s, _, w in left[at:]}
        out[s] = float(most * n)
        rest, share = rest - most * n, share - w
    return out


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, packet: int = PACKET) -> DataFrame:
    """doc_id, source, size, instance, source_size, target and taken: how many words of each document the mix takes.

    Every source queues its documents in an order shuffled by md5 of pass and doc_id, pass after pass up to ``most`` of
    them, in packets of at most ``packet`` words. A packet's virtual finish time is the words of its source up to its
    end, divided by the source's target. All packets are range-sorted by it (ties: source, then place in the source)
    and taken until the budget, the words of all documents, is spent; the last one is cut there. So each source is
    within about a packet of its target. The order depends on the rows alone, so reruns agree.

    Documents with equal source, doc_id and size are one entry with a count, and get ``instance`` 0, 1, ... A null text
    has size 0, and so has a text of white space; they are taken 0 times. A null doc_id is shuffled as an empty
    one; null is a source of its own. A source without words has target 0. Other columns are ignored; an empty table
    gives no rows. More than ``SOURCES`` sources are refused: their totals are put in order in the driver.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    entries, _ = stored(d.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    words = F.col("size") * F.col("n")
    per_source = entries.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("entries"), F.sum(F.ceil(words / packet)).alias("packets"))
    found = per_source.limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([(r.source, r.words) for r in found], weights, most)
    budget = sum(r.words for r in found)
    passes = [max(1, -int(-goal[r.source] // r.words)) if r.words else 1 for r in found]
    table = [(i, r.source, r.words, goal[r.source], passes[i], max(1, -(-r.entries // BUCKET))) for i, r in enumerate(found)]
    sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, passes int, buckets long")

    # each source's passes, bucket by bucket of the shuffled order
    key = F.md5(F.concat(F.col("pass").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    e, s = entries.alias("e"), F.broadcast(sources).alias("s")
    copies = (
        e.join(s, F.col("e.source").eqNullSafe(F.col("s.source")))
        .select("s.sid", "s.source_size", "s.target", "s.passes", "s.buckets", "doc_id", "size", "n", F.explode(F.sequence(F.lit(0), F.col("s.passes") - 1)).alias("pass"))
        .withColumn("key", key)
        .withColumn("bucket", F.floor(leading * F.col("buckets") / float(1 << 32)).cast("long"))
    )
    before = Window.partitionBy("sid", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("sid", "pass", "bucket").agg(F.sum(words).alias("w")).select("sid", "pass", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("sid", "pass", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("pass") * F.col("source_size") + F.col("start") + F.sum(words).over(within) - words
    queue, _ = stored(copies.join(starts, ["sid", "pass", "bucket"]).withColumn("at", at).select("sid", "doc_id", "size", "n", "pass", "source_size", "target", "at"))

    # packets in the order of their finish times, range by range
    packets = queue.where("size > 0").select("sid", "target", "at", words.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((words - 1) / packet))).alias("i"))
    end = F.col("at") + F.least((F.col("i") + 1) * packet, F.col("m"))
    packets = packets.select((end / F.col("target")).alias("finish"), "sid", end.alias("end"), (end - F.col("at") - F.col("i") * packet).alias("words"))
    ranges = max(1, -(-sum(r.packets * p for r, p in zip(found, passes, strict=True)) // RANGE))
    ranged, _ = stored(packets.repartitionByRange(ranges, "finish", "sid", "end").sortWithinPartitions("finish", "sid", "end").withColumn("part", F.spark_partition_id()))
    served = _served(ranged, budget)
    reach = [served.get(i, 0) for i in range(len(found))]
    last = [min(p - 1, reach[i] // found[i].words) if found[i].words else 0 for i, p in enumerate(passes)]
    marks = spark.createDataFrame([(i, r.source, n, p) for (i, r), n, p in zip(enumerate(found), reach, last, strict=True)], "sid int, source string, reach long, last int")

    # whole passes, and of the last one what lies before the source's reach; equal documents in turn
    part = lambda v: F.greatest(F.lit(0).cast("long"), F.least(v, F.col("size")))
    taken = F.col("last") * F.col("size") + part(F.col("reach") - F.col("at") - F.col("instance") * F.col("size"))
    mine = queue.join(F.broadcast(marks), "sid").where("pass = last")
    few = mine.where(F.col("n") <= BUCKET)
    many = mine.where(F.col("n") > BUCKET).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET)))).repartition("sid", "doc_id", "size", "block")
    numbers = lambda lo, hi: F.explode(F.sequence(lo, hi))
    each = few.withColumn("instance", numbers(F.lit(0).cast("long"), F.col("n") - 1)).unionByName(
        many.withColumn("instance", numbers(F.col("block") * BUCKET, F.least((F.col("block") + 1) * BUCKET, F.col("n")) - 1)).drop("block")
    )
    return each.select("doc_id", "source", "size", "instance", "source_size", "target", taken.cast("long").alias("taken"))


def _served(ranged: DataFrame, budget: int) -> dict[int, int]:
    """How many words of each source are taken when packets are taken in order until the budget is spent."""
    parts = ranged.groupBy("part").agg(F.sum("words").alias("w")).orderBy("part").collect()  # one row for each range
    total, cut = 0, None
    for r in parts:
        if total + r.w >= budget:
            cut = r.part
            break
        total += r.w
    if cut is None:
        whole = ranged
    else:
        order = Window.partitionBy("part").orderBy("finish", "sid", "end").rowsBetween(Window.unboundedPreceding, 0)
        inside = ranged.where(F.col("part") == cut).withColumn("so_far", F.sum("words").over(order) + F.lit(total))
        taken = F.least(F.col("words"), F.lit(budget) - (F.col("so_far") - F.col("words")))
        whole = ranged.where(F.col("part") < cut).select("sid", "words").unionByName(inside.select("sid", taken.alias("words")).where("words > 0"))
    return {r.sid: r.w for r in whole.groupBy("sid").agg(F.sum("words").alias("w")).collect()}


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, packet: int = PACKET) -> DataFrame:
    """The mix itself: every taken document as often as it is taken, with its columns; the last copy of a document that
    the cut went through holds its first words only (white space between words kept as it is)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    same = Window.partitionBy("k_source", "k_id", "k_size").orderBy(F.col("row.text"))
    rows = docs.select(F.struct(*names).alias("row")).withColumns(
        {"k_source": F.col("row.source").cast("string"), "k_id": F.col("row.doc_id").cast("long"), "k_size": size_of(F.col("row.text"))}
    )
    rows = rows.withColumn("k_instance", (F.row_number().over(same) - 1).cast("long"))
    plan = shares(docs, weights, most, packet)
    on = F.col("k_source").eqNullSafe(plan["source"]) & F.col("k_id").eqNullSafe(plan["doc_id"]) & (F.col("k_size") == plan["size"]) & (F.col("k_instance") == plan["instance"])
    got = rows.join(plan.where("taken > 0"), on).select("row", "size", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("copy"))
    short = F.col("taken") - F.col("copy") * F.col("size")
    pieces = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)  # each holds a word and the white space before it
    first = F.array_join(F.slice(pieces, F.lit(1), short.cast("int")), "")
    text = F.when(short >= F.col("size"), F.col("row.text")).otherwise(first)
    return got.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
