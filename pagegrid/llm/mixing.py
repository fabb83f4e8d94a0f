"""Mixing sources to target weights by a low-discrepancy schedule.

How much is taken of a source follows from its target; the schedule says in which order. Slots are numbered; the
golden-ratio sequence gives slot i a point in [0, 1), and the point's place among the cumulative shares of the slots that
sources need names its source. Slots are ranked per source, and the k-th slot of a source takes the k-th block of its
shuffled token stream, starting over after the last block. Any stretch of the schedule therefore holds the sources near
their shares. A slot beyond what a source needs goes to a source that the sequence leaves short (a few slots per source),
so the slots in use are numbered without gaps; the last block of a source is cut so that its target is met. Each copy of a
document comes at the slot in which it begins.

Only DataFrame operations. A source that holds a third of all rows is ordered in slices; slots and documents meet on
(source, block), which is even by construction. Scalars (total, count of sources, water level) are all the driver sees.

Defined results: a null text has size 0 and takes 0 words; null sources are one source, ordered last; repeated rows count
each; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import running_before, slices_for, sorted_rank, split_words, spread_position, text_key, text_of
from pagegrid.plans.lineage import cut

GOLDEN = 0.6180339887498949
#: sources are sent to every executor only up to this many
_SMALL = 50_000


def word_count(text: Column) -> Column:
    return F.size(split_words(text_of(text))).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(key, source_size, target) per source: shares of all words by weight, none above ``most`` times its size."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = sorted_rank(per, F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    weighted = cut(ranked.withColumn("weight", weight).drop("rank"))
    ceiling = F.col("source_size") * float(most)
    total, free = weighted.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, capped = ((total or 0.0) / free if free else 0.0), -1
    while True:
        over = F.col("weight") * level > ceiling
        n, held, free = weighted.agg(F.count(F.when(over, 1)), F.sum(F.when(over, ceiling)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (held or 0.0)) / free
    return weighted.select("key", "source_size", F.least(F.col("weight") * level, ceiling).alias("target"))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(key, id, rank) of each slot that a golden-ratio point gives to a source; rank counts the slots of the source.

    Points and shares meet on a grid of cells: shares are listed under the cells they overlap, so the range lookup is an
    equi join. ``plan`` has a row per source with ``low`` and ``high`` bounds of its share.
    """
    spark = plan.sparkSession
    grid = max(64, 4 * plan.count())
    cells = plan.select("key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.floor(F.col("high") * grid))).alias("cell"))
    # i is split so that the fraction keeps its precision for large i
    high, low = F.shiftright("id", 20), F.col("id").bitwiseAND((1 << 20) - 1)
    step = (GOLDEN * (1 << 20)) % 1.0
    point = F.pmod(high * step + low * GOLDEN, F.lit(1.0))
    points = spark.range(slots).select("id", point.alias("x")).withColumn("cell", F.floor(F.col("x") * grid))
    hits = points.join(cells, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    pieces = slices_for(slots)
    placed = cut(hits.select("key", "id", F.floor(F.col("id") * pieces / max(slots, 1)).alias("slice")))
    return running_before(placed, ["key"], ["id"], F.lit(1), "rank", "slice").select("key", "id", "rank")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0, block_tokens: int = 8192, seed: int = 17,
) -> DataFrame:
    """Per row: id, key (text hash), size, source_size, target, taken, and in ``slots`` the slot of each of its copies."""
    mixed = _mixed(docs, id_col, text_col, source_col, weights, most, block_tokens, seed)
    return mixed.select(F.col("id").alias(id_col), "text_key", "size", "source_size", "target", "taken", "slots")


def _passes(most: float) -> int:
    """How often a source is begun at most."""
    return max(1, math.ceil(most))


def order_of_slots(given: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, rank, slot) for the slots 0 to ``needed`` - 1 of each source: those that ``given`` (key, id, rank) holds keep
    their number, the others take the numbers that ``given`` has too many of.
    """
    counted = given.groupBy("key").agg(F.count("*").alias("given"))
    needs = given.join(plan.select("key", "needed"), "key")
    kept = needs.where("rank < needed").select("key", "rank", F.col("id").alias("slot"))
    over = sorted_rank(needs.where("rank >= needed").select("id"), F.col("id"), out="place")
    short = plan.join(counted, "key", "left").select("key", F.coalesce("given", F.lit(0)).alias("given"), "needed").where("given < needed")
    added = short.select("key", F.explode(F.sequence("given", F.col("needed") - 1)).alias("rank"))
    # dealt by hash, so that the slots added to one source do not stand together
    dealt = sorted_rank(added, F.xxhash64("key", "rank"), F.col("key"), F.col("rank"), out="place")
    return kept.unionByName(dealt.join(over, "place").select("key", "rank", F.col("id").alias("slot")))


def _mixed(docs, id_col, text_col, source_col, weights, most, block_tokens, seed) -> DataFrame:
    sizes = cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
        text_key(F.col(text_col)).alias("text_key"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("order", F.xxhash64(F.lit(seed), F.col("id"), F.col("text_key"))))
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goal = cut(targets(sizes, weights, most))
    sources = goal.count()
    hint = F.broadcast if sources <= _SMALL else (lambda df: df)
    size, block = F.col("source_size"), F.lit(block_tokens)
    wanted = F.least(F.floor(F.col("target") + 0.5), F.floor(size * most)).cast("long")
    whole = F.when(size > 0, F.floor(wanted / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    plan = goal.select(
        "key", "source_size", "target", F.expr(f"(source_size + {block_tokens} - 1) div {block_tokens}").alias("blocks"), whole.alias("whole"), (wanted - whole * size).alias("rest"),
    ).withColumn("needed", F.col("whole") * F.col("blocks") + F.expr(f"(rest + {block_tokens} - 1) div {block_tokens}"))
    # cumulative shares of the slots, summed in the order of the key
    share = sorted_rank(plan.where("needed > 0"), F.col("key"))
    share = cut(share.withColumn("slice", F.expr("rank div 50000")).withColumn("one", F.lit(0)))
    bounds = running_before(share, ["one"], ["rank"], F.col("needed"), "before", "slice")
    slots = share.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]
    bounds = cut(bounds.select("key", (F.col("before") / max(slots, 1)).alias("low"), ((F.col("before") + F.col("needed")) / max(slots, 1)).alias("high")))
    given = cut(schedule(bounds, slots))
    placed = order_of_slots(given, plan).join(hint(plan), "key")
    last = (F.col("rank") == F.col("needed") - 1) & (F.col("rest") > 0) & (F.col("rest") % block != 0)
    # times a block is taken whole, and how far into it the last slot reaches
    turns = placed.groupBy("key", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.count(F.when(~last, 1)).alias("times"), F.coalesce(F.max(F.when(last, F.col("rest") % block)), F.lit(0)).alias("part"),
        # the slot of the block in each pass over the source
        *[F.max(F.when(F.floor(F.col("rank") / F.col("blocks")) == p, F.col("slot"))).alias(f"slot{p}") for p in range(_passes(most))],
    )
    n = slices_for(rows)
    # documents without words take no part
    streamed = running_before(sizes.where("size > 0").withColumn("slice", spread_position(F.col("order"), n)), ["key"], ["order", "id", "text_key", "row"], F.col("size"), "start", "slice")
    touched = F.sequence(F.expr(f"start div {block_tokens}"), F.expr(f"(start + size - 1) div {block_tokens}"))
    pieces = streamed.select("id", "row", "key", "text_key", "size", "start", F.explode(touched).alias("block"))
    joined = pieces.join(turns, ["key", "block"], "left")
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, block)
    taken = F.coalesce(F.col("times") * (end - begin) + F.greatest(F.least(F.col("part"), end) - begin, F.lit(0)), F.lit(0))
    # a copy begins in the slot of the block its first word is in
    begins = F.col("block") == F.expr(f"start div {block_tokens}")
    summed = joined.groupBy("row", "id", "key", "text_key", "size").agg(
        F.sum(taken).cast("long").alias("taken"), *[F.max(F.when(begins, F.col(f"slot{p}"))).alias(f"slot{p}") for p in range(_passes(most))]
    )
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    summed = summed.select("id", "key", "text_key", "size", "taken", F.slice(F.array(*[f"slot{p}" for p in range(_passes(most))]), F.lit(1), copies).alias("slots"))
    empty = sizes.where("size = 0").select("id", "key", "text_key", "size", F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"))
    summed = summed.unionByName(empty)
    return summed.join(hint(plan.select("key", "source_size", "target")), "key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **options) -> DataFrame:
    """The mixture as rows with the columns of ``docs``: a document as often as it is taken whole, and once more cut to
    its first words where the last block of its source ends inside it. Documents that are not taken are left out.

    Rows equal in id and text share what they take evenly, rounded to whole copies of the group's sum, and come at the
    first slot that one of them has in a pass. With ``slot_col`` each row carries its slot: sorted by it, the rows are the
    interleaved mixture.
    """
    passes = _passes(options.get("most", 3.0))
    took = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col(id_col).alias("id"), "text_key", "size").agg(
        F.sum("taken").alias("taken"), F.count("*").alias("rows"), *[F.min(F.get("slots", F.lit(p))).alias(f"slot{p}") for p in range(passes)]
    ).withColumn("slots", F.array(*[f"slot{p}" for p in range(passes)]))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own"), text_key(F.col(text_col)).alias("h"))
    found = keyed.join(took, keyed["own"].eqNullSafe(took["id"]) & (keyed["h"] == took["text_key"])).where("taken > 0")
    # of rows equal in id and text each takes its part; the parts need no numbering, as the rows are the same
    each = F.expr("taken div rows")
    copies = F.expr("array_repeat(size, cast((taken div rows) div size as int))")
    rest = each - F.expr("(taken div rows) div size") * F.col("size")
    sized = found.select("doc", "size", "slots", F.posexplode(F.concat(copies, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("pass", "words"))
    text = F.col(f"doc.{text_col}")
    shortened = F.when(F.col("words") == F.col("size"), text).otherwise(F.concat_ws(" ", F.slice(split_words(text), F.lit(1), F.col("words").cast("int"))))
    slot = [F.get("slots", F.col("pass")).alias(slot_col)] if slot_col else []
    return sized.select(*[(shortened if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns], *slot)
