"""Cumulative-snapshot collapse of logged conversations, then chat rendering; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.llm.common import staged

#: Turn numbers in one part of a conversation: windows and rendered rows never hold more.
PART_TURNS = 256
_LANES = ("a", "b", "c", "d")


def _keyed(conversations: DataFrame) -> DataFrame:
    """Turns with the conversation key (conv_id, lone), part and a 128-bit content hash."""
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64(F.coalesce("turn", F.lit(-1).cast("long")), *content)).otherwise(F.lit(0).cast("long"))
    part = F.floor(F.coalesce("turn", F.lit(-1)) / PART_TURNS)
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", lone.alias("lone"), part.cast("long").alias("part"), "turn", "role", "text",
        F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit(7), *content).alias("h2"))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Staged rows (conv_id, lone, k, a, b, c, d): the rolling hash of the first k turns.

    The hash of a prefix is the sum of hashes of (position, role, text), 4 x 32 bits, so it
    rolls over windows of one part of a conversation plus the totals of earlier parts; texts
    never enter a window or a shuffle.
    """
    turns = _keyed(conversations).select("conv_id", "lone", "part", "turn", "h1", "h2").distinct()
    turns = staged(turns, "turns")
    conv, part = ["conv_id", "lone"], ["conv_id", "lone", "part"]
    earlier = W.partitionBy(*conv).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = turns.groupBy(*part).agg(F.count("*").alias("n"))
    before = counts.select(*part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).withColumnsRenamed({c: f"_{c}" for c in part})
    same = [turns[c].eqNullSafe(before[f"_{c}"]) for c in part]
    order = W.partitionBy(*part).orderBy("turn", "h1", "h2")
    placed = turns.withColumn("rn", F.row_number().over(order)).join(before, same[0] & same[1] & same[2]).select(*part, (F.col("before") + F.col("rn")).alias("k"), "h1", "h2")
    x, y = F.xxhash64("k", "h1", "h2"), F.xxhash64("k", "h2", "h1")
    low = F.lit(0xFFFFFFFF)
    lanes = placed.select(*part, "k", x.bitwiseAND(low).alias("a"), F.shiftrightunsigned(x, 32).alias("b"), y.bitwiseAND(low).alias("c"), F.shiftrightunsigned(y, 32).alias("d"))
    lanes = staged(lanes, "lanes")
    sums = lanes.groupBy(*part).agg(*[F.sum(c).alias(c) for c in _LANES])
    base = sums.select(*part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in _LANES]).withColumnsRenamed({c: f"_{c}" for c in part})
    run = W.partitionBy(*part).orderBy("k")
    inner = lanes.select(*part, "k", *[F.sum(c).over(run).alias(c) for c in _LANES])
    same = [inner[c].eqNullSafe(base[f"_{c}"]) for c in part]
    return staged(inner.join(base, same[0] & same[1] & same[2]).select(*conv, "k", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in _LANES]), "prefixes")


def maximal(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, lone, n_turns, copies): conversations that no longer one starts with.

    Of equal conversations the least conv_id stays and ``copies`` counts them. Prefixes and
    whole conversations are grouped by hash before the anti-join, so a first turn or a whole
    conversation that a third of the log shares is one row in it.
    """
    prefixes = prefix_hashes(conversations)
    ends = prefixes.groupBy("conv_id", "lone").agg(F.max("k").alias("k")).withColumnsRenamed({"conv_id": "_c", "lone": "_l", "k": "n"})
    same = prefixes["conv_id"].eqNullSafe(ends["_c"]) & (prefixes["lone"] == ends["_l"])
    marked = staged(prefixes.join(ends, same).select("conv_id", "lone", "k", *_LANES, "n"), "marked")
    whole = marked.where("k = n").groupBy("k", *_LANES).agg(F.min(F.struct("conv_id", "lone")).alias("least"), F.count("*").alias("copies"))
    inside = marked.where("k < n").select("k", *_LANES).distinct()
    return whole.join(inside, ["k", *_LANES], "left_anti").select("least.conv_id", "least.lone", F.col("k").alias("n_turns"), "copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, n_turns, copies, rendered): maximal conversations as chat text.

    Turns run by turn number, then by content where numbers tie; a repeated (turn, role, text)
    counts once. ``part`` is the turn number divided by 256, rounded down, so a conversation of
    any length renders in bounded rows (null turns come first, as part -1). Null roles and
    texts render empty; a turn without conv_id is a conversation of its own; other columns are
    ignored; an empty table gives no rows.
    """
    kept = staged(maximal(conversations).withColumnsRenamed({"conv_id": "_c", "lone": "_l"}), "kept")
    turns = _keyed(conversations)
    mine = turns.join(kept, turns["conv_id"].eqNullSafe(kept["_c"]) & (turns["lone"] == kept["_l"]))
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    grouped = mine.groupBy("conv_id", "lone", "part", "n_turns", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", said.alias("said")))).alias("said"))
    return grouped.select("conv_id", "part", "n_turns", "copies", F.array_join("said.said", "").alias("rendered"))


ORACLE_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM turns GROUP BY conv_id),
least AS (SELECT min(conv_id) AS conv_id, l, count(*) AS copies FROM convs GROUP BY l),
inside AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM least)),
kept AS (SELECT conv_id, l, copies FROM least ANTI JOIN inside USING (l))
SELECT t.conv_id, t.turn // 256 AS part, len(k.l) AS n_turns, k.copies,
  string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.turn, t.role, t.text) AS rendered
FROM turns t JOIN kept k ON t.conv_id = k.conv_id
GROUP BY t.conv_id, t.turn // 256, len(k.l), k.copies
"""
