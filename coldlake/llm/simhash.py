"""SimHash near-duplicates: pigeonhole blocks over distinct fingerprints, verified bit distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import components, discard, staged, utf8

SHINGLE = 3
DISTANCE = 2
#: Blocks with more fingerprints than this are linked through bit neighbours, not pairs.
PAIR_LIMIT = 256


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash over ``size``-word shingles, repeats included; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    lows, highs = np.concatenate(([0], ends[:n - 1])).tolist(), (ends[min(size, len(words)) - 1:] - 1).tolist()
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(lows[lo:lo + 65536], highs[lo:lo + 65536], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long) in input order; null text counts as empty."""
    src = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("body"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            body = b.column("body")
            fps = np.array([fingerprint(body[i].as_py(), size) for i in range(b.num_rows)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of blocks - distance blocks.

    Fingerprints at most ``distance`` bits apart agree on all bits of one choice at least.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) over distinct ``fp`` values whose components are those of all close pairs.

    Every fingerprint is keyed by each choice of agreeing blocks. In a block of up to
    ``pair_limit`` fingerprints the pairs are joined and their Hamming distance verified. A
    fuller block is a crowd of near copies: there each fingerprint meets others at their bit
    neighbours within distance / 2, so it is linked without pairs; both ways are exact.
    ``blocks`` (default distance + 2) only sets the key width, never the result. Odd distances
    have no exact neighbour form and join pairs in every block.
    """
    if distance % 2:
        pair_limit = None  # neighbour balls meet exactly at even distances only
    masks = block_masks(blocks or distance + 2, distance)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"))
    crowded = staged(sizes.where("n > 1"), "blocks")
    keyed = staged(keyed.join(crowded, ["choice", "key"]), "keyed")
    small = keyed if pair_limit is None else keyed.where(F.col("n") <= pair_limit)
    pairs = (small.select("choice", "key", F.col("fp").alias("a")).join(small.select("choice", "key", F.col("fp").alias("b")), ["choice", "key"])
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b"))
    if pair_limit is None:
        return pairs.distinct()
    full = keyed.where(F.col("n") > pair_limit).select("fp").distinct()
    balls = full.select("fp", F.explode(neighbours(F.col("fp"), distance // 2)).alias("near"))
    centre = balls.groupBy("near").agg(F.min("fp").alias("b"))
    stars = balls.join(centre, "near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def neighbours(fp: Column, radius: int) -> Column:
    """All values within ``radius`` flipped bits."""
    flips = [0] + [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(64), r)]
    return F.transform(F.array(*[F.lit(signed(x)) for x in flips]), lambda x: fp.bitwiseXOR(x))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None,
                    pair_limit: int = PAIR_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id): the least doc_id reachable over links, one per input row.

    Copies collapse to one fingerprint before any join, so a group of copies of any size costs
    one row. Empty, null and word-free texts share fingerprint zero and link like any other.
    Repeated rows stay; null ids never become a component_id unless all ids of the component
    are null; other columns are ignored; an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, size, id_col, text_col), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), distance, blocks, pair_limit))
    least = staged(distinct.join(found, distinct["fp"] == found["node"], "left")
                   .select("fp", "least", F.coalesce("component", "fp").alias("group")), "least")
    roots = least.groupBy("group").agg(F.min("least").alias("component_id"))
    named = staged(least.join(roots, "group").select("fp", "component_id"), "named")
    discard(distinct)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
