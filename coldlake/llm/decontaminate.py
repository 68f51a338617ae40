"""Benchmark decontamination: a broadcast set of test n-grams against training token windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import discard, staged, utf8

WINDOW = 13
#: UTF-8 bytes of benchmark text that one broadcast set holds, about 90 MB as a set; more text
#: is scanned in parts.
PART_BYTES = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes.maketrans(
    bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x41, 0x5B)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)),
    b" " * 0x30 + b" " * 7 + bytes(range(0x61, 0x7B)) + b" " * 6 + b" " * 5)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of a-z, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class GramSet:
    """The windows of benchmark items: word numbers, window hashes to test, windows to verify."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.owners[tuple(ids[i:i + size])].add(item)
        by_size = defaultdict(list)
        for gram in self.owners:
            by_size[len(gram)].append(gram)
        self.hashes = {n: np.unique(_hash(np.array(g, dtype=np.uint64), n)) for n, g in by_size.items()}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Word count, hit word ranges [from, to) merged and sorted, items with windows here."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        found, items = [], set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = _hash(ids[at[:, None] + np.arange(size)] if len(at) < 50_000 else np.lib.stride_tricks.sliding_window_view(ids, size)[at], size)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                owner = self.owners.get(tuple(ids[i:i + size].tolist()))
                if owner:
                    found.append((i, i + size))
                    items |= owner
        return len(ids), merged(found), items


def _hash(grams: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(grams), dtype=np.uint64)
    for j in range(size):
        h = (h ^ grams[:, j]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, n_words, hits array<struct<start,end>>, items array<string>).

    ``hits`` are merged ranges of word positions inside occurrences of benchmark windows,
    ``items`` the sorted distinct item ids. The set is broadcast only up to ``part_bytes`` of
    benchmark text; a larger benchmark is split by item hash and the documents scanned once a
    part, which gives the same rows. Null or empty texts have no words; null items ids count
    as ''; repeated rows are scanned each; other columns are ignored; empty tables are fine.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(F.col(item_text_col)).alias("body")).distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // part_bytes))
    cur = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema, old = cur.schema, None
    for k in range(parts):
        mine = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        grams = spark.sparkContext.broadcast(GramSet([(r["item"], bytes(r["body"])) for r in mine.collect()], window))

        def run(batches, grams=grams):
            for b in batches:
                n, hits, items = [], [], []
                for text, h, i in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
                    count, ranges, owners = grams.value.scan((text or "").encode())
                    if h:
                        ranges = merged([(x["start"], x["end"]) for x in h] + ranges)
                    n.append(count)
                    hits.append([{"start": lo, "end": hi} for lo, hi in ranges])
                    items.append(sorted(owners.union(i)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text"), pa.array(n, pa.int64()),
                     pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "hits", "items"])

        cur = cur.mapInArrow(run, schema)
        if parts > 1:
            nxt = staged(cur, "scanned")
            if old is not None:
                discard(old)
            cur = old = nxt
    return cur


def judged(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: some hit, and at least one word in twenty hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return (scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))


def remove_spans(scanned: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with every hit word of the text cut out, other characters kept."""
    schema = scanned.select("doc_id", "text").schema

    def run(batches):
        for b in batches:
            texts = [_cut(t, h) for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return scanned.select("doc_id", "text", "hits").mapInArrow(run, schema)


def _cut(text: str | None, hits: list[dict]) -> str | None:
    if not hits:
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    spots, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        spots.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for h in hits:
        out.append(raw[at:spots[h["start"]][0]])
        at = spots[h["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()

