"""Concatenate-and-cut packing: partition totals give global offsets, fixed windows cut pieces."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.llm.common import staged

SEQUENCE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}


class ByteBpe:
    """Ids of the public byte-level BPE, equal to those its JSON file gives.

    The same vocabulary as ranks encodes about four times as fast; a text that holds a special
    token's string goes through the JSON file's own encoder.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json = public_tokenizers.path(f"{vocabulary}.json")
        self._exact = None
        self.size = max(len(ranks), *(i + 1 for i in SPECIAL.values()))

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            if self._exact is None:
                from tokenizers import Tokenizer
                self._exact = Tokenizer.from_file(self._json)
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, staged: (doc_id, part, before, ids, doc_tokens) in reading order.

    ``ids`` are little-endian unsigned 16-bit when the vocabulary fits, else 32-bit;
    ``before`` counts the ids of the same partition that come first.
    """
    def run(batches):
        bpe = ByteBpe(vocabulary)
        kind = np.dtype("<u2") if bpe.size <= 1 << 16 else np.dtype("<u4")
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column("text")
            for lo in range(0, b.num_rows, 500):  # bounded output batches
                ids, counts, starts = [], [], []
                for t in texts.slice(lo, 500).to_pylist():
                    x = np.array([*bpe.encode(t or ""), END_ID], dtype=kind)
                    ids.append(x.tobytes())
                    counts.append(len(x))
                    starts.append(before)
                    before += len(x)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, 500), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([kind.itemsize] * n, pa.int32())],
                    names=["doc_id", "part", "before", "ids", "doc_tokens", "width"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return staged(src.mapInArrow(run, f"doc_id {kind}, part int, before long, ids binary, doc_tokens long, width int"), "tokens")


def pieces(tokens: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pass two: each document cut at multiples of ``sequence`` of its global offset.

    Rows (doc_id, start, length, ids binary uint32, doc_tokens, sequence_id, offset): the
    boundary records. Partition totals are one row a partition, summed by a window over those
    rows only and broadcast.
    """
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids", "doc_tokens", "width")
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids_col = b.column("doc_id")
            for lo in range(0, b.num_rows, 500):
                rows: list[tuple] = []
                for i, (at, raw, width) in enumerate(zip(*(b.column(c).slice(lo, 500).to_pylist() for c in ("at", "ids", "width")), strict=True), lo):
                    ids = np.frombuffer(raw, dtype=f"<u{width}")
                    start = 0
                    while start < len(ids):
                        room = sequence - (at + start) % sequence
                        piece = ids[start:start + room]
                        rows.append((i, start, len(piece), piece.astype("<u4").tobytes(), len(ids), (at + start) // sequence, (at + start) % sequence))
                        start += len(piece)
                if rows:
                    i, start, length, raw, total, seq, off = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids_col.take(pa.array(i)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()),
                         pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records of ``docs`` packed back to back into sequences of ``sequence`` ids.

    Every document is its ids and one end id (0), in reading order; only the last sequence can
    be short. Null or empty text is the end id alone; rows that repeat are packed each; null
    ids are carried; other columns are ignored; an empty table gives no pieces.
    """
    return pieces(tokenized(docs, vocabulary, id_col, text_col), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids, starts): the training sequences themselves.

    A sequence holds at most ``sequence`` pieces, so the group gathered here is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    return packed.groupBy("sequence_id").agg(rows.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))

