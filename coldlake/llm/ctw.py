"""Language-model scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import discard, release, staged, utf8

#: Bytes of context; at most 5, as a gram and a row number share 64 bits.
DEPTH = 5
#: Byte that starts and ends every text; it never occurs in UTF-8.
EDGE = 0xFF
#: Most (context, byte) scores that are broadcast, 16 bytes each; beyond, scores are joined.
BROADCAST_ROWS = 8_000_000
#: Most words whose counts are broadcast; all other words are joined.
HEAD_WORDS = 1 << 18
_SLICE_BYTES = 1_000_000
_FLUSH = 1_000_000


def held_out(id_col: Column, parts: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == fold


def _slices(column: pa.Array, size: int = _SLICE_BYTES):
    """(first, last) row ranges of a binary column that hold about ``size`` bytes, one row at least.

    Only one slice's texts and code arrays, a few dozen times its bytes, are in memory at once.
    """
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
        hi = min(hi, lo + 65_536)
        yield lo, hi
        lo = hi


def _lowered(column: pa.Array) -> list[bytes]:
    return [x.lower() for x in column.to_pylist()]


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, next byte) at each byte and at the end of every text, and first places."""
    pad = bytes([EDGE]) * depth
    raw = np.frombuffer(b"".join(pad + t + bytes([EDGE]) for t in texts), dtype=np.uint8).astype(np.int64)
    n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    code = np.zeros(len(raw) - depth, dtype=np.int64)
    for i in range(depth + 1):
        code = (code << 8) | raw[i:i + len(code)]
    first = np.cumsum(n + depth) - n - depth
    keep = np.ones(len(raw), dtype=bool)
    keep[(first[:, None] + np.arange(depth)).ravel()] = False
    return code[keep[depth:]], np.concatenate(([0], np.cumsum(n)[:-1]))


def text_scores(codes: np.ndarray, first: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the codes' values by text. Sorted (code, text) pairs look each code up once."""
    n = np.diff(np.append(first, len(codes)))
    pairs = np.sort((codes.astype(np.uint64) << np.uint64(16)) | np.repeat(np.arange(len(first), dtype=np.uint64), n))
    code = (pairs >> np.uint64(16)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    per_pair = np.repeat(values[np.searchsorted(keys, code[at])], np.diff(np.append(at, len(code))))
    return np.bincount((pairs & np.uint64(0xFFFF)).astype(np.int64), weights=per_pair, minlength=len(first))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.add.reduceat(counts, at)


def _sources(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), train.alias("train"), utf8(F.col(text_col)).alias("body"))


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """Staged rows (gram, n): training count of every gram of any document (0: held out only).

    Tasks count their own texts and emit sums, at the latest each million distinct grams.
    """
    def run(batches):
        held, size = [], 0

        def merged():
            return _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
        for b in batches:
            train = b.column("train").to_pylist()
            for lo, hi in _slices(b.column("body")):
                body = _lowered(b.column("body").slice(lo, hi - lo))
                for flag in (True, False):
                    texts = [t for t, k in zip(body, train[lo:hi], strict=True) if k == flag]
                    if texts:
                        codes, counts = np.unique(grams(texts, depth)[0], return_counts=True)
                        held.append((codes, counts * flag))
                        size += len(codes)
                if size > 4 * _FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["gram", "n"])
                        held, size = [], 0
        if held:
            codes, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["gram", "n"])

    return staged(docs.select("train", "body").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after eight recurrence steps; exact to 1e-12 from one half on."""
    z, shift = x + 8.0, F.lit(1.0)
    for i in range(8):
        shift = shift * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def _ln_kt(n0: Column, n1: Column) -> Column:
    return _ln_gamma(n0 + 0.5) + _ln_gamma(n1 + 0.5) - _ln_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _bits(table: DataFrame, *keep: str) -> DataFrame:
    """The eight binary decisions of each gram: (ctx, node, bit); node is the path so far."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    return table.select(*keep, F.shiftright("gram", 8).alias("ctx"), byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        *keep, "ctx", F.expr("cast(shiftleft(1, k) | shiftright(byte, 8 - k) as int)").alias("node"), F.expr("cast(shiftright(byte, 7 - k) & 1 as int)").alias("bit"))


def fit(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Staged rows (gram, score): log10 of the weighted probability of each gram's byte.

    Every binary node of every context of 0 to ``depth`` bytes has its zero and one counts.
    Upwards, each node's weighted probability is half its Krichevsky-Trofimov estimate plus
    half the product of its children's; downwards, the share the estimate has in that mixes the
    next-bit estimates of all depths that training saw. All levels are grouped tables, deleted
    as soon as the next step is stored; the deepest, by far the largest, holds counts alone.
    """
    spark = counts.sparkSession
    bits = _bits(counts.select("gram", "n"), "n")
    level = bits.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = [staged(level, f"level{depth}")]
    release(spark)
    half = math.log(0.5)
    for d in range(depth - 1, -1, -1):
        below = levels[-1] if levels[1:] else levels[0].withColumn("ln_w", _ln_kt(F.col("n0"), F.col("n1")))
        up = below.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("ln_w").alias("below"))
        up = up.withColumn("own", _ln_kt(F.col("n0"), F.col("n1")) + half).withColumn("rest", F.col("below") + half)
        top = F.greatest("own", "rest")
        up = up.withColumn("ln_w", top + F.log1p(F.exp(F.least("own", "rest") - top))).withColumn("share", F.exp(F.col("own") - F.col("ln_w")))
        levels.append(staged(up.select("ctx", "node", "n0", "n1", "ln_w", "share"), f"level{d}"))
        release(spark)
    mixed = previous = None
    for d, level in enumerate(reversed(levels)):
        if d == depth:
            level = level.withColumn("share", F.lit(1.0))
        one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        if mixed is None:
            cur = level.withColumn("done", F.lit(0.0)).withColumn("left", F.lit(1.0)).withColumn("above", F.lit(0.5))
        else:
            parent = mixed.select(F.col("ctx").alias("up"), F.col("node").alias("up_node"), F.col("done_next").alias("done"), F.col("left_next").alias("left"), F.col("p1").alias("above"))
            cur = level.withColumn("short", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(parent, (F.col("short") == F.col("up")) & (F.col("node") == F.col("up_node")))
        seen = F.col("n0") + F.col("n1") > 0
        mixed = cur.select("ctx", "node", F.when(seen | F.lit(d == 0), F.col("done") + F.col("left") * one).otherwise(F.col("above")).alias("p1"),
                           (F.col("done") + F.col("left") * F.col("share") * one).alias("done_next"), (F.col("left") * (1 - F.col("share"))).alias("left_next"))
        if d < depth:
            shorter, mixed = previous, staged(mixed, f"mixed{d}")
            for used in (level, shorter):
                discard(used) if used is not None else None
            previous = mixed
            release(spark)
    p = F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    out = staged(_bits(counts.select("gram"), "gram").join(mixed.select("ctx", "node", "p1"), ["ctx", "node"]).groupBy("gram").agg(F.sum(F.log10(p)).alias("score")), "scores")
    for x in (levels[0], previous):
        if x is not None:
            discard(x)
    release(spark)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """Staged rows (word, c, n): counts in training texts and in all texts."""
    def run(batches):
        counts = {True: Counter(), False: Counter()}

        def flush():
            for flag, c in counts.items():
                if c:
                    n = np.fromiter(c.values(), dtype=np.int64, count=len(c))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(n * flag), pa.array(n)], names=["word", "c", "n"])
                    c.clear()
        for b in batches:
            for x, flag in zip(b.column("body"), b.column("train").to_pylist(), strict=True):
                counts[flag].update(x.as_py().lower().split())
                if len(counts[flag]) > 200_000:
                    yield from flush()
        yield from flush()

    found = docs.select("train", "body").mapInArrow(run, "word binary, c long, n long")
    return staged(found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")


def _head(words: DataFrame, most: int = HEAD_WORDS) -> tuple[dict[bytes, float], float]:
    """The most frequent words, at most ``most``, as word -> log10(c + 1); the least n taken.

    The cut comes from a histogram of quarter powers of two, a few hundred rows at any size.
    """
    bucket = F.floor(F.log2("n") * 4)
    total, least = 0, None
    for r in words.groupBy(bucket.alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("b")).collect():
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return {}, float("inf")
    rows = words.where(F.col("n") >= least).select("word", "c").toArrow()
    lg = np.log10(rows.column("c").to_numpy().astype(float) + 1)
    return dict(zip(rows.column("word").to_pylist(), lg.tolist(), strict=True)), least


def score(docs: DataFrame, train: Column | None = None, depth: int = DEPTH, broadcast_rows: int = BROADCAST_ROWS, head_words: int = HEAD_WORDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes), one per input row.

    ``score`` is the log10 probability that context-tree weighting, trained on rows where
    ``train`` holds, gives the lower-cased bytes and the end of the text; over n_bytes it is a
    code length. ``base_score`` is the add-one unigram score of words and end. Model scores are
    broadcast up to ``broadcast_rows`` grams and joined beyond, with equal results. Null text
    is empty and has its end alone; without training rows every bit has probability one half;
    rows that repeat are scored each; other columns are ignored.
    """
    if not 0 <= depth <= DEPTH:
        raise ValueError(f"depth is {depth}, but must be 0 to {DEPTH}")
    spark = docs.sparkSession
    if train is None:
        train = ~held_out(F.col(id_col))
    src = _sources(docs, id_col, text_col, train)
    counts = gram_counts(src, depth)
    model = fit(counts, depth)
    discard(counts)
    words = word_counts(src)
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = src.where("train").count()
    train_tokens, kinds = totals["n"] + ends, totals["v"] + (ends > 0)
    head, least = _head(words, head_words)
    shared_head = spark.sparkContext.broadcast(head)
    small = model.count() <= broadcast_rows
    shared = None
    if small:
        rows = model.orderBy("gram").toArrow()
        shared = spark.sparkContext.broadcast((rows.column("gram").to_numpy(), rows.column("score").to_numpy()))
        discard(model)
    end_score, end_known = math.log10(ends + 1), int(ends > 0)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        get = shared_head.value.get
        keys, values = shared.value if small else (None, None)
        for b in batches:
            for lo, hi in _slices(b.column("body")):
                body = _lowered(b.column("body").slice(lo, hi - lo))
                out: dict[str, list] = {c: [] for c in ("n", "known", "base", "tail")}
                for x in body:
                    ws = x.split()
                    got = [get(w) for w in ws]
                    here = [v for v in got if v is not None]
                    rest = Counter(w for w, v in zip(ws, got, strict=True) if v is None) if len(here) < len(ws) else {}
                    out["n"].append(len(ws) + 1)
                    out["known"].append(sum(v > 0 for v in here) + end_known)
                    out["base"].append(math.fsum(here) + end_score)
                    out["tail"].append([{"word": w, "k": k} for w, k in rest.items()])
                codes, first = grams(body, depth)
                if small:
                    per_doc = text_scores(codes, first, keys, values)
                    seen = [[] for _ in first]
                else:
                    per_doc = np.zeros(len(first))
                    seen = [[{"gram": int(g), "k": int(k)} for g, k in zip(*np.unique(x, return_counts=True), strict=True)] for x in np.split(codes, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["base"]),
                     pa.array(out["tail"], pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))), pa.array(per_doc),
                     pa.array(seen, pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64())]))), pa.array([len(x) for x in body], pa.int64())],
                    names=["rid", "doc_id", "n", "known", "base", "tail", "score", "seen", "n_bytes"])

    first = staged(src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "body").mapInArrow(
        run, f"rid long, doc_id {kind}, n long, known long, base double, tail array<struct<word:binary,k:long>>, score double, seen array<struct<gram:long,k:long>>, n_bytes long"), "scored")
    # Words outside the head are no hot keys: each has fewer occurrences than any head word.
    tail = (first.select("rid", F.explode("tail").alias("w")).select("rid", "w.word", "w.k").join(words.where(F.col("n") < least).where("c > 0").select("word", "c"), "word")
            .groupBy("rid").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tail_base")))
    out = first.join(tail, "rid", "left")
    model_score = F.col("score")
    if not small:
        far = first.select("rid", F.explode("seen").alias("g")).select("rid", "g.gram", "g.k").join(model.withColumnRenamed("score", "lg"), "gram")
        out = out.join(far.groupBy("rid").agg(F.sum(F.col("k") * F.col("lg")).alias("far")), "rid", "left")
        model_score = F.coalesce("far", F.lit(0.0))
    total = math.log10(train_tokens + kinds + 1)
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n") * F.lit(total)).alias("base_score"), model_score.alias("score"), "n_bytes")
