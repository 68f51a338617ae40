"""Toxic spans by a two-state linear-chain CRF; marginals give document scores and offsets."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.llm.decontaminate import words

#: Labelled rows of each class that the tagger is fitted on: the bound of the training sample.
SAMPLE = {1: 500, 0: 1000}
#: Longer texts are scored like any other but not drawn into the training sample.
SAMPLE_BYTES = 20_000
#: Ids drawn per row of the sample, so that long texts and near copies leave it full.
OVERDRAW = 3
FEATURE_BITS = 18
EPOCHS = 30
THRESHOLD = 0.3
#: A word or prefix is telling from a log-likelihood ratio of this much over 2 ln(candidates) on.
MIN_EVIDENCE = 6.0
#: Least marginal that counts towards a document's sum.
MIN_MARGINAL = 0.2
CACHE_WORDS = 300_000
#: Words of whole documents that training tags at a time: bounds its arrays, not the sample.
PART_WORDS = 200_000
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def features(word: bytes) -> list[int]:
    """Hashed indicators of a word: itself, its prefixes of 3 to 10 bytes, two suffixes."""
    mask, crc = (1 << FEATURE_BITS) - 1, zlib.crc32
    out = [crc(word, 1) & mask]
    out += [crc(word[:k], 16 + k) & mask for k in range(3, min(11, len(word)))]
    out += [crc(word[-k:], 64 + k) & mask for k in (3, 4) if len(word) > k]
    return out


def _evidence_keys(word: bytes) -> list[bytes]:
    """What weak token labels look at: the word and its prefixes from 5 bytes on."""
    return [b"=" + word, *(word[:k] for k in range(5, min(11, len(word))))]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) for all t; the first map is constant.

    The sequence is cut into lanes that advance together: one pass composes each lane's 2x2
    maps, a short loop carries values over lanes, a second pass fills in every r.
    """
    n = len(a)
    if n == 0:
        return np.zeros(0)
    lanes = max(1, int(n ** 0.5))
    steps = -(-n // lanes)
    pad = steps * lanes - n

    def rows(x, fill):
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(lanes, steps).T)

    a, b, c, d = rows(a, 1.0), rows(b, 0.0), rows(c, 0.0), rows(d, 1.0)
    p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, steps):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 8 == 0:
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
    start, value = np.empty(lanes), 1.0
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[k] = value
        value = (w * value + x) / (y * value + z)
    out = np.empty_like(a)
    cur = start
    for t in range(steps):
        cur = (a[t] * cur + b[t]) / (c[t] * cur + d[t])
        out[t] = cur
    return out.T.reshape(-1)[:n]


@dataclass
class Crf:
    """Weights of the tagger (states clean 0 and toxic 1) and of the document score."""

    weights: np.ndarray  # log odds of toxic by feature
    bias: float
    start: float
    trans: np.ndarray  # log weights of clean->toxic, toxic->clean, toxic->toxic; clean->clean is 0
    platt: np.ndarray  # document score: constant, greatest marginal, log of 1 + sum of marginals

    def emission(self, word: bytes) -> float:
        return float(np.clip(self.bias + self.weights[features(word)].sum(), -30, 30))

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratios, backward ratios, token odds and marginals of concatenated documents."""
        x = np.exp(emission)
        ot, to, tt = np.exp(self.trans)
        one, zero = np.ones_like(x), np.zeros_like(x)
        fwd = scan(np.where(first, 0, x * tt), np.where(first, x * np.exp(self.start), x * ot), np.where(first, zero, to), one)
        last = np.append(first[1:], True)
        nx = np.append(x[1:], 1.0)
        back = scan(np.where(last, 0, tt * nx)[::-1], np.where(last, one, to)[::-1], np.where(last, 0, ot * nx)[::-1], one)[::-1]
        odds = fwd * back
        return fwd, back, x, odds / (1 + odds)

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = self.platt[0] + self.platt[1] * top + self.platt[2] * np.log1p(total)
        return 1 / (1 + np.exp(-z))


def is_held_out(id_col: Column, parts: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == fold


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, held_out, sample: dict = SAMPLE) -> tuple[DataFrame | None, dict]:
    """Candidate texts (at, text, y) of the training sample, and the class totals.

    Only ids outside ``held_out`` and labels 0 or 1 count. At most OVERDRAW times ``sample`` ids
    per class, the first by id hash, are broadcast to fetch their whole texts; texts over
    SAMPLE_BYTES are not drawn, and of ids with many different texts the first by (at, text)
    fill the bound. ``at`` is the id's hash. None without a labelled row.
    """
    known = (labels.select("doc_id", F.col(label_col).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
             .select(F.xxhash64("doc_id").alias("at"), "doc_id", "y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in sample.items():
        part = known.where(F.col("y") == y).orderBy("at", "doc_id").limit(OVERDRAW * n)
        picked = part if picked is None else picked.unionByName(part)
    ids = picked.collect()
    if not ids:
        return None, totals
    few = docs.sparkSession.createDataFrame(ids, picked.schema)
    rows = (docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(few), "doc_id")
            .select("at", "text", "y").distinct())
    return rows.orderBy("at", "text", "y").limit(2 * OVERDRAW * sum(sample.values())), totals


def _without_near_copies(drawn: list[tuple[bytes, int]], sample: dict = SAMPLE) -> Iterator[tuple[list[bytes], int]]:
    """Words and class of the first documents of each class up to ``sample``, one of each family of
    near copies, else every word of a copied text looks telling. Texts are split one at a time."""
    seen: set[int] = set()
    left = dict(sample)
    for text, y in drawn:
        if not left[y]:
            continue
        ws = words(text)
        low = sorted({zlib.crc32(b" ".join(ws[i:i + 3])) for i in range(max(1, len(ws) - 2))})[:3]
        if sum(h in seen for h in low) * 2 <= len(low):
            yield ws, y
            left[y] -= 1
        seen.update(low)


def _log_likelihood(k: np.ndarray, n: int, j: np.ndarray, m: int) -> np.ndarray:
    """G2 of k of n toxic against j of m clean documents, zero where toxic ones have less."""
    k, j = k.astype(float), j.astype(float)
    p, p1, p0 = (k + j) / (n + m), k / max(n, 1), j / max(m, 1)

    def ll(x, size, rate):
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return x * np.log(rate) + (size - x) * np.log(1 - rate)

    return np.where(p1 > 8 * p0, 2 * (ll(k, n, p1) + ll(j, m, p0) - ll(k, n, p) - ll(j, m, p)), 0)


def train(drawn: list[tuple[bytes, int]], totals: dict, epochs: int = EPOCHS, sample: dict = SAMPLE) -> Crf:
    """Fit the CRF on weakly tagged tokens, then the document score on its marginals.

    Labels mark documents, so a token is tagged toxic when its document is toxic and the word
    or a prefix of it occurs far more often in toxic documents than in clean ones
    (log-likelihood ratio); everything else is tagged clean. Without both classes the score is
    the share of toxic labels for every text.
    """
    types: dict[bytes, int] = {}  # documents are held as numbers of their words
    docs = [(np.array([types.setdefault(w, len(types)) for w in ws], dtype=np.int32), y) for ws, y in _without_near_copies(drawn, sample)]
    names = list(types)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    size = {y: sum(1 for _, z in docs if z == y) for y in (0, 1)}
    empty = Crf(np.zeros(1 << FEATURE_BITS), -12.0, 0.0, np.array([-3.0, 0.0, 0.0]), np.array([np.log(prior / (1 - prior)), 0, 0]))
    if not size[0] or not size[1]:
        return empty
    toxic, clean = Counter(), Counter()
    for at, y in docs:
        if y == 1:
            toxic.update({k for i in np.unique(at) for k in _evidence_keys(names[i])})
    toxic = {k: n for k, n in toxic.items() if n > 2}
    for at, y in docs:
        if y == 0:
            clean.update({k for i in np.unique(at) for k in _evidence_keys(names[i]) if k in toxic})
    keys = list(toxic)
    g2 = _log_likelihood(np.array([toxic[k] for k in keys]), size[1], np.array([clean[k] for k in keys]), size[0])
    least = MIN_EVIDENCE + 2 * np.log(len(keys) + 1)  # many candidates meet some ratio by chance
    telling = {k for k, g in zip(keys, g2, strict=True) if g >= least}
    del toxic, clean
    ids = np.concatenate([at for at, _ in docs])
    lengths = np.array([len(at) for at, _ in docs])
    first = np.zeros(len(ids), dtype=bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]] = True
    toxic_doc = np.repeat(np.array([y for _, y in docs]), lengths)
    toxic_type = np.array([any(k in telling for k in _evidence_keys(w)) for w in types])
    tag = ((toxic_doc == 1) & toxic_type[ids]).astype(float)
    listed = [np.array(features(w), dtype=np.int32) for w in types]
    col = np.concatenate(listed)
    row = np.repeat(np.arange(len(listed)), [len(f) for f in listed])
    parts = _parts(lengths)

    crf = Crf(np.zeros(1 << FEATURE_BITS), -4.0, -3.0, np.array([-3.0, 0.0, 0.0]), np.zeros(3))
    goal = np.zeros(3)
    for lo, hi in parts:
        inner = np.flatnonzero(~first[lo:hi])
        y0, y1 = tag[lo:hi][inner - 1], tag[lo:hi][inner]
        goal += np.array([((1 - y0) * y1).sum(), (y0 * (1 - y1)).sum(), (y0 * y1).sum()])
    theta = [crf.weights, np.array([crf.bias, crf.start, *crf.trans])]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        crf.weights, (crf.bias, crf.start), crf.trans = theta[0], theta[1][:2], theta[1][2:]
        em = np.clip(crf.bias + np.bincount(row, weights=crf.weights[col], minlength=len(listed)), -30, 30)
        ot, to, tt = np.exp(crf.trans)
        by_type, starts, moves = np.zeros(len(listed)), 0.0, np.zeros(3)
        for lo, hi in parts:
            fwd, back, x, marg = crf.marginals(em[ids[lo:hi]], first[lo:hi])
            off = tag[lo:hi] - marg
            by_type += np.bincount(ids[lo:hi], weights=off, minlength=len(listed))
            starts += off[first[lo:hi]].sum()
            inner = np.flatnonzero(~first[lo:hi])
            tail, before = x[inner] * back[inner], fwd[inner - 1]
            pair = np.stack([ot * tail, to * before, tt * before * tail])
            pair /= 1 + pair.sum(axis=0)
            moves += pair.sum(axis=1)
        g = [np.bincount(col, weights=by_type[row], minlength=1 << FEATURE_BITS) - 0.05 * theta[0],
             np.array([by_type.sum(), starts, *(goal - moves)])]
        for k in range(2):  # Adam
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            theta[k] = theta[k] + 0.25 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    crf.weights, (crf.bias, crf.start), crf.trans = theta[0], theta[1][:2], theta[1][2:]
    em = np.clip(crf.bias + np.bincount(row, weights=crf.weights[col], minlength=len(listed)), -30, 30)
    marg = np.concatenate([crf.marginals(em[ids[lo:hi]], first[lo:hi])[3] for lo, hi in parts])
    top, total = document_sums(marg, lengths)
    y = np.array([z for _, z in docs], dtype=float)
    weight = np.where(y == 1, prior / size[1], (1 - prior) / size[0]) * len(y)
    crf.platt = _logistic(np.stack([np.ones(len(y)), top, np.log1p(total)], axis=1), y, weight)
    return crf


def _parts(lengths: np.ndarray, most: int = PART_WORDS) -> list[tuple[int, int]]:
    """Ranges of words that cut concatenated documents, between documents only, at about ``most``."""
    ends = np.cumsum(lengths)
    cuts = [0]
    while cuts[-1] < ends[-1]:
        cuts.append(int(ends[max(np.searchsorted(ends, cuts[-1] + most, "right") - 1, np.searchsorted(ends, cuts[-1], "right"))]))
    return list(zip(cuts, cuts[1:], strict=False))


def document_sums(marg: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest marginal and sum of marginals of each document; zero without words.

    Marginals under MIN_MARGINAL are the tagger's background: they don't add up in long texts.
    """
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = lengths > 0
    if full.any():
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))[full]
        top[full], total[full] = np.maximum.reduceat(marg, at), np.add.reduceat(np.where(marg >= MIN_MARGINAL, marg, 0.0), at)
    return top, total


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * w)
    return w


def score(docs: DataFrame, crf: Crf, carry: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (row struct of ``carry``, score, predicted, spans) for every input row.

    ``spans`` are the words with a toxic marginal of at least a half: code point offsets
    (end exclusive) and marginal. Null and empty texts get the score of a text without toxic
    words; repeated rows are scored each; input column names cannot clash, as they travel in
    the struct. Texts are tagged whole, in groups of about a million bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    found = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("p", T.DoubleType()))
    out = T.StructType([src.schema["row"]]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("spans", found)

    def run(batches):
        model, cache = shared.value, {}
        for b in batches:
            lo, sizes = 0, np.cumsum(np.array(pa.compute.binary_length(b.column("body")).to_pylist(), dtype=np.int64) + 1)
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + 1_000_000)))
                texts = b.column("body").slice(lo, hi - lo).to_pylist()
                top, total, spans = _tag(model, texts, cache)
                p = model.score(top, total)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                    names=["row", "score", "predicted", "spans"])
                lo = hi

    return src.mapInArrow(run, out)


def _tag(model: Crf, texts: list[str], cache: dict[bytes, float]):
    tokens = [words(t.encode()) for t in texts]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    em: list[float] = []
    for ws in tokens:
        for w in ws:
            e = cache.get(w)
            if e is None:
                e = cache[w] = model.emission(w)
            em.append(e)
    lengths = np.array([len(ws) for ws in tokens])
    first = np.zeros(len(em), dtype=bool)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(int)
    first[starts[lengths > 0]] = True
    marg = model.marginals(np.array(em), first)[3]
    top, total = document_sums(marg, lengths)
    spans: list[list[dict]] = [[] for _ in texts]
    for k in np.flatnonzero(top >= 0.5).tolist():
        mine = marg[starts[k]:starts[k] + lengths[k]]
        found = [m.span() for m in _WORD.finditer(texts[k])]
        spans[k] = [{"start": found[i][0], "end": found[i][1], "p": float(mine[i])} for i in np.flatnonzero(mine >= 0.5).tolist()]
    return top, total, spans


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out=lambda c: is_held_out(c, 4, 2), sample: dict = SAMPLE) -> Crf:
    """The tagger fitted on the bounded sample, in one task; only its weights reach the driver.

    Without documents, labels or one of the classes it is the prior of the labels seen.
    """
    rows, totals = sample_labelled(docs, labels, label_col, held_out, sample)

    def run(batches):
        drawn = [row for b in batches for row in zip(*(c.to_pylist() for c in (b.column("at"), b.column("text").cast(pa.binary()), b.column("y"))), strict=True)]
        if drawn:
            drawn.sort()
            crf = train([d[1:] for d in drawn], totals, sample=sample)
            pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(crf)], pa.binary())], names=["crf"])

    done = [] if rows is None else rows.mapInArrow(run, "crf binary").collect()
    return pickle.loads(bytes(done[0]["crf"])) if done else train([], totals)
