"""Hard negatives by exact inner products of several candidates at once in one wide integer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.llm.common import discard, ranked, staged

#: Candidates of a stripe and anchors of a group: the two sides of one task.
STRIPE = 8192
ANCHORS = 4096
#: Anchors whose scores against a stripe are held at a time.
ROWS = 256
#: Bits of a packed integer; wider ones are Python integers with WIDE_FIELDS fields.
WORD_BITS = 63
WIDE_FIELDS = 4


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python integers where one doesn't fit."""
    if not values.size or np.abs(values).max() < 2.0**62:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


class Packed:
    """Candidates (n, d) packed for exact products with many anchors.

    The components are biased by their least one, so that no field borrows from the next, and
    component j of ``fields`` candidates shares one integer. A field is as wide as the greatest
    possible sum of biased products; two or more fit a machine word for unit vectors. Where
    not even one fits, the integers are Python's own, of any width.
    """

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        n, d = candidates.shape
        self.n, self.d = n, d
        self.bias = int(candidates.min()) if candidates.size else 0
        self.anchor_bias = int(anchors.min()) if anchors.size else 0
        most = int(candidates.max() if candidates.size else 0) - self.bias
        anchor_most = int(anchors.max() if anchors.size else 0) - self.anchor_bias
        self.bits = max(1, (d * most * anchor_most).bit_length())
        largest = d * max(abs(self.bias), abs(self.bias + most)) * max(abs(self.anchor_bias), abs(self.anchor_bias + anchor_most))
        word = max(self.bits, largest.bit_length() + 2) <= WORD_BITS
        self.kind = np.int64 if word else object
        self.fields = max(1, WORD_BITS // self.bits) if word else WIDE_FIELDS
        self.sums = candidates.astype(self.kind).sum(axis=1) if n else np.zeros(0, dtype=self.kind)
        biased = candidates.astype(self.kind) - self.bias
        width = -(-n // self.fields)
        grid = np.zeros((width * self.fields, d), dtype=self.kind)
        grid[:n] = biased
        self.words = np.zeros((d, width), dtype=self.kind)
        for f in range(self.fields):
            self.words = self.words + grid[f * width:(f + 1) * width].T * (1 << (self.bits * f))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors, candidates): one multiplication of a wide integer per anchor component."""
        a = anchors.astype(self.kind)
        biased = a - self.anchor_bias
        total = biased @ self.words
        mask = (1 << self.bits) - 1
        products = np.concatenate([(total >> (self.bits * f)) & mask for f in range(self.fields)], axis=1)[:, :self.n]
        # sum a*c = sum a'c' + bias_c sum a' + bias_a sum c
        return products + self.bias * biased.sum(axis=1)[:, None] + self.anchor_bias * self.sums[None, :]


def first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` greatest allowed scores; of ties, the leftmost columns."""
    rows, cols = np.nonzero(allowed)
    if not len(rows):
        return rows, cols
    value = scores[rows, cols]
    if len(rows) > 4 * k * len(scores) and scores.dtype != object:
        # only what reaches the row's k-th score can be among the first k
        low = np.iinfo(np.int64).min
        kth = np.partition(np.where(allowed, scores, low), scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), low)
        keep = value >= kth[rows]
        rows, cols, value = rows[keep], cols[keep], value[keep]
    order = np.lexsort((-value, rows)) if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -value[i])))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, vec) that take part, one per id: the least (label, vector) of those that share it."""
    vec = F.transform(F.col(vec_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    bad = F.exists(F.col("vec"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
    found = found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~bad)
    least = found.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v"))
    return least.select("id", "v.label", "v.vec")


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors as rows of ``d`` scaled, floored components; a shorter one ends in zeros."""
    out = np.zeros((len(column), d))
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = np.floor(flat)
    return whole_numbers(out)


def _sides(anchors: pa.Table, candidates: pa.Table):
    """The two sides of a task as (ids, labels, matrix), candidates by id so that ties fall to the smaller."""
    candidates = candidates.sort_by("id")
    d = max((max(t.column("vec").combine_chunks().value_lengths().to_pylist(), default=0) for t in (anchors, candidates)), default=0)
    return [(t.column("id").to_numpy(), np.array(t.column("label").to_pylist(), dtype=object), _matrix(t.column("vec"), d)) for t in (anchors, candidates)]


def _codes(*labels: np.ndarray) -> list[np.ndarray]:
    """Small numbers in place of labels, equal where these are."""
    code = {x: i for i, x in enumerate(dict.fromkeys(v for side in labels for v in side))}
    return [np.array([code[v] for v in side], dtype=np.int64) for side in labels]


def _long(values) -> pa.Array:
    top = 2**63 - 1
    return pa.array([max(-top - 1, min(top, int(v))) for v in values] if getattr(values, "dtype", None) == object else values, pa.int64())


def _pairs(anchors: DataFrame, rows: DataFrame, same_label: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key (stripe, crew) of every task that they take part in."""
    crews = anchors.select("crew", "label").distinct()
    if same_label:
        shared = rows.select("stripe", "label").distinct().join(crews, "label").select("stripe", "crew").distinct()
    else:
        # a stripe with one label only has nothing for a crew of that label alone
        held = rows.groupBy("stripe").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        own = anchors.groupBy("crew").agg(F.min("label").alias("alo"), F.max("label").alias("ahi"))
        n = anchors.agg(F.max("crew")).first()[0]
        grid = held.withColumn("crew", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n if n is not None else 0).cast("long")))).join(own, "crew")
        shared = grid.where(~((F.col("lo") == F.col("hi")) & (F.col("alo") == F.col("ahi")) & (F.col("lo") == F.col("alo")))).select("stripe", "crew")
    shared = staged(shared, "task-keys")
    return anchors.join(shared, "crew"), rows.join(shared, "stripe")


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Rows (anchor, positives) with each anchor's first ``k`` (score, id) of its own label, best first."""
    a, c = _pairs(anchors, rows, True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (a_id, a_label, a_vec), (c_id, c_label, c_vec) = _sides(left, right)
            a_label, c_label = _codes(a_label, c_label)
            packed = Packed(c_vec, a_vec)
            for lo in range(0, len(a_id), ROWS):
                s = packed.scores(a_vec[lo:lo + ROWS])
                mine = a_id[lo:lo + ROWS]
                r, j = first_k(s, (a_label[lo:lo + ROWS, None] == c_label[None, :]) & (mine[:, None] != c_id[None, :]), k)
                for held, new in zip(out, (mine[r], c_id[j], s[r, j]), strict=True):
                    held.append(new)
        return _table(out, ["anchor", "id", "score"])

    found = a.groupBy("stripe", "crew").cogroup(c.groupBy("stripe", "crew")).applyInArrow(run, "anchor long, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))


def _table(columns: list[list], names: list[str]) -> pa.Table:
    return pa.table([_long(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in columns], names=names)


def mine(rows: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", stripe: int = STRIPE, crew: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. Scores are inner products of the components
    floor(scale * x), exact, found by ``Packed``. An anchor's positives are its ``k_positive``
    best other rows of its label; for each, the ``k_negative`` best rows of another label with
    low * positive <= 100 * negative <= high * positive are returned; ties go to the smaller id.

    Anchors against all rows, in blocks: rows, sorted by label, are cut into stripes and anchors
    into crews of fixed size; a task meets one stripe with one crew, keeps the best of its
    stripe, and the few best of all stripes meet per anchor. No label or id is a partition
    key, so a hot label is many stripes.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part; of
    rows that share an id, the least (label, vector) counts; a vector shorter than another counts
    as ending in zeros; an anchor without positives, and a positive without negatives, gives no
    rows; scores beyond 64 bits are compared exactly within a task and returned as the nearest
    long; other columns are ignored; an empty table gives no rows.
    """
    valid = staged(vectors(rows, scale, id_col, vec_col, label_col), "vectors")
    held = ranked(valid.withColumn("all", F.lit(0)), ["all"], ["label", "id"], "vector-order")
    placed = staged(held.select("id", "label", "vec", F.floor(F.col("pos") / stripe).alias("stripe")), "stripes")
    asked = ranked(placed.where(is_anchor).select("id", "label", "vec", F.lit(0).alias("all")), ["all"], ["label", "id"], "anchor-order")
    anchors = staged(asked.select("id", "label", "vec", F.floor(F.col("pos") / crew).alias("crew")), "crews")
    for used in (valid, held, asked):
        discard(used)
    best = staged(positives(anchors, placed, k_positive), "positives")
    asking = anchors.join(best.withColumnRenamed("anchor", "id"), "id")
    a, c = _pairs(asking, placed, False)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            (a_id, a_label, a_vec), (c_id, c_label, c_vec) = _sides(left, right)
            a_label, c_label = _codes(a_label, c_label)
            asked = left.column("positives").to_pylist()
            packed = Packed(c_vec, a_vec)
            for lo in range(0, len(a_id), ROWS):
                s = packed.scores(a_vec[lo:lo + ROWS])
                mine, wanted = a_id[lo:lo + ROWS], asked[lo:lo + ROWS]
                other = a_label[lo:lo + ROWS, None] != c_label[None, :]
                for p in range(k_positive):
                    has = np.array([len(w) > p for w in wanted])
                    if not has.any():
                        break
                    score = np.array([w[p]["score"] if len(w) > p else 0 for w in wanted], dtype=packed.kind)
                    least = np.array([-((-low * int(x)) // 100) for x in score], dtype=packed.kind)  # ceil(low x / 100)
                    most = np.array([high * int(x) // 100 for x in score], dtype=packed.kind)
                    ok = other & has[:, None] & (s >= least[:, None]) & (s <= most[:, None])
                    r, j = first_k(s, ok.astype(bool), k_negative)
                    for held, new in zip(out, (mine[r], np.full(len(r), p, dtype=np.int64), c_id[j], s[r, j]), strict=True):
                        held.append(new)
        return _table(out, ["anchor", "nth", "id", "score"])

    found = a.groupBy("stripe", "crew").cogroup(c.groupBy("stripe", "crew")).applyInArrow(run, "anchor long, nth long, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
    top = found.withColumn("rank", place).where(F.col("rank") <= k_negative)
    positive = F.element_at("positives", (F.col("nth") + 1).cast("int"))
    return top.join(best, "anchor").select(F.col("anchor").alias("anchor_id"), positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                           F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE_SQL = r"""
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
