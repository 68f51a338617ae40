"""Context-tree weighting against a recursive version on small texts."""
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coldlake.llm import ctw

from .helpers import prose


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def folded(text):
    return (text or "").encode().lower()


class PlainTree:
    """Counts in dictionaries, weights by recursion over the contexts that were seen."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, byte in self.steps(t):
                for node, bit in self.path(byte):
                    for d in range(depth + 1):
                        self.counts[context[depth - d:], node][bit] += 1
                        if d:
                            self.children[context[depth - d + 1:], node].add(context[depth - d:])
        self.memo = {}

    def steps(self, t):
        raw = b"\xff" * self.depth + t + b"\xff"
        return [(raw[i - self.depth:i], raw[i]) for i in range(self.depth, len(raw))]

    @staticmethod
    def path(byte):
        return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    def weighted(self, context, node):
        key = context, node
        if key not in self.memo:
            own = kt(*self.counts[key])
            if len(context) < self.depth:
                rest = sum(self.weighted(c, node) for c in self.children[key])
                top = max(own, rest)
                own_half = own + math.log(0.5)
                total = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(rest - top))
                self.memo[key] = total, math.exp(own_half - total)
            else:
                self.memo[key] = own, 1.0
        return self.memo[key][0]

    def one(self, context, node):
        p, left = 0.0, 1.0
        for d in range(self.depth + 1):
            key = context[self.depth - d:], node
            n0, n1 = self.counts.get(key, (0, 0))
            est = (n1 + 0.5) / (n0 + n1 + 1)
            self.weighted(*key)
            last = d == self.depth or not sum(self.counts.get((context[self.depth - d - 1:], node), (0, 0)))
            if last:
                return p + left * est
            share = self.memo[key][1]
            p, left = p + left * share * est, left * (1 - share)

    def score(self, t):
        return sum(math.log10(p if bit else 1 - p) for c, byte in self.steps(t) for node, bit in self.path(byte) for p in [self.one(c, node)])


def rows():
    return [(k, prose(k % 5, 25, 60) + " End" * (k % 3)) for k in range(24)] + [(50, None), (51, ""), (52, "Ünïcode \U0001f600 \x00 x"), (None, "an orphan"), (3, prose(3, 25, 60)), (53, " \n ")]


def is_train(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2


@pytest.mark.parametrize("depth, broadcast_rows, head", [(3, 10**6, 1 << 18), (2, 0, 5)])
def test_scores_match_the_recursive_tree(spark, make_docs, depth, broadcast_rows, head):
    data = rows()
    tree = PlainTree([folded(t) for i, t in data if is_train(i)], depth)
    got = ctw.score(make_docs(data), depth=depth, broadcast_rows=broadcast_rows, head_words=head).collect()
    train = [w for i, t in data if is_train(i) for w in [*folded(t).split(), None]]
    c, n, v = Counter(train), len(train), len(set(train))
    want = Counter()
    for i, t in data:
        ws = [*folded(t).split(), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        want[i, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), round(tree.score(folded(t)), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_next_byte_probabilities_sum_to_one(spark, make_docs):
    data = rows()
    src = ctw._sources(make_docs(data), "doc_id", "text", F.lit(True))
    some = spark.range(256).select(((F.lit(int.from_bytes(b"th", "big")) * 256) + F.col("id")).alias("gram"), F.lit(0).cast("long").alias("n"))
    counts = ctw.gram_counts(src, 2).unionByName(some).groupBy("gram").agg(F.sum("n").alias("n"))
    total = ctw.fit(counts, 2).where(F.shiftright("gram", 8) == int.from_bytes(b"th", "big")).agg(F.sum(F.pow(F.lit(10.0), "score"))).first()[0]
    assert abs(total - 1) < 1e-9


def test_without_training_rows_or_documents(spark, make_docs):
    got = ctw.score(make_docs([(1, "ab")]), train=F.lit(False)).first()
    assert got["n_known"] == 0 and got["train_tokens"] == 0 and abs(got["score"] - 24 * math.log10(0.5)) < 1e-9
    assert ctw.score(make_docs([])).count() == 0


def test_depth_beyond_five_is_refused(spark, make_docs):
    with pytest.raises(ValueError):
        ctw.score(make_docs([(1, "abc")]), depth=6)
