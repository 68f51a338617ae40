"""Fuzzy line dedup with built-in functions only: SimHash, pigeonhole blocks, edit similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import components, discard, release, staged
from coldlake.llm.simhash import block_masks, signed

DISTANCE = 3
SIMILARITY = 0.8
#: Fewer words can't be near others: one edit is over a fifth of them. Equal lines meet at any length.
MIN_WORDS = 4
#: Most line keys, of about 60 bytes each, that are broadcast to find the lines' texts, and most blocks to find their lines.
BROADCAST_KEYS = 500_000
#: Choices of agreeing blocks keyed at once: bounds the disk that keys take, not the result.
CHOICES_A_ROUND = 5
_WORDS_A_ROW = 15
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han letters.
_NO_SPACES = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: The lowest bit of each 16-bit lane, and a lane's bit 14.
_LANES, _TOP = 0x0001000100010001, 1 << 14
#: Different words of one print, a multiple of the words in a row that lanes count below bit 14.
_PART_WORDS = 8_160


def normalised(line: Column) -> Column:
    """Lower case, with every run of characters other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def words_of(norm: Column) -> Column:
    """Words of a normalised line; each character of a script without spaces is a word of its own."""
    spaced = F.split(F.trim(F.regexp_replace(norm, f"[{_NO_SPACES}]", " $0 ")), " +")
    return F.when(F.octet_length(norm) - F.char_length(norm) > 1, spaced).otherwise(F.split(norm, " "))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _counted(rows: DataFrame, keep: list[str], words: list[str]) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Counts bits over long columns by full adders: (weight, column) planes of the binary counts.

    Three columns of one weight become their sum, of the same weight, and carry, of the next.
    """
    planes, made = {0: words}, 0
    while any(len(v) > 2 for v in planes.values()):
        after, new = {w: list(v) for w, v in planes.items()}, []
        for w in sorted(planes):
            if len(after[w]) > 2:
                x, y, z = after[w][:3]
                half = F.col(x).bitwiseXOR(F.col(y))
                carry = F.col(x).bitwiseAND(F.col(y)).bitwiseOR(F.col(z).bitwiseAND(half))
                new += [half.bitwiseXOR(F.col(z)).alias(f"sum{made}"), carry.alias(f"carry{made}")]
                after[w] = [*after[w][3:], f"sum{made}"]
                after.setdefault(w + 1, []).append(f"carry{made}")
                made += 1
        old = {x for v in planes.values() for x in v}
        rows = rows.select(*keep, *[x for v in after.values() for x in v if x in old], *new)
        planes = after
    return rows, [(w, x) for w, v in planes.items() for x in v]


def line_prints(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t, line_no, h1, h2, n, part, fp) for every line with a letter or digit.

    (h1, h2) is a 128-bit hash of the normalised line and n its words; fp is null for lines of
    under ``min_words`` words, which have no near lines. A fingerprint bit is set
    when over half the hashes of the line's different words have it, so that frequent words
    don't decide it. Words are taken fifteen to a row and their bits counted into four planes; a
    sum over 16 longs, four 16-bit lanes each, then counts all 64 bits and combines before the
    shuffle, so a line stays one row. A line of more different words than a lane counts gives a
    row for each _PART_WORDS of them.
    """
    line = ["doc_id", "t", "line_no", "h1", "h2"]
    # The key is taken before the split and lines are chosen as written: else every line would carry
    # and hash its whole text, and be normalised once for the filter and once for its value.
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("t"), F.col(text_col).alias("body"))
    lines = texts.select("doc_id", "t", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    norm = lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "t", "line_no", normalised(F.col("line")).alias("norm"))
    split = norm.select("doc_id", "t", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), F.col("norm")).alias("h2"), words_of(F.col("norm")).alias("words"))
    known = split.select(*line, F.size("words").alias("n"), F.array_distinct("words").alias("words"))
    known = known.select(*line, "n", F.size("words").alias("kinds"), "words")
    taken = known.select(*line, "n", "kinds", "words", F.explode(F.sequence(F.lit(0), F.col("kinds") - 1, F.lit(_WORDS_A_ROW))).alias("i"))
    words = [f"w{j}" for j in range(_WORDS_A_ROW)]
    hashed = taken.select(*line, "n", (F.col("i") / _PART_WORDS).cast("int").alias("part"), F.least(F.col("kinds") - F.col("i"), F.lit(_WORDS_A_ROW)).alias("here"),
                          *[F.when(F.col("i") + j < F.col("kinds"), F.xxhash64(F.get("words", F.col("i") + j))).otherwise(F.lit(0).cast("long")).alias(w) for j, w in enumerate(words)])
    counted, planes = _counted(hashed, [*line, "n", "part", "here"], words)

    def lane(k):
        return F.sum(reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LANES)), w) for w, x in planes]))
    summed = counted.groupBy(*line, "n", "part").agg(F.sum("here").alias("kinds"), *[lane(k).alias(f"s{k}") for k in range(16)])
    # Every lane plus (bit 14 - majority) has bit 14 set exactly when its count is a majority.
    lift = (F.lit(_TOP - 1) - F.shiftright("kinds", 1)) * F.lit(_LANES)
    bits = [F.shiftleft(F.shiftrightunsigned((F.col(f"s{k}") + F.col("lift")).bitwiseAND(F.lit(_TOP * _LANES)), 14), k) for k in range(16)]
    return summed.withColumn("lift", lift).select(*line, "n", "part", F.when(F.col("n") >= min_words, reduce(Column.bitwiseOR, bits)).alias("fp"))


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks whose keys give under one chance meeting a fingerprint; results don't depend on it."""
    blocks = distance + 2
    while blocks < 16 and len(block_masks(blocks, distance)) * n > 2 ** (64 * (blocks - distance) / blocks):
        blocks += 1
    return blocks


def _members(prints: DataFrame, masks: list[int], first: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """Staged near pairs (x, y) of blocks of two, and staged rows (block, x, fp, n, y) of larger blocks; y is the block's least node.

    ``block`` is a hash of the choice, counted from ``first``, and the bits it keeps; blocks that
    meet by a hash collision only give more pairs to verify. Most shared blocks are two lines that
    meet by chance: the xor of their prints tells them apart while blocks are counted, so only
    larger blocks are joined to their lines. The shuffle files of these choices go before the next
    ones are keyed.
    """
    blocks = F.array(*[F.xxhash64(F.lit(first + i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    keyed = prints.select("x", "fp", "n", F.explode(blocks).alias("block"))
    met = keyed.groupBy("block").agg(F.count("*").alias("size"), F.min("x").alias("y"), F.max("x").alias("x"), F.bit_xor("fp").alias("bits"))
    # y = x: the parts of one very long line
    met = staged(met.where((F.col("y") < F.col("x")) & ((F.col("size") > 2) | (F.bit_count("bits") <= distance))), "blocks")
    pairs = staged(met.where("size = 2").select("x", "y").distinct(), "pairs")
    large = staged(met.where("size > 2").select("block", "y"), "large")
    few = large.count() <= BROADCAST_KEYS  # else the keys are shuffled to their blocks
    out = staged(keyed.join(F.broadcast(large) if few else large, "block").select("block", "x", "fp", "n", "y"), "members")
    discard(met)
    discard(large)
    release(prints.sparkSession)
    return pairs, out


def codes(norm: Column) -> Column:
    """A line as a string with one character a word, so that edit distance counts words."""
    return F.decode(F.unhex(F.array_join(F.transform(words_of(norm), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xB000)) + 0x1000), 4, "0")), "")), "UTF-16BE")


def _allowed(n1, n2, similarity: float) -> Column:
    """Most word edits between lines of n1 and n2 words."""
    return F.floor(F.greatest(n1, n2) * F.lit(1 - similarity) + 1e-9).cast("int")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Staged rows (x, y) of ``pairs`` whose lines are alike enough; texts come from first occurrences."""
    pairs = staged(pairs.distinct(), "pairs")
    wanted = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).distinct()
    at = staged(nodes.join(wanted, "x").select("x", F.col("first.doc_id").alias("id"), F.col("first.t").alias("key"), F.col("first.line_no").alias("no")), "wanted")
    few = at.count() <= BROADCAST_KEYS  # else the texts are shuffled to the keys

    def small(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if few else keys
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("t"), F.col(text_col).alias("body")).join(
        small(at.select("id", "key").distinct()), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("key")), "left_semi")
    lines = texts.select("doc_id", "t", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).join(
        small(at), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("key")) & (F.col("line_no") == F.col("no")))
    coded = staged(lines.select("x", codes(normalised(F.col("line"))).alias("code")).dropDuplicates(["x"]), "codes")
    both = pairs.join(coded.withColumnRenamed("code", "cx"), "x").join(coded.select(F.col("x").alias("y"), F.col("code").alias("cy")), "y")
    both = both.withColumn("allowed", _allowed(F.char_length("cx"), F.char_length("cy"), similarity))
    out = staged(both.where("levenshtein(cx, cy, allowed) >= 0").select("x", "y"), "links")
    for old in (pairs, at, coded):
        discard(old)
    return out


def line_groups(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t, line_no, removed) for every line that has an equal or a near one.

    Equal normalised lines of any length are one node, so a line that a third of the documents
    repeat costs one row from there on. Nodes of at least ``min_words`` words meet on pigeonhole
    blocks of their SimHash, a very long line with the prints of all its parts; a pair within ``distance`` bits is a link if its edit similarity in
    words, 1 - edits / longer line, is at least ``similarity``. First every node is tried with the least node of each of its blocks, which settles blocks of two;
    then only nodes of one larger block that are still in different groups are tried with each other.
    A crowd of near copies is so joined in proportion to its size, and as links inside a group
    cannot change it, the groups are those of all links. Of each group the least occurrence by
    (doc_id, text hash, line number) stays and ``removed`` marks the others.
    """
    seen = staged(line_prints(docs, min_words, id_col, text_col), "lines")
    release(docs.sparkSession)
    nodes = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t", "line_no")).alias("first"),
                                          F.min(F.when(F.col("part") == 0, F.col("fp"))).alias("fp"), F.min("n").alias("n"), F.count(F.when(F.col("part") == 0, 1)).alias("rows"))
    nodes = staged(nodes.withColumn("x", F.monotonically_increasing_id()), "nodes")
    prints = nodes.where("fp is not null").select("x", "fp", "n")
    later = seen.where("part > 0").select("h1", "h2", "fp").distinct()
    if not later.isEmpty():
        prints = staged(prints.unionByName(later.join(nodes.select("x", "h1", "h2", "n"), ["h1", "h2"]).select("x", "fp", "n")), "prints")
    masks = block_masks(blocks_for(prints.count(), distance), distance)
    release(docs.sparkSession)
    twos, rounds = zip(*[_members(prints, masks[i:i + CHOICES_A_ROUND], i, distance) for i in range(0, len(masks), CHOICES_A_ROUND)], strict=True)
    members = reduce(DataFrame.unionByName, rounds)

    def near(fp1, n1, fp2, n2):
        return (F.bit_count(F.col(fp1).bitwiseXOR(F.col(fp2))) <= distance) & (F.abs(F.col(n1) - F.col(n2)) <= _allowed(F.col(n1), F.col(n2), similarity))
    lead = prints.select(F.col("x").alias("y"), F.col("fp").alias("fy"), F.col("n").alias("ny"))
    tried = members.where("x <> y").select("x", "fp", "n", "y").distinct().join(lead, "y").where(near("fp", "n", "fy", "ny")).select("x", "y")
    links = _verified(docs, nodes, reduce(DataFrame.unionByName, twos, tried), similarity, id_col, text_col)
    groups = early = staged(components(links, "x", "y").withColumnRenamed("node", "x"), "groups")
    labelled = members.select("block", "x", "fp", "n").join(groups, "x", "left").withColumn("label", F.coalesce("component", "x")).drop("component")
    labelled = staged(labelled, "labelled")
    for old in (*twos, *rounds):
        discard(old)
    split = staged(labelled.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("block"), "split")
    left = labelled.join(split, "block", "left_semi")
    a, b = left.alias("a"), left.alias("b")
    rest = (a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.label") < F.col("b.label"))
                   & near("a.fp", "a.n", "b.fp", "b.n")).select(F.col("a.x").alias("x"), F.col("b.x").alias("y")))
    more = _verified(docs, nodes, rest, similarity, id_col, text_col)
    # the groups found so far are stars to their least node: only new links need more rounds
    stars = groups.where("x <> component").select("x", F.col("component").alias("y"))
    groups = components(stars.unionByName(more), "x", "y").withColumnRenamed("node", "x")
    grouped = nodes.select("x", "h1", "h2", "first", "rows").join(groups, "x", "left").where((F.col("rows") > 1) | F.col("component").isNotNull())
    grouped = staged(grouped.select("h1", "h2", "first", F.coalesce("component", "x").alias("label")), "grouped")
    least = grouped.groupBy("label").agg(F.min("first").alias("keep"))
    keep = staged(grouped.join(least, "label").select("h1", "h2", "keep"), "keep")
    for old in (nodes, prints, early, links, labelled, split, more, grouped):
        discard(old)
    return seen.where("part = 0").join(keep, ["h1", "h2"]).select("doc_id", "t", "line_no", (F.struct("doc_id", "t", "line_no") != F.col("keep")).alias("removed"))


def removals(docs: DataFrame, **kw) -> DataFrame:
    """Rows (doc_id, t, gone array<int>): the sorted numbers of a document's removed lines."""
    return line_groups(docs, **kw).where("removed").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The input rows and columns, with repeated and near-repeated lines cut from the text.

    Documents that lose all lines stay with an empty text. Null texts stay null; lines
    without a letter or digit stay; rows that repeat id and text count as one document and are treated alike; null
    ids work, told apart by their text; other columns pass through whatever their names; an
    empty table stays empty.
    """
    gone = staged(removals(docs, id_col=id_col, text_col=text_col, **kw), "gone")
    kept = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("t"))
    joined = kept.join(gone, kept["id"].eqNullSafe(gone["doc_id"]) & (kept["t"] == gone["t"]), "left").select("row", "gone")
    body = F.col(f"row.`{text_col}`")
    lines = F.split(body, "\n")
    before = F.transform("gone", lambda x, i: F.concat(
        F.array_repeat(F.lit(True), x - F.when(i == 0, -1).otherwise(F.element_at("gone", F.when(i == 0, 1).otherwise(i))) - 1), F.array(F.lit(False))))
    flags = F.concat(F.flatten(before), F.array_repeat(F.lit(True), F.size(lines) - F.element_at("gone", -1) - 1))
    cut = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(
        F.transform(F.filter(F.arrays_zip(lines.alias("l"), flags.alias("k")), lambda z: z["k"]), lambda z: z["l"]), "\n"))
    rebuilt = joined.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return rebuilt
