"""Merkle manifest of a dataset: a persistent tree whose changed leaves copy only their paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import discard, ranked, staged

#: Children of a node, and the levels of one aligned block: 8 ** 3 = 512 nodes are handled in a row.
FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN ** BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def lower_ascii(c: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(columns: list[Column]) -> Column:
    """Digest of a row: each value with its byte length, '-' for null."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def tampered(id_col: str = "doc_id") -> Column:
    """The rows whose text is changed: 3 divides the checksum of the id (never for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))


@dataclass
class Manifest:
    """A built tree. ``levels[r]`` holds a row per aligned block of the r-th tier: (tree, n, block, items, l0..l3, top)
    with the digests of its levels (null above a tree's root); ``top`` is the same over the subroots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def leaves(docs: DataFrame, where: Column, change: dict[str, Column], columns=COLUMNS, tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Rows (tree, id, leaf, forged), staged: digests only, so that no text is shuffled.

    ``forged`` is the digest of the row with ``change`` where ``where`` holds, else null. ``tree``
    orders as the tree column does, null first.
    """
    new = digest([change.get(c, F.col(c)) for c in columns])
    return staged(docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("id"),
                              digest([F.col(c) for c in columns]).alias("leaf"), F.when(where, new).alias("forged")), "leaves")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of nodes (tree, n, pos, leaf, ...) with the digests of up to three levels above them."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))
    out = grouped.withColumn("l0", F.col("items.leaf"))
    for k in range(1, BLOCK_LEVELS + 1):
        below = F.col(f"l{k - 1}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        up = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FAN + 1, F.lit(FAN)), ""), 256))
        # a level is there while its tree has more than one node below it
        out = out.withColumn(f"l{k}", F.when(F.col("n") > FAN ** (k - 1), up))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(BLOCK_LEVELS, -1, -1)])
    return out.withColumn("top", F.element_at(top, 1))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, then of the blocks' tops, until every tree has one block."""
    tiers = []
    while True:
        tiers.append(staged(_blocks(nodes), "blocks"))
        more = tiers[-1].where(F.col("n") > BLOCK)
        if more.isEmpty():
            return tiers
        nodes = more.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("top").alias("leaf"))


def build(leaf_rows: DataFrame) -> Manifest:
    """The tree over ``leaves()``: one subtree per tree value, ordered by id, and a root over their subroots."""
    placed = ranked(leaf_rows, ["tree"], ["id", "leaf"], "leaf-order")
    sizes = leaf_rows.groupBy("tree").agg(F.count("*").alias("n"))
    levels = _tiers(placed.join(sizes, "tree"))
    discard(placed)
    done = None
    for tier in levels:
        own = tier.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("leaf"))
        done = own if done is None else done.unionByName(own)
    subroots = ranked(done.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), ["tree"], ["name"], "subroots")
    top = _tiers(subroots.withColumn("n", F.lit(subroots.count())))
    discard(subroots)
    last = top[-1].where(F.col("n") <= BLOCK).first()
    return Manifest(levels, top, last["top"] if last else None)


def _own_path(at: Column) -> Column:
    """(before, after) siblings of node ``at`` of a block, level by level to the block's top."""
    steps = []
    for k in range(BLOCK_LEVELS):
        i = F.floor(at / FAN ** k).cast("int")
        first = i - i % FAN
        here = F.col(f"l{k}")
        step = F.struct(F.array_join(F.slice(here, first + 1, i % FAN), "").alias("before"),
                        F.array_join(F.slice(here, i + 2, F.lit(FAN - 1) - i % FAN), "").alias("after"))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _paths(tiers: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """The lowest tier's blocks with ``path``: the siblings from the block's top up to the root.

    ``above`` has (tree, path, carry) per tree; each tier hands its nodes' paths to the blocks below.
    """
    down = None
    for r in range(len(tiers) - 1, -1, -1):
        tier = tiers[r]
        mine = tier.where(F.col("n") <= BLOCK).join(above, "tree")
        if down is not None:
            mine = mine.unionByName(tier.where(F.col("n") > BLOCK).join(down, ["tree", "block"]))
        if r == 0:
            return mine
        nodes = F.inline(F.transform("items", lambda x: F.struct(x["pos"].alias("block"), F.concat(_own_path(x["pos"] % BLOCK), F.col("path")).alias("up"))))
        down = staged(mine.select("tree", "path", *carry, *[f"l{k}" for k in range(BLOCK_LEVELS + 1)], "items").select("tree", *carry, nodes)
                      .withColumnRenamed("up", "path"), "paths")


def _copied(path: Column, start: Column) -> Column:
    """The digests that replace a path's nodes when its lowest one becomes ``start``: one per level, start first."""
    return F.aggregate(path, F.array(start), lambda acc, s: F.concat(acc, F.array(F.sha2(F.concat(s["before"], F.element_at(acc, -1), s["after"]), 256))))


def versions(manifest: Manifest) -> DataFrame:
    """Rows (id, tree, pos, leaf, forged, subroot, root, siblings, copied, folded_root), one per leaf.

    A forged leaf makes a version of the tree of its own: ``copied`` holds the only nodes that
    differ from the built tree, the leaf first and the version's root last, and every other node
    is shared. Ancestors inside the leaf's aligned block are copied from the block alone; the
    upper ones continue over the path that the block has got from the tiers above it, however
    many these are. ``siblings`` are the path's other nodes, left to right and upwards. A leaf
    that isn't forged folds its own digest, which gives the built root again.
    """
    empty = F.array().cast("array<struct<before:string,after:string>>")
    start = manifest.top[0].sparkSession.range(1).select(F.lit("").alias("tree"), empty.alias("path"))
    tops = _paths(manifest.top, start, [])
    # the top tree's nodes are the subroots: their paths belong to the trees that they name
    named = F.inline(F.transform("items", lambda x: F.struct(x["name"].alias("tree"), x["leaf"].alias("subroot"), F.concat(_own_path(x["pos"] % BLOCK), F.col("path")).alias("up"))))
    above = staged(tops.select(named).withColumnRenamed("up", "path"), "subroot-paths")
    blocks = _paths(manifest.levels, above, ["subroot"])
    each = F.inline(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["pos"].alias("pos"), x["leaf"].alias("leaf"), x["forged"].alias("forged"), _own_path(x["pos"] % BLOCK).alias("own"))))
    rows = blocks.select("tree", "subroot", "path", each)
    inside = rows.withColumn("copied_inside", _copied(F.col("own"), F.coalesce("forged", "leaf")))
    whole = inside.withColumn("copied_above", _copied(F.col("path"), F.element_at("copied_inside", -1)))
    siblings = F.array_join(F.transform(F.concat("own", "path"), lambda s: F.concat(s["before"], s["after"])), "")
    return whole.select("id", "tree", "pos", "leaf", "forged", "subroot", F.lit(manifest.root).alias("root"), siblings.alias("siblings"),
                        F.concat("copied_inside", F.slice("copied_above", F.lit(2), F.greatest(F.size("copied_above") - 1, F.lit(0)))).alias("copied"),
                        F.element_at("copied_above", -1).alias("folded_root"))


def nodes(manifest: Manifest) -> DataFrame:
    """Rows (tree, tier, level, pos, digest): the built tree's nodes; the tree over the subroots is ``tree`` null.

    ``level`` counts from the tier's own nodes, so (tier r, level 3) is (tier r + 1, level 0) and is listed there.
    """
    out = None
    for name, tiers in ((F.col("tree"), manifest.levels), (F.lit(None).cast("string"), manifest.top)):
        for r, tier in enumerate(tiers):
            for k in range(BLOCK_LEVELS + 1):
                at = F.posexplode(F.col(f"l{k}")).alias("i", "digest")
                seen = tier if k < BLOCK_LEVELS else tier.where(F.col("n") <= BLOCK)
                one = seen.select(name.alias("tree"), "block", at).select(
                    "tree", F.lit(r).alias("tier"), F.lit(k).alias("level"), (F.col("block") * (BLOCK // FAN ** k) + F.col("i")).alias("pos"), "digest")
                out = one if out is None else out.unionByName(one)
    return out


def audit(docs: DataFrame, where: Column | None = None, change: dict[str, Column] | None = None, columns=COLUMNS,
          tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``versions()`` of a table against its own manifest: by default texts whose A-Z were lower-cased.

    One row per input row. Trees are the values of ``tree_col``, null first; leaves ascend by id,
    null first, and by digest where ids tie, so repeated rows are leaves of their own with equal
    digests; null values hash as '-', empty texts as '0:', texts of any length whole; columns
    that aren't named are ignored; an empty table gives no rows.
    """
    where = tampered(id_col) if where is None else where
    found = leaves(docs, where, {"text": lower_ascii(F.col("text"))} if change is None else change, columns, tree_col, id_col)
    manifest = build(found)
    discard(found)
    return versions(manifest)


ORACLE_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
src AS (SELECT doc_id, lang, source, n_chars, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p::BIGINT, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, tab),
told AS (SELECT doc_id, lang, coalesce(hit, false) AS hit, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM src),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged FROM told),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, pos // 8),
subs AS MATERIALIZED (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, level AS height FROM up WHERE n = 1),
over AS (SELECT 0 AS level, pos, n, digest FROM subs
  UNION ALL SELECT any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY pos // 8),
every AS MATERIALIZED (SELECT tree, level, pos, digest FROM up UNION ALL SELECT NULL, level, pos, digest FROM over WHERE level > 0 OR n > 1),
runs AS MATERIALIZED (SELECT tree, level, pos // 8 AS run, list(digest ORDER BY pos) AS d FROM every GROUP BY ALL),
walk AS (SELECT p.tree AS own, p.tree, p.pos AS leaf_pos, 0 AS level, p.pos, p.n, coalesce(p.forged, p.leaf) AS d, '' AS sib FROM placed p
  UNION ALL SELECT * FROM (
    SELECT w.own, w.tree, w.leaf_pos, w.level + 1, w.pos // 8, (w.n + 7) // 8,
      sha256(array_to_string(r.d[1:w.pos % 8], '') || w.d || array_to_string(r.d[w.pos % 8 + 2:], '')),
      w.sib || array_to_string(r.d[1:w.pos % 8], '') || array_to_string(r.d[w.pos % 8 + 2:], '')
    FROM walk w JOIN runs r ON r.tree IS NOT DISTINCT FROM w.tree AND r.level = w.level AND r.run = w.pos // 8 WHERE w.n > 1
    UNION ALL SELECT w.own, NULL, w.leaf_pos, 0, s.pos, s.n, w.d, w.sib FROM walk w JOIN subs s ON s.tree = w.tree WHERE w.n = 1)),
root AS (SELECT digest FROM over WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM root) AS root, sha256(w.sib) AS proof_sha256, w.d AS folded_root, w.d = (SELECT digest FROM root) AS verified
FROM walk w JOIN placed p ON p.tree = w.own AND p.pos = w.leaf_pos JOIN subs s ON s.tree = w.own WHERE w.tree IS NULL AND w.n = 1
"""
