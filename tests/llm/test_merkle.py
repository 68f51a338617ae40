"""op11: the manifest against a plain tree, its versions against whole rebuilt trees."""
import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.llm import merkle

from .helpers import prose

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = ["tree", "id", "leaf", "forged", "n", "pos", "block", "items", "path", "own", "l0", "top", "_at", "_tie", "root", "all"]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text) -> str:
    i, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(digests):
    """All levels of a tree over a list of digests."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out += level[lo:i] + level[i + 1:lo + 8]
        i //= 8
    return out


def plain(rows):
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    langs = sorted({key(r) for r in rows})
    members = {k: sorted((r for r in rows if key(r) == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for k in langs}
    trees = {k: climb([leaf(r, r[1]) for r in members[k]]) for k in langs}
    over = climb([trees[k][-1][0] for k in langs])
    root = over[-1][0] if langs else None
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(members[k]):
            proof = sha("".join(siblings(trees[k], i) + siblings(over, j)))
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            changed = leaf(r, lower(r[1])) if hit else trees[k][0][i]
            new_sub = climb([*trees[k][0][:i], changed, *trees[k][0][i + 1:]])[-1][0]
            folded = climb([*over[0][:j], new_sub, *over[0][j + 1:]])[-1][0]
            out.append((r[0], trees[k][0][i], trees[k][-1][0], root, proof, folded))
    return out


def audited(spark, rows, parts=5):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(parts)
    return merkle.audit(df)


def digest_rows(found):
    return [tuple(r) for r in found.select("id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root").collect()]


def test_audit_matches_a_plain_tree(spark, edge_rows):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", None, "", "Ωmega"]), rng.choice(["a", None]), len(t) if t else None) for i, t in edge_rows]
    rows += [(100 + k, f"Text {k % 9}" if k % 5 else prose(k, 4).title(), "en" if k % 4 else "de", "web", k) for k in range(700)]
    rows += [(2000, "Alone", "lone", "web", 5)] + [(None, "Same Row", "de", None, 1)] * 9
    got = digest_rows(audited(spark, rows))
    assert Counter(got) == Counter(plain(rows))
    assert any(r[3] != r[5] for r in got) and any(r[3] == r[5] for r in got)


def test_many_tiers_and_many_trees(spark):
    deep = [(k, f"T{k}", "en", "s", k) for k in range(4700)]         # ten blocks in two tiers
    wide = [(10_000 + k, f"T{k}", f"lang{k:04d}", "s", k) for k in range(1200)]
    rows = deep + wide
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = {r["id"]: r for r in merkle.audit(df).collect()}
    key = lambda r: r[2].encode()
    langs = sorted({key(r) for r in rows})
    trees = {k: climb([leaf(r, r[1]) for r in sorted((r for r in rows if key(r) == k), key=lambda r: r[0])]) for k in langs}
    over = climb([trees[k][-1][0] for k in langs])
    for r in random.Random(2).sample(rows, 300):
        j = langs.index(key(r))
        i = r[0] if r[2] == "en" else 0
        sib = siblings(trees[key(r)], i) + siblings(over, j)
        mine = got[r[0]]
        assert (mine["subroot"], mine["root"], mine["siblings"]) == (trees[key(r)][-1][0], over[-1][0], "".join(sib))
        assert mine["copied"][-1] == mine["folded_root"] and len(mine["copied"]) == len(trees[key(r)]) + len(over) - 1
    assert len(got) == len(rows)


def test_versions_share_all_other_nodes(spark):
    """A version's copies, put into the built tree's nodes, are the tree over the changed leaf."""
    rows = [(k, f"Text {k}", "en" if k % 3 else "fr", "s", k) for k in range(1300)]
    df = spark.createDataFrame(rows, DOCS)
    found = merkle.leaves(df, merkle.tampered(), {"text": merkle.lower_ascii(F.col("text"))})
    manifest = merkle.build(found)
    built = {(r["tree"], r["tier"] * 3 + r["level"], r["pos"]): r["digest"] for r in merkle.nodes(manifest).collect()}
    forged = [r for r in merkle.versions(manifest).collect() if r["forged"]]
    assert len(forged) > 300
    for r in forged[::40]:
        at, version, copies = r["pos"], dict(built), list(r["copied"])
        height = max(lv for t, lv, _ in built if t == r["tree"])
        for lv in range(height + 1):
            version[r["tree"], lv, at // 8 ** lv] = copies.pop(0)
        j = sorted({t for t, _, _ in built if t is not None}).index(r["tree"])
        version[None, 0, j] = version[r["tree"], height, 0]
        for lv in range(1, 1 + max(lv for t, lv, _ in built if t is None)):
            version[None, lv, j // 8 ** lv] = copies.pop(0)
        assert not copies
        for (tree, lv, pos), d in version.items():
            below = [version[tree, lv - 1, p] for p in range(pos * 8, pos * 8 + 8) if (tree, lv - 1, p) in version]
            assert not below or d == sha("".join(below))
        assert sum(built[k] != d for k, d in version.items()) == len(set(r["copied"])) + 1  # the subroot is a node of both trees


def test_no_rows_and_one_row(spark):
    assert audited(spark, []).count() == 0
    one = [(3, "Ab", None, None, None)]
    assert digest_rows(audited(spark, one)) == plain(one)


def test_text_ids(spark):
    df = spark.createDataFrame([(f"k{i}", "T", "en", "s", 1) for i in range(20)], "doc_id string, text string, lang string, source string, n_chars long")
    rows = merkle.audit(df).collect()
    assert len({r["root"] for r in rows}) == 1 and all(r["folded_root"] == r["root"] for r in rows if not r["forged"])
