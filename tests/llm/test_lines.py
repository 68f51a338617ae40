"""Fuzzy line dedup against a brute-force version."""
import itertools
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from coldlake.llm import lines

from .helpers import prose


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def print_of(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(words)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain(rows, distance=3, similarity=0.8, min_words=4):
    """doc -> kept texts, for distinct non-null ids: equal lines of any length meet, near ones of ``min_words`` words or more."""
    where = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if t is not None and norm(line):
                where[norm(line)].append((i, k))
    root = {x: x for x in where}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fps = {x: print_of(x.split()) for x in where}
    for x, y in itertools.combinations(where, 2):
        a, b = x.split(), y.split()
        if min(len(a), len(b)) >= min_words and (fps[x] ^ fps[y]).bit_count() <= distance and edits(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
            root[find(x)] = find(y)
    groups = defaultdict(list)
    for x, at in where.items():
        groups[find(x)] += at
    gone = {at for g in groups.values() for at in g if at != min(g)}
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def fuzzy_rows():
    rows, base = [], [prose(k, 40 + 10 * k) for k in range(6)]
    for k in range(60):
        words = base[k % 6].split()
        words[(k * 7) % len(words)] = f"other{k}"
        rows.append((100 + k, f"head {k}\n" + " ".join(words) + "\n" + base[(k + 1) % 6].upper() + "!\n" + prose(500 + k, 25)))
    rows += [(200, "For For For For For For For"), (201, "For For For For For For"), (202, "x " * 3000), (203, "a b\na b\nthe same four words\nthe, same FOUR words."), (204, None), (205, ""),
             (206, "\n\n"), (207, "Étions de réeux vi là\nétions DE réeux vi là")]
    return rows


def test_kept_lines_match_brute_force(spark, make_docs):
    rows = fuzzy_rows()
    got = lines.dedup_lines(make_docs(rows)).collect()
    want = plain(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert any(want[100 + k] != rows[k][1] for k in range(60)) and all(r["lang"] == "en" and r["t"] == "x" for r in got)


@pytest.mark.parametrize("n, distance", [(10, 3), (10**6, 3), (10**9, 3), (10**9, 2)])
def test_blocks_cover_every_close_pair(n, distance):
    blocks = lines.blocks_for(n, distance)
    masks = lines.block_masks(blocks, distance)
    for bits in itertools.combinations(range(0, 64, 3), distance):
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in masks)


def test_prints_of_long_lines(spark, make_docs):
    words, part = [f"w{k}" for k in range(20_000)], lines._PART_WORDS
    parts = {print_of(words[k:k + part]) for k in range(0, len(words), part)}
    rows = [(1, " ".join(words[:part])), (2, " ".join(words)), (3, " ".join(words + words)), (4, "a b c d e f g h i")] + [(10 + k, " ".join(words[:k])) for k in range(4, 34)]
    got = {}
    for r in lines.line_prints(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["fp"] % 2**64)
    assert got == {1: {print_of(words[:part])}, 2: parts, 3: parts, 4: {print_of("abcdefghi")}} | {10 + k: {print_of(words[:k])} for k in range(4, 34)}


def test_edge_rows_and_columns(spark, make_docs, edge_rows):
    df = make_docs(edge_rows)
    got = lines.dedup_lines(df)
    assert got.columns == df.columns and got.count() == len(edge_rows)
    texts = defaultdict(list)
    for r in got.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[1] == [None] and texts[2] == [""] and sorted(texts[4]) == ["Hello World again", "Hello World again", "the same id, other text"]
    assert texts[10] != texts[11] and "" in texts[10] + texts[11]  # copies: one keeps its line
    assert len(texts[12][0].split("\n")) == 2
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_no_python_in_the_plan(spark, make_docs):
    plan = lines.line_prints(make_docs(fuzzy_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.dedup_lines(make_docs(fuzzy_rows()).withColumn("h1", F.lit(1))).count() == len(fuzzy_rows())


def test_lines_three_bits_apart_are_linked(spark, make_docs):
    rows = []
    for seed in range(400):
        words = prose(seed, 30).split()
        other = [*words[:7], f"other{seed}", *words[8:]]
        if (print_of(words) ^ print_of(other)).bit_count() == 3:
            rows += [(2 * seed, " ".join(words)), (2 * seed + 1, " ".join(other))]
    want = plain(rows, distance=3)
    assert len(rows) > 20 and all(want[i] == "" for i, _ in rows[1::2])
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(make_docs(rows)).collect()} == want


def test_equal_lines_of_any_length_are_one(spark, make_docs):
    han = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(60))
    near = next(x for x in (han[:k] + chr(0x9000 + k) + han[k + 1:] for k in range(60)) if (print_of(list(x)) ^ print_of(list(han))).bit_count() <= 3)
    rows = [(1, "Contents\na b\nContents!"), (2, "CONTENTS\n---\n\n---\nb a"), (3, han), (4, han), (5, near), (6, "a b c\na b d"), (7, "de l'eau")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(make_docs(rows)).collect()}
    assert got == {1: "Contents\na b", 2: "---\n\n---\nb a", 3: han, 4: "", 5: "", 6: "a b c\na b d", 7: "de l'eau"}


def test_near_lines_of_several_parts_are_linked(spark, make_docs):
    words = [f"w{k}" for k in range(lines._PART_WORDS + 3)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-2], "other", "tail"])), (3, " ".join(words[:-3]))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(make_docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: ""}


def test_blocks_of_two_are_settled_without_a_join(spark):
    masks = lines.block_masks(5, 3)
    far, crowd = 0x0F0F0F0F0F0F0F0F, 0x123456789ABCDEF
    prints = spark.createDataFrame([(1, 5, 9), (2, 6, 9), (3, far, 9), (4, far ^ 0x7FFFF, 9), (7, -far, 9), (7, -far, 9)] + [(10 + k, crowd ^ (1 << k), 9) for k in range(4)], "x long, fp long, n int")
    pairs, large = lines._members(prints, masks, 0, 3)
    # 3 and 4 share a block by chance, 7 is two parts of one line
    assert {(r["x"], r["y"]) for r in pairs.collect()} == {(2, 1)}
    assert {(r["x"], r["y"]) for r in large.collect()} == {(10 + k, 10) for k in range(4)}


@pytest.mark.parametrize("keys", [0, 500_000])
def test_groups_do_not_depend_on_how_blocks_are_joined(spark, make_docs, monkeypatch, keys):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", keys)
    rows = fuzzy_rows()
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(make_docs(rows)).collect()} == plain(rows)
