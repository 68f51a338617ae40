"""Decontamination, packing and sharding against brute force and their laws."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from coldlake.llm import decontaminate, packing, sharding

from .helpers import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_scan(text, items):
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        w = fold(body)
        n = min(13, len(w))
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("hits", F.lit(1))


def test_decontamination_matches_brute_force(spark, make_docs, edge_rows):
    items = [(0, prose(50, 40)), (1, "short item here"), (2, prose(51, 13)), (3, None), (4, "..."), (5, prose(50, 40)), (10, "Zebra")]
    inside = prose(50, 40).split()
    rows = edge_rows + [(20, prose(60, 100) + " " + " ".join(inside[5:25]).upper() + ", " + prose(61, 100)), (21, "a SHORT-item here! ok"), (22, " ".join(inside[:12])),
                        (23, " ".join(inside[:13])), (24, "one zebra, 2 zebras"), (25, prose(51, 13) + " " + prose(51, 13)), (26, prose(60, 800) + " " + " ".join(inside[:13]))]
    want = Counter((i, n, hit, tuple(found)) for i, t in rows for n, hit, found in [plain_scan(t, items)])
    for part_bytes in (decontaminate.PART_BYTES, 200):  # 200: the benchmark is scanned in parts
        got = decontaminate.judged(decontaminate.scan(make_docs(rows), benchmark(spark, items), part_bytes=part_bytes)).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
        assert {r["doc_id"] for r in got if r["contaminated"]} == {20, 21, 23, 24, 25}


def test_removed_spans_are_the_hit_words(spark, make_docs):
    items = [(0, prose(50, 20))]
    text = "Keep, this!\n" + prose(50, 20).upper() + "\nand é this."
    scanned = decontaminate.scan(make_docs([(1, text), (2, None), (3, "clean")]), benchmark(spark, items))
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(scanned).collect()}
    assert got == {1: "Keep, this!\n\nand é this.", 2: None, 3: "clean"}


def test_decontamination_of_empty_tables(spark, make_docs):
    assert decontaminate.scan(make_docs([]), benchmark(spark, [(1, "x")])).count() == 0
    assert decontaminate.judged(decontaminate.scan(make_docs([(1, "a b")]), benchmark(spark, []))).first()["contaminated"] is False


def test_fast_ids_equal_the_json_tokenizer(spark, edge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.ByteBpe()
    texts = [t for _, t in edge_rows if t] + ["a <|endoftext|> b", "it's  two   spaces\r\n\n x", "1234567 $$$ __init__", " nbsp em İ", "ʼn ſt ﬁ"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [fast.encode(t) for t in texts] == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_an_exact_round_trip(spark, make_docs, edge_rows):
    rows = edge_rows + [(30 + k, prose(k, 50 * k)) for k in range(12)]
    bpe = packing.ByteBpe()
    packed = packing.pack(make_docs(rows).repartition(5), sequence=64)
    got = packed.collect()
    want = Counter((i, tuple([*bpe.encode(t or ""), 0])) for i, t in rows)
    at = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    flat, ends, cur = [], [], 0
    for r in at:
        assert r["offset"] == cur and r["length"] <= 64 - cur and r["length"] * 4 == len(r["ids"])
        cur = (cur + r["length"]) % 64
        flat += np.frombuffer(r["ids"], dtype="<u4").tolist()
    docs, cur_ids = Counter(), []
    for r in at:
        assert r["start"] == len(cur_ids)
        cur_ids += np.frombuffer(r["ids"], dtype="<u4").tolist()
        if len(cur_ids) == r["doc_tokens"]:
            docs[r["doc_id"], tuple(cur_ids)] += 1
            cur_ids = []
    assert docs == want and not cur_ids
    assert {r["sequence_id"] for r in got} == set(range(-(-len(flat) // 64)))
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in packing.sequences(packed).collect()}
    assert [x for k in sorted(whole) for x in whole[k]] == flat


def test_packing_nothing(spark, make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_shards(spark, make_docs, edge_rows):
    rows = edge_rows + [(1000 + k, f"text {k % 7}") for k in range(3000)]
    tree, grown = sharding.ShardTree.uniform(16), sharding.ShardTree.uniform(17)
    got = sharding.assign_shards(make_docs(rows), tree, grown).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert all(len(s) == 1 for s in by_id.values())
    sizes = [len(s) for s in slots.values()]
    assert min(sizes) > 120 and max(sizes) < 260
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 110 < moved < 260


def test_weights_steer_rows_and_changes_stay_in_their_subtree(spark, make_docs):
    docs = make_docs([(k, None) for k in range(6000)])
    weights = (1.0, 3.0, 0.0, 1.0, 2.0, 1.0)
    before = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, sharding.ShardTree(weights)).collect()}
    count = Counter(before.values())
    assert count[2] == 0 and all(abs(count[s] / 6000 - w / 8) < 0.03 for s, w in enumerate(weights))
    after = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, sharding.ShardTree((1.0, 3.0, 0.0, 1.0, 1.0, 2.0))).collect()}
    assert all(after[k] == s for k, s in before.items() if s < 4)  # another region's leaves changed
    assert any(after[k] != s for k, s in before.items())


def test_sharding_nothing(spark, make_docs):
    assert sharding.assign_shards(make_docs([]), sharding.ShardTree.uniform(4)).count() == 0
