"""The corpus pipeline, stage by stage against brute force, and the registered queries."""
import os
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from coldlake.llm import packing

from .helpers import prose
from .test_decontaminate_packing_sharding import plain_scan
from .test_lines import plain
from .test_near_duplicates import least_reachable, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    """A folder with a benchmark and labels of its own."""
    folder = tempfile.mkdtemp(prefix="coldlake-pipe-", dir=os.environ.get("COLDLAKE_SCRATCH", "/tmp"))
    spark.createDataFrame([(1, prose(70, 30)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(100 + k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def ids(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"] and P.ORACLE_SQL is None


def test_toxicity_stage(spark, make_docs, edge_rows, small):
    rows = edge_rows + [(100 + k, prose(300 + k, 25) + (" foulword" if k % 2 else "")) for k in range(80)] + [(300, "so foulword it is"), (301, prose(9, 40))]
    docs = make_docs(rows, clash=False)
    out = P.toxicity_stage(spark, docs, small)
    assert out.schema == docs.schema
    assert ids(out) == Counter(r for r in rows if "foulword" not in (r[1] or ""))


def test_line_stage(spark, make_docs, small):
    passage = prose(80, 60)
    rows = [(k, f"{prose(200 + k, 20)}\n{passage}\n{prose(400 + k, 20)}") for k in range(6)] + [(10, passage.upper()), (11, None), (12, prose(5, 30))]
    out = P.line_stage(spark, make_docs(rows, clash=False), small)
    got = out.collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain(rows) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got)
    assert sum(passage in (r["text"] or "") for r in got) == 1 and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_simhash_stage(spark, make_docs, edge_rows, small):
    base = prose(31, 150).split()
    rows = edge_rows + [(500 + k, " ".join(base[:k] + ["new"] + base[k + 1:])) for k in range(20)]
    out = P.simhash_stage(spark, make_docs(rows, clash=False), small)
    prints = {t: plain_fingerprint(t) for _, t in rows}
    group = least_reachable(set(prints.values()), [(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 2])
    kept = out.collect()
    assert Counter(group[prints[r["text"]]] for r in kept) == Counter({g: 1 for g in group.values()})
    known = {}
    for i, t in rows:
        known.setdefault(group[prints[t]], []).append((i is not None, i))
    assert {r["doc_id"] for r in kept} == {min(v)[1] for v in known.values()}


def test_decontamination_stage(spark, make_docs, edge_rows, small):
    inside = prose(70, 30).split()
    rows = edge_rows + [(600, prose(33, 50) + " " + " ".join(inside[4:20])), (601, prose(34, 600) + " " + " ".join(inside[:13])), (602, " ".join(inside[:12]))]
    want = Counter()
    for i, t in rows:
        n, hit, _ = plain_scan(t, [(1, prose(70, 30))])
        if not (hit and 20 * hit >= n):
            want[i, t] += 1
    assert ids(P.decontaminate_stage(spark, make_docs(rows, clash=False), small)) == want and (600, rows[-3][1]) not in want and (601, rows[-2][1]) in want


def test_packing_stage(spark, make_docs, edge_rows, small):
    bpe = packing.ByteBpe()
    got = P.packing_stage(spark, make_docs(edge_rows, clash=False), small).orderBy("sequence_id", "offset").collect()
    ids_of = [x for r in got for x in np.frombuffer(r["ids"], dtype="<u4").tolist()]
    assert len(ids_of) == sum(len(bpe.encode(t or "")) + 1 for _, t in edge_rows) and all(r["offset"] + r["length"] <= 1024 for r in got)


def test_stages_pass_clashing_columns_through(spark, make_docs, edge_rows, small):
    inside = prose(70, 30)
    rows = edge_rows[:6] + [(100 + k, prose(300 + k, 25) + (" foulword" if k % 2 else "")) for k in range(80)] + [(600, inside), (600, inside), (None, inside)]
    plain_docs, first = make_docs(rows, clash=False), ["doc_id", "text", "lang", "source", "n_chars"]
    names = ["_id", "_t", "docs", "keys", "gone", "least", "t", "key", "row", "component_id", "n_words", "hits", "items", "a b"]
    wide = plain_docs.withColumns({c: F.concat(F.lit("x"), "doc_id") for c in names})
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, wide, small)
        assert got.columns == [*first, *names], name
        assert all(r[c] == (f"x{r['doc_id']}" if r["doc_id"] is not None else None) for r in got.collect() for c in names), name
        want = Counter(map(tuple, stage(spark, plain_docs, small).collect()))
        assert Counter(map(tuple, got.select(first).collect())) == want and want, name


def test_run_on_documents_and_on_none(spark, make_docs, small):
    out = P.run(spark, SF)
    assert out.count() > 0 and "doc_id" in out.columns
    for _, stage in P.STAGES:
        assert stage(spark, make_docs([], clash=False), small).count() == 0


def test_registered_queries(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    columns = {
        "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op2_simhash": ["doc_id", "fingerprint", "component_id"],
        "op3_ctw": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op4_covertree": ["vec_id", "n_links", "component_id", "kept"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"], "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op8_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op10_lines": ["doc_id"], "op5_chat": ["conv_id"]}
    for name, first in columns.items():
        df = __spark_entry__.queries()[name](spark, SF)
        assert df.columns[:len(first)] == first, name
        source = "embeddings" if name == "op4_covertree" else "documents"
        if name not in ("op5_chat", "op7_packing"):
            assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count(), name
    held = __spark_entry__.queries()["op3_ctw"](spark, SF).select(F.sum(F.col("held_out").cast("int"))).first()[0]
    assert held > 0
