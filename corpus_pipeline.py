"""Training-corpus pipeline: five stages over ``documents``, each one of the dealt operators.

In every stage null ids are kept apart by their text, an empty table stays empty, and further
columns pass through whatever their names; what else a stage defines is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.llm import decontaminate, lines, packing, simhash, toxicity
from coldlake.llm.common import discard, staged, table

#: Contract of the SimHash stage: shingle length in words and greatest bit distance.
SHINGLE, DISTANCE = 3, 2


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text) has its key among ``gone`` (doc_id, t)."""
    return _by_key(docs, gone, "left_anti")


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A join of one-sided kind on (doc_id, text key); sides are named, so columns can't clash."""
    same = F.col("docs.doc_id").eqNullSafe(F.col("keys.doc_id")) & (lines.text_key(F.col("docs.text")) == F.col("keys.t"))
    return docs.alias("docs").join(keys.select("doc_id", "t").alias("keys"), same, how)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF, fitted on the labels' training folds, doesn't reject.

    Null and empty texts have no toxic word: they get the score of a text without one, and stay.
    Texts are scored whole. Repeated rows stay or go together. Without usable labels every text
    has the prior as its score. All columns are kept.
    """
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, crf, docs.columns).where("predicted = 0").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with all but one line of each group of near-equal lines cut; n_chars follows.

    Null texts stay null, a document that loses all lines has an empty text. Of tied lines the
    least (doc_id, text hash, line number) stays; repeated rows count as one document and are
    treated alike. Lines of any length take part.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least (doc_id, text hash) of each SimHash component; of repeated rows, one.

    Texts without words (null, empty, blank) share fingerprint zero and so are one component. Null ids are
    least. Repeated rows that differ in other columns only are repeats, and any one of them stays.
    """
    keyed = docs.select(F.struct("doc_id", lines.text_key(F.col("text")).alias("t")).alias("key"), "text")
    found = staged(simhash.near_duplicates(keyed, SHINGLE, DISTANCE, id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("least")), "components")
    kept = without(docs, found.where("key <> least").select("key.*").distinct())
    repeated = found.where("key = least").groupBy("key").count().where("count > 1").select("key.*")
    if repeated.isEmpty():
        return kept
    repeated = staged(repeated, "repeated")
    mine = _by_key(kept, repeated, "left_semi")
    return without(kept, repeated).unionByName(mine.dropDuplicates(["doc_id", "text"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate by the five percent rule.

    A text without words can't be hit and stays. Repeated rows stay or go together. An empty
    benchmark keeps all.
    """
    found = decontaminate.judged(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))
    gone = staged(found.where("contaminated").select("doc_id", lines.text_key(F.col("text")).alias("t")).distinct(), "contaminated")
    return without(docs, gone)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records and ids of the pieces, in sequences of 1024 ids.

    A null or empty text is its end id alone; repeated rows are packed each, in reading order.
    Columns are the pieces', not those of documents.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder, deleted when
    the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs


#: A fitted tagger and SimHash components have no SQL form; the tests hold stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
