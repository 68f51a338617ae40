"""Order change feed (H8): new lines, cancellations and returns applied per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.functions.sensor import row_key
from coldlake.operators import maintenance as M
from coldlake.schemas import FACT_ORDER
from coldlake.sources.order_store import KEY, PARTS, PLACE, OrderStore
from coldlake.sources.tables import conform_column

NAMES = [f.name for f in FACT_ORDER.fields]


def _sequenced(changes: DataFrame) -> DataFrame:
    """``changes`` with ``_rank`` (insert, cancel, return) and ``_seq``, in which they apply."""
    rank = F.when(F.col("op") == "insert", 0).when(F.col("op") == "cancel", 1).otherwise(2)
    seq = F.col("seq").cast("long") if "seq" in changes.columns else rank.cast("long")
    return changes.withColumns({"_rank": rank, "_seq": seq * 4 + rank})


def last_changes(changes: DataFrame) -> DataFrame:
    """One row per ``order_line_id``: what its changes end in.

    Changes apply in ``seq`` order (whole numbers); without that column, inserts precede
    cancellations and returns. ``present`` is true after an insert, false after a cancellation,
    null when the stored line decides; ``returned`` tells of a return that no later cancellation
    undoes; ``inserted_at`` names the last insert. Only numbers are aggregated, map-side.
    """
    def at(op: str):
        return F.max(F.when(F.col("op") == op, F.col("_seq")))

    last = _sequenced(changes).groupBy(KEY).agg(at("insert").alias("inserted_at"), at("cancel").alias("cancelled_at"), at("return").alias("returned_at"))
    some = F.col("inserted_at").isNotNull() | F.col("cancelled_at").isNotNull()
    present = F.when(some, F.coalesce(F.col("inserted_at") > F.col("cancelled_at"), F.col("inserted_at").isNotNull()))
    return last.select(KEY, present.alias("present"), F.coalesce(F.col("returned_at") > F.col("cancelled_at"), F.col("returned_at").isNotNull()).alias("returned"), "inserted_at")


def inserted_lines(changes: DataFrame, last: DataFrame) -> DataFrame:
    """The last inserted row of every line that ends present, and whether it is ``returned``; of equal or
    rival rows with one ``seq``, one. Rows meet ``last`` and each other under the key, in one shuffle."""
    rows = _sequenced(changes).where("op = 'insert'")
    named = rows.select(*[conform_column(rows, "fact_order", f).alias(f.name) for f in FACT_ORDER.fields], "_seq")
    won = named.join(last.where("present").select(KEY, "inserted_at", "returned"), KEY).where("_seq >= inserted_at")  # no equality, which would join the shuffle's key
    return won.dropDuplicates([KEY]).select(*NAMES, "returned")


def apply_order_changes(store: OrderStore, changes: DataFrame) -> None:
    """``changes`` has an ``op`` column ('insert' | 'cancel' | 'return'), optionally ``seq``, and
    fact_order columns (only ``order_line_id`` is needed for cancel/return). Each line takes its
    last change: an inserted line replaces a stored one (A4), a cancelled one goes (A6), a
    returned one gets a negated copy with a hashed key (A7). Partitions without any of these
    keys keep their files. A replay changes nothing.

    Which stored rows go or are copied is found through their keys; the rows themselves are
    marked where they lie. A returned line's copy has its line's date."""
    held = [last_changes(changes).persist()]
    last, work = held[0], store.work()
    try:
        inserted = inserted_lines(changes, last).persist()
        held.append(inserted)
        # a stored row that gets a copy keeps its key here; one that neither goes nor is copied is rewritten as it is
        origin = F.when(F.col("present").isNull() & F.col("returned"), F.col(KEY))
        hits = store.find(work, "hits", last.select(KEY, F.col("present").isNotNull().alias("goes"), origin.alias("origin")), "goes", "origin")
        back = hits.where("origin is not null")
        month = F.date_format("order_date", "yyyy-MM").alias("order_month")
        copy = row_key(KEY, F.lit("RET")).alias(KEY)
        copies = store.kept(work, "copies", back.withColumn(KEY, F.col("origin")).select(copy, "order_month").unionByName(inserted.where("returned").select(copy, month)))
        stale = store.find(work, "stale", copies.select(KEY).distinct())
        new = inserted
        clash = store.kept(work, "clash", inserted.select(KEY).join(copies, KEY, "left_semi"))
        if not clash.isEmpty():  # an inserted row with the key of a copy gives way to it
            new = inserted.join(clash, KEY, "left_anti").select(inserted.columns)
        touched = (hits.select(*PARTS).unionByName(stale.select(*PARTS)).unionByName(store.places_of(inserted))
                   .unionByName(copies.select("order_month", store.bucket().alias("bucket"))))
        gone = hits.where("goes").select(*PLACE).unionByName(stale.select(*PLACE))

        def change(rows: DataFrame) -> DataFrame:
            rows = store.marked(work, store.marked(work, rows, gone, "_gone").where("not _gone"), back, "_back")
            merged = rows.select(*NAMES, F.col("_back").alias("returned")).unionByName(new)
            return M.apply_returns(merged, F.col("returned"))

        store.rewrite(work, touched, change)
    finally:
        for frame in held:
            frame.unpersist()


def start_order_feed(changes_stream: DataFrame, store: OrderStore, checkpoint: str, available_now: bool = False):
    w = changes_stream.writeStream.foreachBatch(lambda df, _: apply_order_changes(store, df)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="900 seconds")
    return w.start()
