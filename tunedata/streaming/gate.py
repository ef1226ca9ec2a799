"""The quality gate as a stream: formatted rows that pass and are new, and rejected rows with their reason.

Whether a text came before, in this micro-batch or any earlier one, is keyed state on its digest: 32 bytes, an id and
a batch's verdicts; the texts themselves never enter Python or the state. Each micro-batch writes its
own folder, so one that is replayed after a failure replaces itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tunedata.operators import quality as q
from tunedata.operators.splits import split_column

KEPT, DUPLICATE = "kept", "duplicate"


class FirstOfDigest(StatefulProcessor):
    """The first id seen of each digest is kept, in one micro-batch the smallest; all others are duplicates.
    An id that was kept stays kept when its row is read again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.first.get()[0] if self.first.exists() else None
        frames = list(rows) if kept is None else rows  # ids only, and only of a new digest's first batch
        if kept is None:
            kept = min(int(f["id"].min()) for f in frames)
            self.first.update((kept,))
        for f in frames:
            ids = f["id"].drop_duplicates()
            yield pd.DataFrame({"id": ids, "verdict": [KEPT if i == kept else DUPLICATE for i in ids]})

    def close(self) -> None:
        pass


def gate_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, verdict, text``: each arriving row, a rejected one with its reason and without its text, one that passes the
    rules with its text and no verdict yet; and the verdicts of the latter (text null).

    ``docs`` is a stream; ids are whole numbers, not null. The rules are those of the batch gate."""
    docs = docs.select(id_col, F.col(text_col).alias("text"))
    rules = q.gate_reasons(docs, id_col, "text", "text")
    rows = rules.select(F.col("id").cast("long").alias("id"), F.col("reason").alias("verdict"),
                        F.when(F.col("reason").isNull(), F.col("text")).alias("text"))
    passed = rules.where("reason IS NULL").select(F.col("id").cast("long").alias("id"), "digest")
    verdicts = passed.groupBy("digest").transformWithStateInPandas(FirstOfDigest(), "id long, verdict string", "Append", "None")
    return rows.unionByName(verdicts.select("id", "verdict", F.lit(None).cast("string").alias("text")))


def write_gated(batch: DataFrame, batch_id: int, out: str, form: Callable[[Column], Column] | None = None, fraction: float = 0.05) -> None:
    """One micro-batch into ``out/kept/batch=<id>`` (``id, text, split``, the text formatted by ``form``) and
    ``out/rejected/batch=<id>`` (``id, reason``)."""
    batch = batch.persist(StorageLevel.DISK_ONLY)
    try:
        verdicts = batch.where("verdict IS NOT NULL").select("id", "verdict").distinct()
        rejected = verdicts.where(F.col("verdict") != KEPT).select("id", F.col("verdict").alias("reason"))
        texts = batch.where("verdict IS NULL").select("id", "text").dropDuplicates(["id"])
        text = F.col("text") if form is None else form(F.col("text"))
        kept = texts.join(verdicts.where(F.col("verdict") == KEPT), "id", "left_semi").select(
            "id", text.alias("text"), split_column("id", fraction).alias("split"))
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    finally:
        batch.unpersist()


def run_gate(docs: DataFrame, out: str, checkpoint: str | None = None, form: Callable[[Column], Column] | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> str:
    """Gates what has arrived in ``docs`` since the last call with this ``checkpoint`` and returns ``out``. Both tables
    exist afterwards, also when nothing has arrived (``batch=-1`` holds no rows)."""
    from tunedata.streaming.plateau import rocksdb_state

    spark = docs.sparkSession
    for name, columns in (("kept", "id long, text string, split string"), ("rejected", "id long, reason string")):
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{out}/{name}/batch=-1")
    with rocksdb_state(docs.sparkSession):
        (gate_stream(docs, id_col, text_col).writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint or out + "-checkpoint").trigger(availableNow=True)
         .foreachBatch(lambda batch, batch_id: write_gated(batch, batch_id, out, form)).start().awaitTermination())
    return out
