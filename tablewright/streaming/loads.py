"""Keeping the persistent value-count table up to date while loads arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablewright.operators import quality

KEY = ["dataset_id", "load_no", "row_no", "pos"]


def maintain_counts(spark: SparkSession, folder: str, schema: StructType, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the signed deltas of newly arriving cells to the table at path.

    A cell counts once, however late or often it is delivered and in whatever order the loads come: the keys taken in
    are kept beside the counts, in ``path``_keys. Each batch writes its own ``epoch`` partition of both in overwrite mode
    and looks only at the keys of earlier ones, so a batch that is run again after a failure replaces itself.
    """
    cells = spark.readStream.schema(schema).parquet(folder)
    keys = f"{path}_keys"

    def add(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(KEY)
        if epoch:
            known = batch.sparkSession.read.schema(StructType([schema[c] for c in KEY]).add("epoch", "long")).parquet(keys)
            new = new.join(known.filter(F.col("epoch") < epoch).select(KEY), KEY, "left_anti")
        deltas = quality.signed_deltas(quality.value_counts(quality.trimmed_cells(new)))
        changed = deltas.selectExpr("dataset_id", "pos", "value", "arrived - left as delta", "load_no").filter("delta <> 0")
        new.select(KEY).write.mode("overwrite").parquet(f"{keys}/epoch={epoch}")
        changed.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
