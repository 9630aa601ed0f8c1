"""New texts embedded as they arrive, once per document key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortspark.plans.embedding import Embedder
from cohortspark.runtime import cut
from cohortspark.sources.writers import SHARD_SIZE, assign_shards

#: Keeps the keys on the executors' disks, with a copy beside the checkpoint, not in their memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def embed_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, embedder: Embedder,
                 key: str = "doc_id", text: str = "text", fmt: str = "parquet", glob: str | None = None,
                 max_files: int = 1000, available_now: bool = True, interval: str = "1 minute", model: str | None = None,
                 shard_size: int = SHARD_SIZE) -> StreamingQuery:
    """File stream -> keys not seen before -> embedder -> Parquet sink with model name, shard_id, row_in_shard and batch.

    The checkpoint remembers the files, and the state of the stream the keys: a key passes once, in whatever batch it comes
    first, also after a restart. The sink is never read. It is partitioned by batch and a batch replaces its own
    partition, so one that is replayed after a failure adds nothing twice. Rows without a key are left out. Of several rows with
    a new key in one batch one passes. Each batch begins a new shard; where, it knows from a table of one row per batch beside the
    checkpoint. The embedder must be stateless (a fitted model), or two runs would not agree.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    reader = session.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    docs = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    new = docs.filter(F.col(key).isNotNull()).dropDuplicates([key])
    name = model or getattr(embedder, "name", "custom")

    def first_shard(batch: DataFrame, batch_id: int) -> int:
        try:
            shards = batch.sparkSession.read.parquet(f"{checkpoint}-shards")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err.getCondition()):
                raise
            return 0
        return shards.filter(F.col("batch") < batch_id).agg(F.max("after")).first()[0] or 0

    def write(batch: DataFrame, batch_id: int) -> None:
        # the rows are cut once: a plan of the stream that is run twice would ask the state twice
        rows = cut(batch)
        placed = cut(assign_shards(rows, [key], shard_size, first_shard(batch, batch_id)))
        last = placed.agg(F.max("shard_id")).first()[0]
        if last is None:
            return
        out = embedder(placed, text, "embedding").drop(text).withColumn("model", F.lit(name))
        after = batch.sparkSession.createDataFrame([(batch_id, last + 1)], "batch long, after long")
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{checkpoint}-shards")
        (out.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(sink))

    writer = new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
