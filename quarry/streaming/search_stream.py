"""Search as a streaming job: query files arrive in a folder, every
micro-batch is answered with the batch search plan against a persisted index.

This replaces an interactive request loop: requests are rows of a stream,
the index tables are read once per batch from Parquet (the index job writes
them, see ``plans.corpus.build_index``), results are appended to a sink folder.
Progress is tracked in the checkpoint folder that the caller names, so a
restarted driver resumes without answering a query twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import blockmax
from ..plans.search import sparse_query_vectors

QUERY_SCHEMA = "query_id long, text string"


def answer_batch(spark: SparkSession, index_dir: str, meta: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """One micro-batch of queries -> ranked results (+ titles when given).
    Only the index buckets of the batch's terms are read."""
    qv = sparse_query_vectors(spark.read.parquet(f"{index_dir}/idf"), batch)
    postings, maxima = blockmax.read_postings(spark, f"{index_dir}/sparse", qv)
    ranked = blockmax.search_blocks(qv, postings, maxima, k)
    if meta is not None:
        ranked = ranked.join(meta.select("post_id", "title"), "post_id", "left")
    return ranked


def start_search_stream(spark: SparkSession, query_dir: str, index_dir: str, out_dir: str,
                        checkpoint: str, k: int = 10, fmt: str = "json",
                        trigger_once: bool = False):
    """Start the streaming search; returns the StreamingQuery.  ``checkpoint``
    is a folder on shared storage that stays the same over restarts; a restart
    with it goes on after the files already answered."""
    stream = spark.readStream.schema(QUERY_SCHEMA).format(fmt).load(query_dir)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        try:
            meta = spark.read.parquet(f"{index_dir}/metadata")
        except Exception:  # noqa: BLE001  (metadata is optional)
            meta = None
        res = answer_batch(spark, index_dir, meta, batch, k)
        # one folder per epoch, overwritten on replay: a retried batch after a
        # failure rewrites its own output instead of appending duplicates
        res.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 seconds")
    return w.start()
