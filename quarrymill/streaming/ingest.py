"""Incremental ingestion: a stream of fetched pages into a store, a micro-batch a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import embedding, urls
from ..operators import jobs
from ..sources.shared import shared_dir
from ..sources.store import Store


def read_fetches(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files of jobs.FETCHES; files_per_batch bounds what is taken in at a time."""
    return spark.readStream.schema(jobs.FETCHES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply_batch(store: Store, batch: DataFrame, rules: list[urls.HostRule], embedder: embedding.Embedder | None = embedding.hash_embed, agent: str = "") -> int:
    """One commit for a batch; of a URL that occurs more than once the last fetch counts."""
    last = Window.partitionBy(F.lower("url")).orderBy(F.desc("ord"))
    one = batch.withColumn("url", urls.normalise(F.col("url"))).filter("url IS NOT NULL").withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    state = store.read("state")
    done = jobs.decide(one, state, store.read("chunks"), rules, agent=agent).checkpoint()
    return store.commit(jobs.changes(done, state, F.current_timestamp(), embedder))


def ingest(store: Store, fetches: DataFrame, rules: list[urls.HostRule], checkpoint: str, embedder: embedding.Embedder | None = embedding.hash_embed, agent: str = "", available_now: bool = True) -> StreamingQuery:
    """Starts the query. A batch that is delivered again after a failure is applied again, with the same result, since
    unchanged content is recognised by its hash."""
    shared_dir(store.spark)
    store.create()

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_batch(store, batch, rules, embedder, agent)

    writer = fetches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
