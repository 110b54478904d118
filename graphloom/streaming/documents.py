"""Documents as a stream: a checkpointed file source in place of asking which outputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import KG_DOCUMENT
from graphloom.operators import load
from graphloom.operators.ingest import doc_id, doctype_of, explode_documents, repair_nodes, repair_rels


def document_stream(spark: SparkSession, path: str, schema: T.StructType = KG_DOCUMENT, files_per_trigger: int = 1000) -> DataFrame:
    """New .json documents below ``path`` as they arrive: (doc_id, doctype, file_name, nodes, relationships)."""
    df = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).json(path)
    name = F.col("_metadata.file_name")
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    d = doc_id(folder, name)
    return df.select(d.alias("doc_id"), doctype_of(d).alias("doctype"), name.alias("file_name"), "nodes", "relationships")


def load_stream(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Write the clean node and relationship records of each batch, and its totals per document, to ``out``; each file is loaded once, whatever is lost in between.

    ``stream_graph`` makes the graph of all that has arrived.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        nodes, rels = explode_documents(df)
        node_rows, rel_rows = load.document_records(repair_nodes(nodes), repair_rels(nodes, rels), df)
        for name, rows in (("nodes", node_rows), ("rels", rel_rows), ("totals", load.totals(node_rows, rel_rows))):
            rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")  # a repeated batch replaces itself

    w = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_graph(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all records that load_stream wrote: what upserts in the order of kind, file name and place would leave, in whatever order the files came."""
    records = lambda name: spark.read.parquet(f"{out}/{name}")
    nodes = load.load_nodes(records("nodes"))
    return nodes, load.load_edges(records("rels"), nodes)


def event_counts(events: DataFrame, at: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records per window of event time, late ones within the watermark counted."""
    return events.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
