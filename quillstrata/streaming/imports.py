"""JSON-lines files imported as they arrive.

Each micro-batch is one import into the store. An import takes nothing that is
there already, so a batch that is run again after a failure changes nothing:
the store's version is the only state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstrata.sources.exchange import RECORDS, import_lines, numbered_lines
from quillstrata.sources.store import Store

#: The tables of the record types.
TABLES = {kind: f"{kind}s" for kind in RECORDS}


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Imports every new file of ``folder`` into ``store``; with ``once`` it ends when all present ones are in.

    A batch with a malformed line stops the query before anything of it is
    written. Batches are files of hand-written notes, small by nature.
    """
    lines = spark.readStream.format("text").load(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def run(batch: DataFrame, _: int) -> None:
        held = numbered_lines(batch)
        if not held.isEmpty():
            at = store.version()
            grown, summary = import_lines(store.read(at), held)
            new = {r.type for r in summary.where("imported > 0").collect()}
            store.write(grown, {TABLES[kind] for kind in new}, at)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
