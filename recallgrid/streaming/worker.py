"""Derivation as a stream: raw log rows become beliefs, corroborations, edges and stamps, batch by batch.

Every table is a folder with a sub-folder for each batch. A batch is made from its own rows and from what the batches before it left;
its folders are overwritten whole if it runs again, and a ledger entry, written last, says that it is complete. A batch that is in
the ledger isn't made again. So a stream that is killed at any place and started anew leaves the tables of one that never was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..operators.scan import Ranges
from ..plans.session import new_folder
from ..sources.model import PROJECTION

#: The tables of a worker, without the batch that a row is of.
TABLES = {
    "beliefs": "id string, content string, content_hash string, type string, alpha double, beta double, lock_level string, origin string, created_at long",
    "corroborations": "belief_id string, session_id string, source_type string, ingested_at long",
    "edges": "src string, dst string, type string, weight double",
    "stamps": "log_id long, belief_id string, action string",
    "heads": "session_id string, created_at long, log_id long, belief_id string",
    "ledger": "rows long",
}
LOG = "log_id long, source_kind string, raw_text string, session_id string, created_at long, role string"


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The raw log of the conversation files in a folder, without what was derived from it; new files are new rows."""
    schema = spark.read.parquet(f"{folder}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/conversations*.parquet")  # files or folders of them
    log = spark.sql(PROJECTION["log"].replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {conversations}"), conversations=turns)
    kind = F.when(F.col("log_id") % 7 == 0, "remember").otherwise(F.col("source_kind"))
    return log.select("log_id", kind.alias("source_kind"), "raw_text", "session_id", "created_at", F.when(F.col("log_id") % 2 == 0, "user").otherwise("assistant").alias("role"))


class Worker:
    """The tables below a folder, and the steps that add a batch to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table's rows of all complete batches, or of those before one."""
        kind = T._parse_datatype_string(TABLES[name])
        if not self._is_there(name):
            return self.spark.createDataFrame([], kind.add("batch", "integer"))
        rows = self.spark.read.schema(kind.add("batch", "integer")).parquet(f"{self.folder}/{name}")
        if before is not None:
            return rows.where(F.col("batch") < before)
        if name == "ledger":
            return rows
        return rows.join(F.broadcast(self.table("ledger").select("batch").distinct()), "batch", "left_semi")

    def _is_there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _put(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/batch={number}"
        kind = T._parse_datatype_string(TABLES[name])
        rows.select(*(F.col(f.name).cast(f.dataType) for f in kind)).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(kind).parquet(path)

    def add(self, log: DataFrame, number: int, after: Callable[[str], None] = lambda step: None) -> None:
        """Add a batch of log rows. ``after`` is called with the name of each table that was written.

        Of several rows of one text the first, by time and number, is inserted where no belief has its hash; all others corroborate.
        A session sighting a belief again from one kind of source counts once. A row that isn't to be kept is stamped without a
        belief. Each kept row of a session hangs on the kept row before it, of this batch or an earlier one; a row that comes after
        later ones of its session hangs on the last of them.
        """
        if not self.table("ledger").where(F.col("batch") == number).isEmpty():
            return
        raw = f"{self.folder}/raw/batch={number}"
        made = ingest.derive(log).join(log.select("log_id", "session_id", "created_at", "source_kind"), "log_id")
        made.write.mode("overwrite").parquet(raw)
        rows = self.spark.read.parquet(raw)
        kept = rows.where("kept")
        # No group is gathered: of a text that a third of all rows have, each task brings one row.
        first = kept.groupBy("content_hash").agg(F.min(F.struct("created_at", "log_id")).alias("first"))
        known = self.table("beliefs", number).select("content_hash", F.col("id").alias("known_id"))
        fate = first.join(known, "content_hash", "left")
        new = kept.join(fate.where("known_id IS NULL").select(F.col("first.log_id").alias("log_id")), "log_id")
        beliefs = self._put("beliefs", number, new)
        after("beliefs")
        ids = fate.where("known_id IS NOT NULL").select("content_hash", F.col("known_id").alias("belief_id"), F.lit(None).cast("long").alias("own")).unionByName(
            beliefs.join(fate.select("content_hash", F.col("first.log_id").alias("own")), "content_hash").select("content_hash", F.col("id").alias("belief_id"), "own")
        )
        found = rows.join(ids.withColumn("kept", F.lit(True)), ["content_hash", "kept"], "left")
        action = F.when(F.col("belief_id").isNull(), "skipped").when(F.col("log_id") == F.col("own"), "inserted").otherwise("corroborated")
        stamped = found.withColumn("action", action)
        self._put("stamps", number, stamped)
        after("stamps")
        seen = stamped.where("action = 'corroborated'").groupBy("belief_id", "session_id", F.col("source_kind").alias("source_type")).agg(F.min("created_at").alias("ingested_at"))
        earlier = self.table("corroborations", number)
        same = [seen[c].eqNullSafe(earlier[c]) for c in ("belief_id", "session_id", "source_type")]
        self._put("corroborations", number, seen.join(earlier, same[0] & same[1] & same[2], "left_anti"))
        after("corroborations")
        linked = stamped.where("belief_id IS NOT NULL AND session_id IS NOT NULL").select("session_id", "created_at", "log_id", "belief_id", F.lit(False).alias("old"))
        sessions = linked.select("session_id").distinct()
        heads = self.table("heads", number).join(sessions, "session_id", "left_semi").groupBy("session_id").agg(F.max(F.struct("created_at", "log_id", "belief_id")).alias("h"))
        chain = linked.unionByName(heads.select("session_id", "h.created_at", "h.log_id", "h.belief_id", F.lit(True).alias("old")))
        # The earlier batches' last row stands before all of this one's.
        chain = Ranges(chain, ["session_id"], [F.desc("old"), F.col("created_at"), F.col("log_id")]).previous(dst="belief_id")
        edges = chain.where("NOT old AND dst IS NOT NULL AND belief_id <> dst").select(F.col("belief_id").alias("src"), "dst").distinct()
        edges = edges.withColumns({"type": F.lit("DERIVED_FROM"), "weight": F.lit(1.0)}).join(self.table("edges", number).select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
        self._put("edges", number, edges)
        after("edges")
        self._put("heads", number, linked.groupBy("session_id").agg(F.max(F.struct("created_at", "log_id", "belief_id")).alias("h")).select("session_id", "h.*"))
        after("heads")
        self._put("ledger", number, rows.agg(F.count("*").alias("rows")))
        after("ledger")


def run(log: DataFrame, folder: str | None = None, after: Callable[[str], None] = lambda step: None) -> Worker:
    """Derive all that the stream has now. With the folder of an earlier run it goes on where that ended, or broke off."""
    spark = log.sparkSession
    worker = Worker(spark, folder or new_folder(spark, "worker"))
    query = log.writeStream.foreachBatch(lambda rows, number: worker.add(rows, number, after)).option("checkpointLocation", f"{worker.folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return worker
