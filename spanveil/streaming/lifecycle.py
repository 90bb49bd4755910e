"""Control events of sessions as a stream: a deleted session's mappings go, and a failure stays until it is looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import engine
from ..runtime import paths_below

# Fixed value: the event that ends a session.
DELETED = "session.deleted"


class Unhealthy(RuntimeError):
    """An earlier batch failed; nothing is answered until clear()."""


class Lifecycle:
    """Events as JSON lines (type, sessionID) for a pipeline's vault; ``folder``: a folder URI for the latch, the file UNHEALTHY."""

    def __init__(self, spark: SparkSession, pipeline: engine.Pipeline, folder: str):
        self.spark, self.pipeline, self.folder = spark, pipeline, folder.rstrip("/")

    def _latch(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/UNHEALTHY")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def healthy(self) -> bool:
        return not any(p.endswith("/UNHEALTHY") for p in paths_below(self.spark, self.folder))

    def clear(self) -> None:
        at, fs = self._latch()
        fs.delete(at, False)

    def apply(self, events: DataFrame, *, now: int = 0, batch: int | None = None) -> None:
        """Forgets the sessions that a batch (value) deletes; other events and broken lines change nothing. Unhealthy if this or an earlier batch fails."""
        if not self.healthy():
            raise Unhealthy("an earlier batch failed")
        e = F.from_json("value", "type string, sessionID string")
        scopes = events.select(e.alias("e")).where((F.col("e.type") == DELETED) & (F.col("e.sessionID") != "")).select(F.col("e.sessionID").alias("scope")).distinct()
        try:
            engine.forget(self.pipeline, scopes, now=now, batch=batch)
        except Exception:
            at, fs = self._latch()
            fs.create(at, True).close()
            raise Unhealthy("the batch failed") from None

    def serve(self, folder: str, checkpoint: str, *, now: int = 0) -> StreamingQuery:
        """Applies event files that arrive in ``folder``; a batch is done before the next begins."""
        each = lambda batch, n: self.apply(batch, now=now, batch=n)
        return self.spark.readStream.text(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
