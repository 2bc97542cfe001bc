"""The summary worker: ended sessions to summaries and announcements, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from parlance.functions.text import CALL_KEYS, MEETING_KEYS, blank_summary, strip, summary_fields
from parlance.sources.segments import SegmentLog
from parlance.storage import drop_stored, stored

# --- fixed values: results depend on them ---------------------------------------
EMPTY = "the model's answer holds no summary"
# -------------------------------------------------------------------------------


class SummaryWorker:
    """Takes ended sessions (session_id, tenant_id, profile, transcript) in batches and keeps their summaries in a folder.

    complete(rows) gives (session_id, raw, error) for the sessions that said
    something; a session without an answer has failed. States: a session
    that said nothing is ready at once; others are waiting until their answer
    is there, then ready, or failed where there is an error or the answer says
    nothing. A batch's results and its announcements are one commit named by
    the batch, so a batch that is done again after a crash changes nothing:
    every announcement is there once, and waiting states are replaced.
    """

    def __init__(self, spark: SparkSession, path: str, complete: Callable[[DataFrame], DataFrame], name: str = "summaries"):
        self.log, self.complete, self.name = SegmentLog(spark, path), complete, name

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        work = f"{self.name}-{batch_id}"
        if any(c["work"] == work for c in self.log.history()):
            return
        ended = stored(rows.select("session_id", "tenant_id", "profile", F.coalesce("transcript", F.lit("")).alias("transcript")), "ended")
        said = ended.where(strip("transcript") != "")
        state = lambda of, status, error, summary: of.select("session_id", "tenant_id", "profile", status.alias("status"), error.alias("error"), summary.alias("summary"), F.length("transcript").alias("transcript_chars"))
        none = F.lit(None).cast("string")
        keys = ended.select(F.col("session_id").alias("key"))
        self.log.append({"summaries": state(said, F.lit("waiting"), none, none)}, keys, f"{work}-waiting")
        answers = self.complete(said.select("session_id", "tenant_id", "profile", "transcript"))
        rows = said.join(answers.select("session_id", "raw", F.col("error").alias("fault")), "session_id", "left")
        call, meeting = summary_fields(F.col("raw")), summary_fields(F.col("raw"), "meeting")
        is_meeting = F.coalesce(F.col("profile") == "meeting", F.lit(False))
        rows = rows.withColumns({"call": call, "meeting": meeting})
        blank = F.when(is_meeting, blank_summary(F.col("meeting"), MEETING_KEYS)).otherwise(blank_summary(F.col("call"), CALL_KEYS))
        error = F.coalesce(F.col("fault"), F.when(F.col("raw").isNull() | blank, F.lit(EMPTY)))
        made = state(rows, F.when(error.isNull(), "ready").otherwise("failed"), error, F.when(error.isNull(), F.when(is_meeting, F.to_json("meeting")).otherwise(F.to_json("call"))))
        silent = state(ended.where(strip("transcript") == ""), F.lit("ready"), none, none)
        whole = stored(made.unionByName(silent), "summarised")
        self.log.append({"summaries": whole, "announced": whole.drop("summary", "error")}, keys, work)
        drop_stored(ended, whole)

    def start(self, ended: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of ended sessions."""
        return ended.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def summaries(self) -> DataFrame | None:
        """Each session's last state."""
        return self.log.live("summaries", "session_id")

    def announced(self) -> DataFrame | None:
        """Every announcement: that a session's summary is ready or failed, without its text."""
        rows = self.log.table("announced")
        return rows.drop("segment") if rows is not None else None
