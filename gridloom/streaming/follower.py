"""A follower: a stream over a change log that keeps a copy of the model up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Model
from ..sources.store import RECORD, ChangeLog


class Follower:
    """Reads the log's folder as a stream; a micro-batch tells that there is something new.

    Records are applied in the order of versions from the log itself, each once, also when a batch runs again after a failure:
    versions that the model has are skipped.  After a gap (a record that arrives before its predecessor) records wait in the
    log, not here, so a restarted follower loses none.
    """

    def __init__(self, model: Model, log: ChangeLog):
        self.model, self.log = model.fork(), log

    def apply(self, batch: DataFrame, _: int) -> None:
        if batch.where(f"version > {self.model.version}").isEmpty():
            return
        self.log.replay(self.model)

    def start(self, checkpoint: str, once: bool = False) -> StreamingQuery:
        stream = self.log.spark.readStream.schema(RECORD).json(self.log.path)
        out = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime="2 seconds")).start()
