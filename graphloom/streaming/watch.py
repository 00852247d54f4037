"""Keeping graphs fresh: a change stream whose micro-batches become graph versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.scratch import written
from graphloom.operators.reconcile import latest
from graphloom.plans.project import Project
from graphloom.sources.watch import TreeWatch
from graphloom.streaming.newest import DELAY_MS, newest_changes


def superseded(batch: DataFrame) -> DataFrame:
    """The last change of each path: what came before it is out of date."""
    return latest(batch, "path", "at", "change")


def watch(project: Project, root: str, checkpoint: str, seconds: float = 1.0, once: bool = False) -> StreamingQuery:
    """Apply every change below ``root`` to the project's graph, the newest of each path when the path has come to
    rest. One query is the only writer; after a restart the checkpoint gives the changes made meanwhile, and applying a
    batch twice changes nothing. With ``once`` nothing waits."""
    project.spark.dataSource.register(TreeWatch)
    changes = project.spark.readStream.format("treewatch").option("state", f"{checkpoint.rstrip('/')}/tree").load(root)
    changes = newest_changes(changes, 0 if once else DELAY_MS)

    def upkeep(batch: DataFrame, _: int) -> None:
        rows = written(superseded(batch), "changes")  # read whole and once, as the stream's state asks
        if rows.isEmpty():
            return
        if project.store.exists():
            project.apply(rows)
        else:
            project.parse()

    writer = changes.writeStream.foreachBatch(upkeep).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


class Watchers:
    """One running query for each project; starting again replaces it."""

    def __init__(self) -> None:
        self.queries: dict[str, StreamingQuery] = {}

    def start(self, project: Project, root: str, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
        self.stop(root)
        self.queries[root] = watch(project, root, checkpoint, seconds)
        return self.queries[root]

    def stop(self, root: str) -> None:
        query = self.queries.pop(root, None)
        if query is not None:
            query.stop()
