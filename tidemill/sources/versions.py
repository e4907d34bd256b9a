"""Tables in versions: a reader sees one whole version, and the one before can come back.

Data folders are written once and never changed. A commit is one line appended to a log;
the line with the highest number names the data that readers see. Spark moves a log file
into place when its job commits, so a run that is cut off leaves readers where they were.
One writer at a time is assumed; a reader may read at any time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LOG = "n long, data string, batch_id long, note string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; one of this machine only where none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemill-")
    return f"{base}/tables-{uuid.uuid4().hex}"


class VersionedTable:
    """PUB-02's store: versions of one table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def history(self) -> list[Row]:
        """All commits, the newest first; one small row a commit."""
        try:
            return self._spark.read.schema(LOG).json(f"{self._path}/log").orderBy(F.desc("n"), "data").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def read(self) -> DataFrame | None:
        """The version that readers see; None before the first commit."""
        found = self.history()
        return self._spark.read.parquet(found[0].data) if found else None

    def _append(self, data: str, batch_id: int | None, note: str) -> int:
        n = max((r.n for r in self.history()), default=0) + 1
        self._spark.createDataFrame([(n, data, batch_id, note)], LOG).coalesce(1).write.mode("append").json(f"{self._path}/log")
        return n

    def commit(self, rows: DataFrame, batch_id: int | None = None, note: str = "") -> int | None:
        """Make ``rows`` the next version; a batch that was committed before changes nothing."""
        if batch_id is not None and self.has_batch(batch_id):
            return None
        data = f"{self._path}/data-{uuid.uuid4().hex}"
        rows.write.parquet(data)
        return self._append(data, batch_id, note)

    def has_batch(self, batch_id: int) -> bool:
        return any(r.batch_id == batch_id for r in self.history())

    def rollback(self) -> int:
        """Let readers see the last version that differs from today's, as a new commit."""
        found = self.history()
        before = next((r for r in found if r.data != found[0].data), None)
        if before is None:
            raise ValueError("there is no earlier version")
        return self._append(before.data, None, f"back to {before.n}")


def publish(table: VersionedTable, staged: DataFrame, key: str, passed: bool) -> bool:
    """PUB-02: staged rows override published ones of their key, the rest stays; nothing happens unless the gates passed.

    The version before stays as the last known good one, for ``rollback``.
    """
    if not passed:
        return False
    clean = table.read()
    if clean is None:
        merged = staged
    else:
        rest = clean.join(staged.select(F.col(key).alias("_staged")).distinct(), F.col(key) == F.col("_staged"), "left_anti")
        merged = rest.unionByName(staged, allowMissingColumns=True)
    table.commit(merged, note="published")
    return True
