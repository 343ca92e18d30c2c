"""Ids that a stream has dealt with, in a few sorted segments whatever the number of micro-batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a level that are merged into one of the next, and ids that one file of a segment takes.
FAN, FILE_IDS = 4, 1_000_000
_NAME = re.compile(r"^(\d+)-(\d+)$")


class Ledger:
    """doc_id of the documents that micro-batches 0, 1, ... have processed, below `path`.

    A micro-batch adds a segment named for the range of batches it covers. FAN segments that cover as many batches each
    become one, so at most FAN - 1 of each size exist: 200 batches leave some ten, and an id is rewritten once a level. Only
    batches before the one at hand are merged, since they are committed: a batch that runs again finds what it found before,
    and replaces its own segment. A segment counts once it is written whole; the parts of a merged one go after that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def segments(self, batch: int) -> list[tuple[int, int]]:
        """The whole segments (first, last batch) of batches before `batch`, in order; those inside a larger one go."""
        found = []
        if self.files.exists(self.root):
            for entry in self.files.listStatus(self.root):
                m = _NAME.match(entry.getPath().getName())
                if m and int(m[2]) < batch and self.files.exists(self._at(f"{m[0]}/_SUCCESS")):
                    found.append((int(m[1]), int(m[2])))
        kept = [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found)]
        for s in set(found) - set(kept):
            self.files.delete(self._at(f"{s[0]}-{s[1]}"), True)
        return sorted(kept)

    def _write(self, ids: DataFrame, first: int, last: int) -> None:
        n = ids.count()
        # Sorted ranges, so that files of a large segment have bounds that tell them apart.
        dealt = ids.coalesce(1) if n <= FILE_IDS else ids.repartitionByRange(-(-n // FILE_IDS), "doc_id")
        dealt.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{self.path}/{first}-{last}")

    def read(self, segments: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema("doc_id long").parquet(*[f"{self.path}/{a}-{b}" for a, b in segments])

    def before(self, batch: int) -> DataFrame | None:
        """The ids of batches before `batch`, None without any. Merges segments where FAN of a size lie side by side."""
        segments = self.segments(batch)
        at = len(segments) - FAN
        while at >= 0:
            run = segments[at : at + FAN]
            if len({b - a for a, b in run}) == 1 and all(x[1] + 1 == y[0] for x, y in zip(run, run[1:], strict=False)):
                merged = (run[0][0], run[-1][1])
                self._write(self.read(run), *merged)
                for a, b in run:
                    self.files.delete(self._at(f"{a}-{b}"), True)
                segments[at : at + FAN] = [merged]
                at = len(segments) - FAN
            else:
                at -= 1
        return self.read(segments) if segments else None

    def add(self, ids: DataFrame, batch: int) -> None:
        """Adds the segment of `batch`."""
        self._write(ids.select(F.col("doc_id").cast("long").alias("doc_id")), batch, batch)


__all__ = ["FAN", "Ledger"]
