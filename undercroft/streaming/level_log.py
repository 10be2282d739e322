"""A log of mergeable results that stays small: batches add parts, and parts of one level merge into one of the next.

  <log>/parts/part=L<level>-…/…   rows, partitioned as the log says
  <log>/manifest/000000012       the parts that are the log now, and the last batch of each source in them
A manifest is written once and never changed; the highest one counts, so a part is in the log when its manifest is
there. Fewer than `fan` parts stand on a level, and a row is rewritten once for each level it climbs: after n batches a
reader opens some fan * log(n) parts. Parts that the last manifests do not name are removed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.sources import snapshots
from undercroft.sources.tables import write_table

#: Manifests whose parts are kept, for readers that started with them.
KEEP = 3


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    #: Names of the parts by level.
    levels: dict[int, list[str]] = field(default_factory=dict)
    #: The last batch of each source that the parts hold.
    sources: dict[str, int] = field(default_factory=dict)
    schema: str | None = None

    @property
    def parts(self) -> list[str]:
        return [p for level in sorted(self.levels) for p in self.levels[level]]

    def to_json(self) -> str:
        return json.dumps({"levels": self.levels, "sources": self.sources, "schema": self.schema})


@dataclass
class LevelLog:
    """Results under `path`. `merge` gives for rows of several parts the rows that stand for them all; it must not
    matter in which groups and in which order parts are merged."""

    spark: SparkSession
    path: str
    merge: Callable[[DataFrame], DataFrame]
    partition_by: Sequence[str] = ()
    fan: int = 8

    def _numbers(self) -> list[int]:
        return [int(n) for n in snapshots.child_names(self.spark, f"{self.path}/manifest") if n.isdigit()]

    def _manifest(self, number: int) -> Manifest:
        held = json.loads(snapshots.read_text(self.spark, f"{self.path}/manifest/{number:09d}"))
        return Manifest(number, {int(k): v for k, v in held["levels"].items()}, held["sources"], held["schema"])

    def manifest(self) -> Manifest:
        """The log as it is now; an empty one before the first batch."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else Manifest()

    def rows(self, manifest: Manifest | None = None) -> DataFrame:
        """Rows of all parts, not merged; the frame stays with its manifest while the log goes on."""
        manifest = manifest or self.manifest()
        if manifest.schema is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        return self._read(manifest.parts, manifest.schema)

    def merged(self, condition: F.Column | None = None) -> DataFrame:
        """One set of rows for everything in the log; a condition on partition columns prunes the parts' folders."""
        rows = self.rows()
        return self.merge(rows if condition is None else rows.where(condition))

    def _read(self, parts: Sequence[str], schema: str) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(schema))
        paths = [f"{self.path}/parts/part={p}" for p in parts]
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/parts").parquet(*paths).select(*fields.names)

    def holds(self, source: str, batch: int) -> bool:
        return self.manifest().sources.get(source, -1) >= batch

    def add(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Adds what one batch of a source gave; False if the log holds it already. Batches of a source have rising
        numbers, and one writer adds at a time (a second one fails).

        A batch that is cut short leaves a part that no manifest names; run again, it writes that part anew.
        """
        before = self.manifest()
        if before.sources.get(source, -1) >= batch:
            return False
        schema = before.schema or rows.schema.json()
        name = f"L0-{batch}-{hashlib.md5(source.encode()).hexdigest()[:8]}"
        self._write(rows, name)
        levels = {k: list(v) for k, v in before.levels.items()}
        levels.setdefault(0, []).append(name)
        level = 0
        while len(levels.get(level, [])) >= self.fan:
            group = levels.pop(level)
            name = f"L{level + 1}-{before.number + 1}"
            self._write(self.merge(self._read(group, schema)), name)
            levels.setdefault(level + 1, []).append(name)
            level += 1
        after = Manifest(before.number + 1, levels, before.sources | {source: batch}, schema)
        snapshots.write_text(self.spark, f"{self.path}/manifest/{after.number:09d}", after.to_json())
        self._clean()
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        if self.partition_by:
            rows = rows.hint("rebalance", *self.partition_by)
        write_table(rows, f"{self.path}/parts/part={name}", self.partition_by, only_written=False)

    def _clean(self) -> None:
        """Removes manifests beyond the kept ones, and parts that no kept one names: merged ones and broken drafts."""
        numbers = self._numbers()
        for number in numbers[:-KEEP]:
            snapshots.delete(self.spark, f"{self.path}/manifest/{number:09d}")
        live = {f"part={p}" for n in numbers[-KEEP:] for p in self._manifest(n).parts}
        for name in snapshots.child_names(self.spark, f"{self.path}/parts"):
            if name not in live:
                snapshots.delete(self.spark, f"{self.path}/parts/{name}")
