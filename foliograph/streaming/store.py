"""What a stream has written so far: parts by epoch, merged as they become many, behind a manifest.

A manifest is one small file per epoch that lists the parts to read; it appears by a rename, so a reader sees either the state before
an epoch or the one after it. An epoch that is run again after its manifest is there changes nothing. As soon as there
are ``FAN`` parts of a level they are merged into one of the next, so that a reader opens at most ``FAN`` - 1 parts of each level
however many epochs there were, and a row is rewritten once per level. Folders that only old manifests name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 8
KEPT = 3  # manifests, for readers that still use an older one


class EpochStore:
    """The parts below ``folder``; ``merge`` folds a union of parts into fewer rows of the same columns.

    With ``fold`` the rows of an epoch are merged before they are written, for streams that tell a key more than once an epoch.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] | None = None, fold: bool = False):
        self.spark, self.folder, self.merge, self.fold = spark, folder.rstrip("/"), merge or (lambda df: df), fold
        self._files = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._files.Path(f"{self.folder}/{name}" if name else self.folder)

    def _manifests(self) -> list[str]:
        place = self._path("manifests")
        found = self._fs.listStatus(place) if self._fs.exists(place) else []
        return sorted(name for name in (f.getPath().getName() for f in found) if name.endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"manifests/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The newest manifest: epoch, schema, parts (level and folder) and whether each part was merged when it was written."""
        names = self._manifests()
        return self._load(names[-1]) if names else {"epoch": -1, "schema": None, "parts": [], "folded": True}

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['epoch']:012d}.json"
        draft = self._path(f"manifests/{name}.draft")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        self._fs.rename(draft, self._path(f"manifests/{name}"))

    def _expire(self) -> None:
        *old, oldest = self._manifests()[: -KEPT + 1] or [None]
        if not old:
            return
        kept = {part for name in self._manifests() if name >= oldest for _, part in self._load(name)["parts"]}
        for name in old:
            for _, part in self._load(name)["parts"]:
                if part not in kept:
                    self._fs.delete(self._path(part), True)
            self._fs.delete(self._path(f"manifests/{name}"), False)

    def _parts(self, parts: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts])

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Add the rows of an epoch; for ``foreachBatch``."""
        now = self.current()
        if epoch <= now["epoch"]:
            return
        name = f"parts/epoch-{epoch}"
        rows = self.merge(batch) if self.fold else batch
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        parts, level = [*now["parts"], [0, name]], 0
        while len(full := [p for at, p in parts if at == level]) >= FAN:
            merged = f"parts/level-{level + 1}-{epoch}"
            self.merge(self._parts(full, batch.schema)).write.mode("overwrite").parquet(f"{self.folder}/{merged}")
            parts = [p for p in parts if p[0] != level] + [[level + 1, merged]]
            level += 1
        folded = self.fold and now.get("folded", False)
        self._commit({"epoch": epoch, "schema": batch.schema.jsonValue(), "parts": parts, "folded": folded})
        self._expire()

    def read(self, schema: StructType | None = None) -> DataFrame:
        """The merged rows of all epochs; ``schema`` is that of a store that nothing was written to yet."""
        now = self.current()
        if not now["parts"]:
            return self.spark.createDataFrame([], schema)
        rows = self._parts([p for _, p in now["parts"]], StructType.fromJson(now["schema"]))
        return rows if len(now["parts"]) == 1 and now.get("folded", False) else self.merge(rows)
