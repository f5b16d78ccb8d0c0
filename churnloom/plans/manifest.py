"""What has been built from which sources, for all applications that share a folder.

An entry is a small file ``manifest/<fingerprint>/<stage>.json`` in the shared folder. The fingerprint covers the source
files (path, size, time), the code of this package and the parameters, so a changed file, version or setting finds no
entry. An entry appears by renaming a finished file, after the stage it names was written in full. Stages are never changed;
those that no entry names are removed by ``sweep``.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom.plans.stages import shared_folder

DAY = 86_400


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path as it knows it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


@cache
def code_version() -> str:
    """Digest of the modules that marts and models are built by."""
    digest, pending = hashlib.sha256(), [resources.files("churnloom")]
    found = {}
    while pending:
        for item in pending.pop().iterdir():
            if item.is_dir() and item.name not in ("llm", "__pycache__"):
                pending.append(item)
            elif item.name.endswith(".py"):
                found[str(item)] = item.read_bytes()
    for name in sorted(found):
        digest.update(hashlib.sha256(found[name]).digest())
    return digest.hexdigest()


def sources_digest(spark: SparkSession, paths: list[str]) -> str:
    """Digest of path, size and time of every file below ``paths``; listed and summed up by Spark, contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    found = listed.agg(F.count("*"), F.sum("length"), F.bit_xor(one), F.sum(F.pmod(one, F.lit(1 << 31)))).first()
    return hashlib.sha256(json.dumps([paths, *found]).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """The entries of one source in one state."""

    spark: SparkSession
    source: str
    fingerprint: str

    @classmethod
    def of(cls, spark: SparkSession, source: str, paths: list[str], parameters=()) -> Manifest:
        parts = [sources_digest(spark, paths), code_version(), repr(parameters)]
        return cls(spark, source, hashlib.sha256("\n".join(parts).encode()).hexdigest())

    def _place(self, stage: str) -> str:
        return f"{shared_folder(self.spark)}/manifest/{self.fingerprint}/{stage}.json"

    def find(self, stage: str) -> dict | None:
        """The entry of a stage, or None if it was not built or its files are gone."""
        fs, place = _files(self.spark, self._place(stage))
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        fs, path = _files(self.spark, entry["path"])
        return entry if fs.exists(path) else None

    def publish(self, stage: str, path: str, **about) -> dict:
        """Name a finished stage. If another application was first, its stage is the one that counts."""
        entry = {"source": self.source, "fingerprint": self.fingerprint, "stage": stage, "path": path, "created": time.time(), **about}
        fs, place = _files(self.spark, self._place(stage))
        _, draft = _files(self.spark, f"{shared_folder(self.spark)}/manifest/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        fs.mkdirs(place.getParent())
        if self.find(stage) is None:
            fs.delete(place, False)
            fs.rename(draft, place)
        if fs.exists(draft):
            fs.delete(draft, False)
        return self.find(stage) or entry

    def table(self, stage: str) -> DataFrame | None:
        """A published table, with the schema it was written with."""
        entry = self.find(stage)
        return entry and self.read(entry)

    def read(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])


def _entries(spark: SparkSession) -> list[tuple[str, dict]]:
    """All entries with the place of each; one small file per published stage."""
    folder = f"{shared_folder(spark)}/manifest"
    fs, root = _files(spark, folder)
    if not fs.exists(root):
        return []
    found = fs.globStatus(_files(spark, f"{folder}/*/*.json")[1])
    places = [status.getPath().toString() for status in found]
    rows = spark.read.text(places, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value").collect() if places else []
    return [(row["at"], json.loads(row["value"])) for row in rows]


def sweep(spark: SparkSession, older_than: float = DAY) -> list[str]:
    """Remove entries that a newer state of their source has replaced, then stages without an entry; the paths of removed stages.

    Nothing younger than ``older_than`` seconds goes, as a running application may still read it.
    """
    limit = time.time() - older_than
    newest: dict[tuple[str, str], float] = {}
    entries = _entries(spark)
    for _, entry in entries:
        key = entry["source"], entry["stage"]
        newest[key] = max(newest.get(key, 0.0), entry["created"])
    named = set()
    for at, entry in entries:
        if entry["created"] < newest[entry["source"], entry["stage"]] and entry["created"] <= limit:
            fs, place = _files(spark, at)
            fs.delete(place, False)
        else:
            named.add(entry["path"].rsplit("/", 1)[-1])
    fs, stages = _files(spark, f"{shared_folder(spark)}/stages")
    removed = []
    for status in fs.listStatus(stages) if fs.exists(stages) else ():
        if status.getPath().getName() not in named and status.getModificationTime() / 1000 <= limit:
            fs.delete(status.getPath(), True)
            removed.append(status.getPath().toString())
    return removed
