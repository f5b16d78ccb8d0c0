"""What the operators of this package share."""

from __future__ import annotations

import gc
import pickle
import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word, in Spark's and in DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


# Bytes of an Arrow batch worked on at once; Spark's batches have many rows, however long these are.
PART = 4 << 20


def ship(name: str) -> None:
    """Send the functions of module ``name`` to the workers as they are.

    Workers then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])


def send(spark: SparkSession, value):
    """Broadcast a value of a class that workers do not have; ``received`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def kept(name: str, key, make):
    """``make(key)``, kept by the worker from task to task as long as the key is the same."""
    held = sys.modules.setdefault("kept_by_worker", SimpleNamespace(values={})).values
    if held.get(name, (None,))[0] != key:
        held[name] = (key, make(key))
    return held[name][1]


def dropped(name: str) -> None:
    """Let the worker forget what it kept, for steps that do not need it and want its memory."""
    held = sys.modules.get("kept_by_worker")
    if held is not None and held.values.pop(name, None) is not None:
        gc.collect()


class Memory(dict):
    """Results of ``make`` by word; forgets all when ``full``, so that it stays bounded. Long words are not kept."""

    LONGEST = 64

    def __init__(self, make, full: int = 100_000):
        super().__init__()
        self.make, self.full = make, full

    def __missing__(self, word):
        found = self.make(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.full:
                self.clear()
            self[word] = found
        return found


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size."""
    for batch in batches:
        rows = max(1, batch.num_rows * PART // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
              schema: str) -> DataFrame:
    """Apply a function to every Arrow batch, in parts of bounded size; ``work()`` makes it, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        yield from map(each, parts(batches))

    return df.mapInArrow(run, schema)


def word_count(text: str = "text"):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


ship(__name__)
