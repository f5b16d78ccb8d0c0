"""Quality by votes of the nearest labelled documents in a latent space.

A document is a vector of hashed byte trigrams and a few shares that describe its style. The
latent space is a truncated singular value decomposition of a bounded sample of labelled documents; their
latent vectors are broadcast. Every document is projected and multiplied with all of them, in
blocks, and the nearest vote with their similarity. Those as similar as the last of the nearest vote too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import per_batch, received, remainder, send, ship

# Labelled documents learned from, of each label: those with the smallest hash of their id.
SAMPLE = 1500
GRAMS = 2048
STYLE = 7
STYLE_WEIGHT = 0.5
LATENT = 64
NEIGHBOURS = 25
AS_SIMILAR = 1e-6  # cosines that far apart are taken as equal
BLOCK = 512
SLICE = 1 << 20
DIVISOR, HELD_OUT = 3, 1

SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~_=@]")


def style(text: str) -> list[float]:
    """Shares of symbols, bars, exclamation marks, capitals, digits, repeated words and repeated pairs."""
    words = text.split()
    n = max(len(text), 1)
    capitals = sum(map(str.isupper, words)) / max(len(words), 1)
    digits = sum(map(text.count, "0123456789"))
    pairs = max(len(words) - 1, 1)
    # The number of different words grows with the root of a text, so is the share of repeated ones levelled.
    repeated = 1 - min(1.0, len(set(words)) / max(3 * len(words) ** 0.6, 1))
    repeated_pairs = 1 - len(set(zip(words, words[1:], strict=False))) / pairs if len(words) > 1 else 0.0
    return [min(1.0, 5 * len(SYMBOL.findall(text)) / n), min(1.0, 10 * text.count("|") / n), min(1.0, 10 * text.count("!") / n),
            capitals, min(1.0, 5 * digits / n), repeated, repeated_pairs]


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), GRAMS + STYLE), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        if len(data) < 3:
            continue
        counts = np.zeros(GRAMS, np.int64)
        for at in range(0, len(data) - 2, SLICE):
            part = data[at:at + SLICE + 2].astype(np.uint32)
            key = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)
            counts += np.bincount((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=GRAMS)
        row[:GRAMS] = np.sqrt(counts / counts.sum())
        row[GRAMS:] = style(text)
    return out


class Space:
    """Weights of the features and the directions kept of them."""

    def __init__(self, sample: np.ndarray, dims: int = LATENT):
        present = (sample > 0).mean(0)
        self.weights = np.log((1 + 1) / (present + 1e-3)).astype(np.float32).clip(0.2, 4)
        self.weights[GRAMS:] = STYLE_WEIGHT * self.weights[:GRAMS].mean()
        scaled = sample * self.weights
        self.mean = scaled.mean(0) if len(sample) else np.zeros(GRAMS + STYLE, np.float32)
        scaled = scaled - self.mean
        dims = min(dims, *scaled.shape)
        basis = np.random.default_rng(0).standard_normal((scaled.shape[1], dims + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            basis = np.linalg.qr(scaled.T @ (scaled @ basis))[0]
        _, spread, right = np.linalg.svd(scaled @ basis, full_matrices=False)
        dims = min(dims, int((spread > 1e-4 * spread[0]).sum()) if len(spread) else 0)  # only those in which the sample varies
        self.directions = (basis @ right[:dims].T).astype(np.float32)

    def project(self, found: np.ndarray) -> np.ndarray:
        """Latent vectors of length one; zero for a text without features."""
        latent = (found * self.weights - self.mean) @ self.directions
        latent[~found.any(1)] = 0
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The space, latent vectors and labels of at most ``sample`` documents of each label."""
    usable = labels.where((remainder("doc_id", DIVISOR) != HELD_OUT) & F.col("label").isin(0, 1)).distinct()
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]

    def work():
        def each(batch):
            found = features(batch.column(2).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "label", "found"])

        return each

    # At most 2 * sample ids: the broadcast and what comes back are bounded by it. Features, not texts, are ordered.
    texts = docs.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").where(F.col("text").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = per_batch(texts.select("doc_id", "label", "text"), work, f"doc_id {kind}, label int, found binary")
    made = made.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "found").limit(2 * sample)
    rows = made.select("label", "found").toArrow()
    found = np.frombuffer(b"".join(rows.column("found").to_pylist()), np.float32).reshape(-1, GRAMS + STYLE)
    given = np.array(rows.column("label").to_pylist(), np.float32)
    if not len(given):
        return None
    space = Space(found)
    return space, space.project(found), given


def votes(similar: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Mean label of the nearest, weighted by similarity; the mean of all where nothing is similar."""
    last = max(similar.shape[1] - NEIGHBOURS, 0)
    least = np.partition(similar, last, axis=1)[:, last, None]
    weight = np.where(similar >= least - AS_SIMILAR, similar, 0).clip(0).astype(np.float64) ** 4
    total = weight.sum(1)
    found = weight @ given / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, found, given.mean()), 0, 1)


def _score(model):
    def work():
        fitted = received(model)

        def each(batch):
            scores = []
            texts = batch.column(1)
            for at in range(0, len(texts), BLOCK):
                part = texts.slice(at, BLOCK).to_pylist()
                if fitted is None:
                    scores += [0.5] * len(part)
                else:
                    space, vectors, given = fitted
                    scores += votes(space.project(features(part)) @ vectors.T, given).tolist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

        return each

    return work


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                       label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    ``labels`` has ``doc_id`` and a label of 0 or 1; other labels and null ids are not learned from. A null text is
    an empty one; texts of less than three bytes have no features and get the mean label of the
    sample. Without labelled documents every score is 0.5. Repeated rows are scored each; an id labelled
    twice counts with both labels. Neighbours within 1e-6 of the cosine of the 25th all vote. Other columns are not read. An empty table gives an empty one.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fitted = fit(given, labels.select("doc_id", F.col(label).cast("int").alias("label")), sample)
    model = send(docs.sparkSession, fitted)
    held_out = F.coalesce(remainder("doc_id", DIVISOR) == HELD_OUT, F.lit(False)).alias("held_out")
    kind = given.schema["doc_id"].dataType.simpleString()
    scored = per_batch(given.select(F.struct("doc_id", held_out).alias("row"), "text"), _score(model),
                       f"row struct<doc_id: {kind}, held_out: boolean>, score double")
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship(__name__)
