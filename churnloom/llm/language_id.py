"""Language by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled texts, a table of languages x buckets at most per task and
in all. The matrix of log probabilities is broadcast; a batch of texts is a sparse matrix of n-grams, kept as
lists of buckets, that is multiplied with one language's log probabilities after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import per_batch, remainder, ship

BUCKETS = 1 << 14
SIZES = (2, 3)
SLICE = 1 << 19  # characters hashed at once
DIVISOR, HELD_OUT = 4, 2
NONE = "und"


class Grams:
    """Buckets of the n-grams of a text; all that is not a letter counts as a space."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def codes(self, text: str) -> np.ndarray:
        """Code points in lower case, one space around; empty if there is no letter."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
        is_letter = self.letter[codes]
        if not is_letter.any():
            return codes[:0]
        codes = np.where(is_letter, codes, 32)
        return codes[(codes != 32) | np.append(True, codes[:-1] != 32)]

    def buckets(self, codes: np.ndarray):
        for at in range(0, len(codes), SLICE):
            part = codes[at:at + SLICE + max(SIZES) - 1].astype(np.uint64)
            for size in SIZES:
                n = min(len(part) - size + 1, SLICE)
                if n > 0:
                    key = np.full(n, size, np.uint64)
                    for i in range(size):
                        key = (key + part[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
                    yield (key >> np.uint64(50)).astype(np.int32)


def _count(batches):
    grams, sums, rows = Grams(), {}, {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang not in sums:
                sums[lang], rows[lang] = np.zeros(BUCKETS, np.int64), 0
            rows[lang] += 1
            for found in grams.buckets(grams.codes(text)):
                sums[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, n in sums.items():
        used = np.flatnonzero(n)
        # Bucket -1 counts the documents.
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(n[used], rows[lang]))],
            ["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log probabilities, from ``lang, text`` without nulls."""
    counts = (labelled.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    langs = sorted(set(counts["lang"]))
    table = np.zeros((len(langs), BUCKETS + 1))
    rows = np.fromiter(map({x: i for i, x in enumerate(langs)}.__getitem__, counts["lang"]), int, len(counts["lang"]))
    table[rows, counts["bucket"]] = counts["n"]
    docs, grams = table[:, -1], table[:, :-1] + 0.5
    prior = np.log((docs + 1) / (docs.sum() + max(len(langs), 1)))
    return langs, prior, np.log(grams / grams.sum(1, keepdims=True))


def log_scores(texts: list[np.ndarray], grams: Grams, prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of prior and likelihood, texts (code points) x languages.

    Pieces of texts are multiplied together, ``SLICE`` n-grams or somewhat more at once; a sum depends on its own text only.
    """
    out = np.tile(prior, (len(texts), 1))
    found, owners, size = [], [], 0

    def multiply():
        piece, buckets = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        for k, row in enumerate(logs):
            np.add.at(out[:, k], owners, np.bincount(piece, row[buckets], len(found)))

    for owner, codes in enumerate(texts):
        for buckets in grams.buckets(codes):
            found.append(buckets)
            owners.append(owner)
            size += len(buckets)
            if size >= SLICE:
                multiply()
                found, owners, size = [], [], 0
    if found:
        multiply()
    return out


def _score(model):
    def work():
        langs, prior, logs = model.value
        grams = Grams()

        def each(batch):
            texts = [grams.codes(text or "") for text in batch.column(1).to_pylist()]
            found, scores = [NONE] * len(texts), np.zeros(len(texts))
            if langs:
                total = log_scores(texts, grams, prior, logs)
                best, known = total.argmax(1), np.array([len(codes) > 0 for codes in texts], bool)
                found = [langs[k] if any_letter else NONE for k, any_letter in zip(best.tolist(), known, strict=True)]
                scores = np.where(known, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

        return each

    return work


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Learned from rows with text and ``lang`` that are not held out; ``score`` is the posterior probability of the
    language. A text that is null or has no letter is ``und`` with score 0, and so is every text if there is
    nothing to learn from. A null id is neither held out nor learned from. Equal scores go to the
    first language by name. Repeated rows are scored each. Other columns are not read. An empty
    table gives an empty one.
    """
    learned = docs.where((remainder(doc_id, DIVISOR) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(fit(learned.select(F.col(lang).alias("lang"), F.col(text).alias("text"))))
    given = docs.select(F.struct(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(remainder(doc_id, DIVISOR) == HELD_OUT, F.lit(False)).alias("held_out")).alias("row"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return per_batch(given, _score(model), f"row struct<doc_id: {kind}, held_out: boolean>, lang_pred string, score double") \
        .select("row.*", "lang_pred", "score")


ship(__name__)
