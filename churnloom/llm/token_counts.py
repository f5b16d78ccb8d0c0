"""Token counts without token ids.

The pieces of every distinct pre-token are counted once, in a table over the whole corpus.
Documents then only bring their pre-token frequencies to that table: its most frequent part
is bounded and is looked up where the text is read, what is left is joined by shuffling. With
words being as uneven as they are, few frequencies travel.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.bpe import PreTokenizer
from churnloom.llm.common import Memory, kept, parts, per_batch, ship
from churnloom.plans.stages import cut

# Bounds of the part of the piece table that is broadcast: 32 MB at most.
COMMON_ROWS = 65_536
COMMON_LENGTH = 256
# Distinct pre-tokens a task holds before it passes them on.
HELD = 250_000


def _tally(spec):
    """Pre-tokens and their number, of a task's texts."""
    def run(batches):
        tokens, words, found = kept("pre-tokenizer", spec.value, PreTokenizer), Counter(), Counter()

        def out():
            for word, n in words.items():
                for token in tokens.cut(word):
                    found[token] += n
            rows = pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pre_token", "n"])
            words.clear()
            found.clear()
            return rows

        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                plain, others = tokens.words(text)
                words.update(plain)
                found.update(others)
                if len(words) + len(found) > HELD:
                    yield out()
        yield out()

    return run


def _pieces(spec):
    def work():
        tokens = kept("pre-tokenizer", spec.value, PreTokenizer)

        def each(batch):
            n = [len(tokens.ids(t)) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["pre_token", "n", "n_pieces"])

        return each

    return work


def piece_table(texts: DataFrame, spec) -> DataFrame:
    """``pre_token``, its number ``n`` in all ``texts`` (one column, not null) and its ``n_pieces``."""
    tally = texts.mapInArrow(_tally(spec), "pre_token string, n long")
    distinct = tally.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return cut(per_batch(distinct, _pieces(spec), "pre_token string, n long, n_pieces long"), "pieces")


def _frequencies(spec, common):
    rest = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))

    def work():
        tokens, known = kept("pre-tokenizer", spec.value, PreTokenizer), common.value

        def looked_up(pre_tokens):
            """Pieces of those in the common part, and the others."""
            others = [t for t in pre_tokens if t not in known]
            return sum(known[t] for t in pre_tokens if t in known), others

        of_word = Memory(lambda word: looked_up(tokens.cut(word)), 150_000)

        def one(text):
            words, odd = tokens.words(text)
            total, left = looked_up(odd)
            left = Counter(left)
            for word, n in words.items():
                pieces, others = of_word[word]
                total += n * pieces
                for token in others:
                    left[token] += n
            return total, [{"pre_token": t, "n": n} for t, n in left.items()]

        def each(batch):
            sums, rests = zip(*map(one, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.int64()), pa.array(rests, rest)], ["row", "common", "rest"])

        return each

    return work


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content is broadcast.
    A null or empty text has no bytes and no tokens. Repeated rows, also with one id, are
    counted row by row; ids may be null. Other columns are not read. Special strings inside a
    text are one token each, as by the library's default. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = piece_table(given.select("text"), spec)
    top = (pieces.where(F.length("pre_token") <= COMMON_LENGTH // 4)
           .orderBy(F.desc("n"), "pre_token").limit(COMMON_ROWS).select("pre_token", "n_pieces").toArrow())
    common = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in top.columns), strict=True)))

    # Rows are told apart by a number, as ids may repeat; it is written with them.
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                            F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = per_batch(numbered.select(F.struct("row", "doc_id", "n_bytes").alias("row"), "text"),
                        _frequencies(spec, common),
                        f"row struct<row: long, doc_id: {given.schema['doc_id'].dataType.simpleString()}, n_bytes: long>, "
                        "common long, rest array<struct<pre_token: string, n: long>>")
    counted = cut(counted.select("row.*", "common", "rest"), "frequencies")
    rest = counted.select("row", F.explode("rest").alias("f")).select("row", "f.pre_token", "f.n")
    sums = (rest.join(pieces.select("pre_token", "n_pieces"), "pre_token")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("others")))
    total = F.col("common") + F.coalesce("others", F.lit(0))
    return (counted.drop("rest").join(sums, "row", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))


ship(__name__)
