"""Repeated lines, found as overlapping windows of three lines.

A window is three consecutive lines that hold words; a document with fewer such lines is one window.
Windows are told apart by 128 bits of hashes. Of every window that occurs twice or more the first
occurrence, by id and place, stays; lines covered by any other occurrence go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.plans.stages import cut

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"
TRIMMED = " \t\x0b\x0c\r"


def windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, nth, x, y, lines``: each window's hashes and the places of its lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, at: F.struct(
        at.alias("at"), F.rlike(line, F.lit(HAS_WORD)).alias("solid"), F.btrim(line, F.lit(TRIMMED)).alias("line")))
    solid = F.transform(F.filter(lines, lambda x: x.solid), lambda x: F.struct(
        x["at"].alias("at"), F.xxhash64(x["line"]).alias("x"), F.xxhash64(x["line"], F.lit(1)).alias("y")))
    hashed = (docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), solid.alias("solid"))
              .where(F.size("solid") > 0)
              .select("doc_id", "text_hash", F.col("solid.at").alias("at"), F.col("solid.x").alias("xs"),
                      F.col("solid.y").alias("ys")))

    def part(column, i):
        return F.slice(column, i + 1, WINDOW)

    made = F.transform(F.sequence(F.lit(0), F.greatest(F.size("at") - WINDOW, F.lit(0))), lambda i: F.struct(
        i.alias("nth"), F.xxhash64(part(F.col("xs"), i)).alias("x"), F.xxhash64(part(F.col("ys"), i)).alias("y"),
        part(F.col("at"), i).alias("lines")))
    return hashed.select("doc_id", "text_hash", F.explode(made).alias("w")).select("doc_id", "text_hash", "w.*")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines`` (lines with words), ``n_removed`` and ``clean_text``.

    Lines are compared without white space at their ends. Blank lines stay. A null text stays null, has no
    lines and loses none. Rows that agree in id and text count as one occurrence and lose the same lines;
    rows with one id and different texts are ordered by a hash. Null ids come first. Columns named as
    a new one are replaced. An empty table gives an empty one.
    """
    found = cut(windows(docs, text, doc_id), "windows")
    place = F.struct("doc_id", "text_hash", "nth")
    repeated = cut(found.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                   .where(F.col("first") != F.col("last")).select("x", "y", "first"), "repeated")
    later = (found.join(repeated, ["x", "y"]).where(~F.equal_null(place, F.col("first")))
             .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("removed"))
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                     F.array_distinct("removed").alias("removed")))
    new = ["n_lines", "n_removed", "clean_text"]
    given = docs.select(F.struct(*(c for c in docs.columns if c.lower() not in new)).alias("row"),
                        F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_text_hash"))
    joined = given.join(later, F.equal_null("_doc", "_id") & (F.col("_text_hash") == F.col("_hash")), "left")
    split = joined.select("row", "_text", F.split("_text", "\n", -1).alias("lines"), "removed")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    n_lines = F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(HAS_WORD))))
    return split.select(
        "row.*",
        F.when(F.col("_text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_at
  FROM documents),
solid AS (
  SELECT doc_id, line_at, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS a
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id) AS n, a,
         lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c,
         [line_at, lead(line_at, 1) OVER w, lead(line_at, 2) OVER w] AS places
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY line_at)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, nth) AS occurrence
  FROM windows WHERE nth <= greatest(n - 2, 1)),
removed AS (
  SELECT DISTINCT doc_id, unnest(places) AS line_at FROM ranked WHERE occurrence > 1),
counts AS (SELECT doc_id, count(line_at) AS n FROM removed WHERE line_at IS NOT NULL GROUP BY doc_id),
left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_at) AS clean_text
  FROM lines l ANTI JOIN (SELECT * FROM removed WHERE line_at IS NOT NULL) r
    ON l.doc_id = r.doc_id AND l.line_at = r.line_at
  GROUP BY l.doc_id)
SELECT d.doc_id,
       coalesce((SELECT max(n) FROM windows w WHERE w.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
       coalesce(c.n, 0)::BIGINT AS n_removed,
       CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(o.clean_text, '') END AS clean_text
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN left_over o ON o.doc_id = d.doc_id
"""
