"""Line-first cleaning.

Each line is judged on its own: by punctuation (symbols, shouting, how it ends), as navigation, as
boilerplate. Failing lines are removed, and a document that loses too much of its text is
rejected, as is one that is too short or repeats itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import per_batch, ship

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# What a document needs before its lines count.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of its words
# Per cent of its characters that a document may lose with its lines.
MOST_LOST = 30

SEPARATORS = re.compile(r"(?:^|\s)[|»›•·>](?=\s|$)")
# Each phrase with a part of it that is quick to look for.
BOILERPLATE = {
    "rights reserved": r"all rights reserved", "copyright": r"copyright (?:\(c\)|©|\d{4})", "©": r"©\s*\d{4}",
    "licen": r"licen[sc]ed under|under the \w+ licen[sc]e", "terms of": r"terms of (?:use|service)",
    "privacy": r"privacy policy", "cookie": r"(?:accept|our|uses?) cookies|cookie (?:policy|settings)",
    "subscribe": r"subscribe (?:to|now)", "sign ": r"sign (?:in|up)\b", "click": r"click here",
    "read more": r"read more", "share ": r"share (?:on|this)", "javascript": r"enable javascript",
}
BOILERPLATE = {part: re.compile(phrase) for part, phrase in BOILERPLATE.items()}
LONGEST_BOILERPLATE = 30  # words of a line
ENDS = re.compile("[.!?:;…。！？]")


def line_fault(line: str, parts: list[str]) -> str | None:
    """Why a line with words is removed; None if it stays. ``parts``: of boilerplate, that may be in it."""
    words = line.split()
    symbols = sum(map(line.count, SYMBOLS))
    if symbols or any(c in line for c in "»›•·"):
        bars = len(SEPARATORS.findall(line))
        if bars >= 2 and 5 * bars >= len(words) - bars:
            return "navigation"
        if symbols * 10 > sum(map(len, words)):
            return "punctuation"
    if len(words) >= 3 and 2 * line.count("!") >= len(words):
        letters = [c for c in line if c.isalpha()]
        if len(letters) >= 10 and sum(map(str.isupper, letters)) * 10 > 6 * len(letters):
            return "punctuation"
    if parts and len(words) <= LONGEST_BOILERPLATE:
        lower = line.lower()
        if any(BOILERPLATE[part].search(lower) for part in parts):
            return "boilerplate"
    if len(words) >= 8 and ENDS.search(line) is None:
        return "punctuation"
    return None


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    code = defaultdict(count().__next__)
    codes = np.fromiter(map(code.__getitem__, words), np.int64, n)
    pairs = codes[:-1] * len(code) + codes[1:]
    if len(code) > 1 << 20:  # three codes fit one number only after ranking pairs
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(code) + codes[2:]
    ordered = np.sort(windows)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
    again = often[which] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i:n - 2 + i] |= again
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """Counts of a text, whether it fails them, whether it is kept, and what is left of it."""
    text = text or ""
    words = text.encode().split()  # of bytes: at ASCII white space only
    had = _solid(text)
    lower = text.lower()
    parts = [part for part in BOILERPLATE if part in lower]
    seen, repeated_lines, stay, lost = set(), 0, [], 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            repeated_lines += line in seen
            seen.add(line)
            if line_fault(line, parts):
                lost += _solid(line)
                continue
        stay.append(line)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not failed and 100 * lost <= MOST_LOST * had
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), had, symbols, repeated_lines, repeated, failed, kept, "\n".join(stay)


def _solid(text: str) -> int:
    return len(text) - sum(map(text.count, WHITE))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def quality_rules(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and ``clean_text``, the text without failing lines.

    A null or empty text has no words: it fails. Blank lines stay. Rows are judged one by one, so
    repeated rows, null ids and further columns change nothing; columns of ``docs`` that have
    the name of a new one are replaced. An empty table gives an empty one. Without ``keep_text`` the
    text itself is left behind.
    """
    new = f"{COUNTS}, base_failed boolean, kept boolean, clean_text string"
    names = [x.split()[0] for x in new.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]
    others = [c for c in rest if c != text]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
    # The text goes to Python once and comes back only if it is wanted.
    given = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(text).alias("text"))

    def work():
        def each(batch):
            found = [pa.array(x, t) for x, t in zip(zip(*map(judge, batch.column(1).to_pylist()), strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1:1 + keep_text], *found],
                                              ["row", *["text"] * keep_text, *names])

        return each

    schema = given.select("row").schema.add("x", "string").simpleString()
    row = schema[len("struct<row:"):-len(",x:string>")]
    judged = per_batch(given, work, f"row {row}, {'text string, ' * keep_text}{new}")
    columns = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in rest if keep_text or c != text]
    return judged.select(*columns, *names)


ship(__name__)
