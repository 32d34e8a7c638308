"""Column functions over text: normalisation, tokens, symbol classes, log lines."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that matching of normalised text ignores: ASCII punctuation and space, CJK punctuation.
SKIPPED = "".join(c for c in string.punctuation if c not in "\"\\]") + " " + "，。、；：！？“”‘’（）《》【】—…"
TOKEN = r"[\p{L}\p{N}]+"

_CLASSES = (("[0-9]", 1), ("[A-F]", 2), ("[a-f]", 4), ("[G-Z]", 8), ("[g-z]", 16), ("[^0-9A-Za-z]", 32))


def contains_folded(text: Column, query: str) -> Column:
    """Case-insensitive literal containment; null text gives null."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def normalise(text: Column) -> Column:
    """Lower case without the skipped characters. If a text contains a query, its normal form contains the query's."""
    return F.translate(F.lower(text), SKIPPED, "")


def normalise_query(query: str) -> str:
    return query.lower().translate({ord(c): None for c in SKIPPED})


def tokens(text: Column) -> Column:
    """Words of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, query.lower())


def every_nth(items: Column, n: int) -> Column:
    """Items 1, n + 1, 2n + 1 ... counted from 0."""
    return F.filter(items, lambda _, i: i % n == F.lit(1 % n))


def phases(items: Column, n: int) -> Column:
    """The n subsequences of every n-th item, by phase."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.filter(items, lambda _, i: i % n == p))


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def type_mask(token: Column) -> Column:
    """Which symbol classes a token has, as bits: 0-9, A-F, a-f, G-Z, g-z, others."""
    return sum((F.when(token.rlike(pattern), bit).otherwise(0) for pattern, bit in _CLASSES), F.lit(0))


def type_mask_of(token: str) -> int:
    """``type_mask`` of a query string on the driver."""
    import re

    return sum(bit for pattern, bit in _CLASSES if re.search(pattern, token))


def file_tokens(text: Column, path: str) -> Column:
    """Tokens of the text by a tokenizer's file, which is sent to the executors."""
    import os

    from pyspark.sql import SparkSession

    SparkSession.getActiveSession().sparkContext.addFile(path)
    name, made = os.path.basename(path), []

    def f(column: pa.Array) -> pa.Array:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        if not made:
            made.append(Tokenizer.from_file(SparkFiles.get(name)))
        return pa.array([None if x is None else made[0].encode(x, add_special_tokens=False).tokens for x in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(f, "array<string>")(text)


def superset_masks(mask: int) -> list[int]:
    """All masks that have every class of ``mask``: tokens that may contain such a string."""
    return [m for m in range(64) if m & mask == mask]


def clean_line(line: Column) -> Column:
    """Without outer spaces, backslashes and NULs."""
    return F.trim(F.replace(F.replace(line, F.lit("\\"), F.lit("")), F.lit("\0"), F.lit("")))


def prefix_timestamp(line: Column, width: int, pattern: str, first: str = "2000-01-01", last: str = "2050-01-01") -> Column:
    """Timestamp in the line's first ``width`` characters; null if there is none in the window of validity."""
    ts = F.try_to_timestamp(F.substring(line, 1, width), F.lit(pattern))
    return F.when((ts >= F.lit(first).cast("timestamp")) & (ts < F.lit(last).cast("timestamp")), ts)


def line_contains(text: Column, query: str) -> Column:
    """Containment with a line break on both sides, so that a query can anchor at either end."""
    return F.contains(F.concat(F.lit("\n"), text, F.lit("\n")), F.lit(query))


def words(line: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def template(line: Column, hole: str = "<*>") -> Column:
    """The line's words with a hole for each that has a digit."""
    return F.array_join(F.transform(words(line), lambda w: F.when(w.rlike("[0-9]"), F.lit(hole)).otherwise(w)), " ")


def variables(line: Column) -> Column:
    """The words that ``template`` leaves out."""
    return F.filter(words(line), lambda w: w.rlike("[0-9]"))


def occurrences(text: Column | str, part: Column) -> Column:
    """How often a part stands in the text, not overlapping."""
    text = F.lit(text) if isinstance(text, str) else text
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")
