from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns whose names the operators use inside.
EXTRA = ["id", "key", "value", "size", "n_tokens", "tokens", "hash", "lines", "removed", "spans", "block", "label", "grp", "__key", "__gone", "__removed", "__spans", "__quality", "__found", "__removed_lines", "p_quality", "drop_id"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and repeated ids, null, empty, blank and long texts, exact copies, and columns with clashing names."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
    base = "The first line of a document that others copy with more than thirteen words in it.\nA second line.\n\nA third line of the same document, long enough to count for something here."
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (6, long), (7, long + " end"), (8, "...!!!"), (9, "zwei Wörter"), (10, "zwei Wörter"), (11, "中文 texte\nA second line."), (12, "one"), (13, base + "\nAnd a tail of its own.")]
    rows = [(i, t, "en", "src", None if t is None else len(t), *(str(k) for k in range(len(EXTRA)))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(frame) -> list[tuple]:
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
