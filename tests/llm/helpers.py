from __future__ import annotations

import random

from pyspark.sql import functions as F

from resona.llm.tables import table


def documents(spark, rows):
    """(doc_id, text[, source]) rows with the columns of documents and two that clash with names the operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, score double")


def sample(spark, sf_dir, n=60):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").where(F.length("text") < 4000).orderBy("doc_id").limit(n)


def odd_rows():
    """Nulls, empties, repeats, blanks, a null id and a very long text."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    return [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, " \t\n "), (None, "one two three four five six"), (5, long), (6, "été à la plage\nété à la plage"), (7, "\n\n")]
