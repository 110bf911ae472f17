"""Answers in prose from bundles, by a completion model that the caller supplies.

A bundle is a row (question, nodes, chains, gaps), so many are answered in one job: the prompt is
a native column over the row, the model an Arrow-batched column, and what it says is held
against the bundle by a native test of its citations.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cites

Complete = Callable[[str, str], str]
#: What the model is told besides a prompt.
TASK = (
    "Below are a question and a table of documents. Answer from the table alone. After each statement give the row it rests on, "
    "as [row]. Name what the rows don't tell. Write running text."
)


def prompt(question: Column, nodes: Column, chains: Column, gaps: Column) -> Column:
    """The text of a bundle: its documents as rows of a table, chains as row numbers (a document
    outside the table by its id), and gaps."""
    cell = lambda value: F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s*[\n|]\s*", " ")
    row = lambda n, i: F.concat_ws(" | ", (i + 1).cast("string"), *(cell(n[k]) for k in ("title", "role", "score", "url")))
    ids = F.transform(nodes, lambda n: n["node"])
    place = lambda x: F.array_position(ids, x)
    chain = lambda c: F.array_join(F.transform(c, lambda x: F.when(place(x) > 0, F.concat(F.lit("["), place(x), F.lit("]"))).otherwise(x)), " then ")
    parts = [
        F.array(question, F.lit(""), F.lit("row | title | role | score | address")),
        F.transform(nodes, row),
        F.transform(chains, lambda c: F.concat(F.lit("linked: "), chain(c))),
        F.transform(gaps, lambda g: F.concat(F.lit("missing: "), g)),
    ]
    return F.array_join(F.concat(*parts), "\n")


def completed(prompts: Column, complete: Complete, task: str = TASK) -> Column:
    """A column of the model's answers, null for null; the model is called once a prompt."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else complete(task, v) for v in values], dtype=object)

    return run(prompts)


def answered(bundles: DataFrame, complete: Complete, task: str = TASK) -> DataFrame:
    """``question, answer, grounded, sources`` for each bundle. ``grounded``: the answer cites rows
    of its bundle only, and some if there are any, none of them as a link; ``sources`` are the
    cited rows (row, title, url) in order. A null question gives a null answer that isn't grounded."""
    asked = bundles.select("question", "nodes", F.when(F.col("question").isNotNull(), prompt(*(F.col(c) for c in ("question", "nodes", "chains", "gaps")))).alias("prompt"))
    told = asked.select("question", "nodes", F.trim(completed(F.col("prompt"), complete, task)).alias("answer"))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[\s*(\d{1,9})\s*\]"), F.lit(1)), lambda x: x.cast("int"))))
    inside = F.filter(cited, lambda k: (k >= 1) & (k <= F.size("nodes")))
    listed = F.transform(inside, lambda k: F.struct(k.alias("row"), F.get("nodes", k - 1)["title"].alias("title"), F.get("nodes", k - 1)["url"].alias("url")))
    linked = F.regexp_like(F.col("answer"), F.lit(r"\[\s*\d+\s*\]\("))
    return told.select("question", "answer", F.coalesce(cites(F.col("answer"), F.size("nodes")) & ~linked, F.lit(False)).alias("grounded"), F.coalesce(listed, F.array().cast("array<struct<row:int,title:string,url:string>>")).alias("sources"))
