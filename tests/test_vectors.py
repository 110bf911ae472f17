"""Cells around centres against reading every vector."""

import numpy as np
import pytest

from veritrail.operators import search as S
from veritrail.operators import vectors as V
from veritrail.schema import TABLES


def table(spark, x):
    rows = [(f"d{i:04}", 0, "", "s", "r", "pr" if i % 7 == 0 else "page", "", None, None, "", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, TABLES["chunks"])


@pytest.mark.parametrize("kind", ["clusters", "uniform", "equal"])
def test_the_nearest_are_the_same(spark, tmp_path, kind):
    """Of clustered vectors most aren't read, of uniform ones of many dimensions nearly all are, and
    the rows are those of the whole scan, ties, filters that leave few and queries far off included."""
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(12, size=600)] * 10 + rng.normal(size=(600, 16))
    else:
        x = rng.normal(size=(600, 16)) if kind == "uniform" else np.ones((600, 16))
    chunks = table(spark, np.float32(x))
    cells = V.Cells.write(chunks, str(tmp_path / "cells"))
    asked = spark.createDataFrame([(1, [float(v) for v in x[5]]), (2, [0.0] * 16), (3, [500.0] * 16)], "query_id int, embedding array<float>")
    rows = lambda found: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    for k, where in ((12, None), (3, S.Filters(doc_type="pr")), (200, S.Filters(doc_type="pr"))):
        found, skipped = cells.nearest(asked.where("query_id = 1") if k == 12 else asked, k, where)
        want = S.knn(chunks, asked.where("query_id = 1") if k == 12 else asked, k, where)
        assert rows(found) == rows(want)
        assert kind != "clusters" or k != 12 or skipped > 0.7
        assert k != 200 or skipped == 0.0
    with pytest.raises(ValueError):
        cells.nearest(spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"))
    empty = V.Cells.write(chunks.limit(0), str(tmp_path / "none"))
    assert empty.nearest(asked)[0].count() == 0
