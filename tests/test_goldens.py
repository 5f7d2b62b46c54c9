"""Every case of :mod:`goldens`: functions of single values, on arguments that take each branch."""

import pytest
from goldens import CASES, TREES
from pyspark.sql import functions as F

from obsidra.functions.elements import page_tree


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    given, value = CASES[name]
    n = len(given[0]) - 1
    rows = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(given)], ", ".join(["i int", *[f"a{k} string" for k in range(n)]]))
    if name in TREES:
        rows = rows.select("i", page_tree(F.col("a0")).alias("a0"))
    got = dict(rows.select("i", value(*[F.col(f"a{k}") for k in range(n)]).cast("string")).collect())
    assert [got[i] for i in range(len(given))] == [c[-1] for c in given]
