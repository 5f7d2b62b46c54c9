"""What bounds the memory and the time of work on many or long rows."""

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from obsidra.functions import documents, elements, text, vectors
from obsidra.plans import queries as plans


def test_parts_of_bounded_size():
    rows = pa.array(["x" * n for n in [10, 300_000, 5, 900_000, 2_000_000, 0, 7] * 3] + [None])
    got = list(vectors.parts((rows, pa.array(range(len(rows))))))
    assert pa.concat_arrays([p[0] for p in got]).equals(rows) and [i for p in got for i in p[1].to_pylist()] == list(range(len(rows)))
    assert all(len(p[0]) == 1 or p[0].nbytes + p[1].nbytes <= vectors.PART_BYTES for p in got) and len(got) > 3


def test_a_function_takes_parts_of_a_batch(spark):
    rows = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("y"), 50_000).alias("t"))
    seen = vectors.by_parts("int")(lambda a, b: pa.array([len(a)] * len(a), pa.int32()))
    got = rows.select("id", seen("t", "id").alias("n")).collect()
    assert [r["id"] for r in got] == list(range(400)) and max(r["n"] for r in got) <= vectors.PART_BYTES // 50_000


def test_values_unpacked_leave_in_parts(spark):
    run = vectors.by_values("binary")(lambda b: gzip.decompress(b)).func
    packed = gzip.compress(bytes(700_000))
    assert [len(out) for out in run(iter([pa.array([packed] * 5), pa.array([], pa.binary())]))] == [2, 2, 1]
    rows = spark.range(0, 60, 1, 1).select("id", F.encode(F.repeat(F.lit("z"), 60_000), "utf-8").alias("b"))
    got = rows.select(F.sum((documents.gunzipped(documents.gzipped(F.col("b"))) == F.col("b")).cast("int")), F.sum((text.decode_text(F.col("b"), F.lit("koi8-r")) == F.col("b").cast("string")).cast("int"))).first()
    assert tuple(got) == (60, 60)


def test_trees_by_columns_equal_trees_by_page():
    pages = ["<ul><li class=x id=1>a<li>b &amp; c</ul>", None, "", "text", "<p>1<p>2<table><tr><td>3<td>4</table>", "<br><i a='1' a='2'>x</i>tail", "<b>" * 600 + "deep"]
    got = elements.trees(pa.array(pages))
    assert got.type == elements.PAGE
    assert got.equals(pa.array([elements.tree(p) for p in pages], elements.PAGE))


def test_trees_are_made_in_parts(spark):
    """The plan of a tree column runs its parser over an iterator of batches."""
    from pyspark.util import PythonEvalType

    rows = spark.createDataFrame([("<p>x",)], "h string").select(elements.page_tree(F.col("h")).alias("t"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in rows._jdf.queryExecution().executedPlan().toString()


def test_heavy_rows_of_a_small_table_are_spread(spark):
    for name in "attributes_of_pages articles_bound products_of_pages items_of_pages breadcrumbs_of_pages quotes_aligned articles_of_pages page_digests page_hrefs".split():
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16, name
