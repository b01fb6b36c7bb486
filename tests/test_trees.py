"""Memory of the workers that read trees."""

import gc

from crawlscope.operators import dom
from pyspark.sql import functions as P


def test_trees_are_free_when_a_document_is_read():
    gc.collect()
    gc.disable()
    try:
        dom.read_document("<body>" + "<div><p>text</div>" * 50)
        assert not [o for o in gc.get_objects() if isinstance(o, dom.Node)]
    finally:
        gc.enable()


def test_tree_facts_come_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    dom.document_facts(P.col("html"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 128
