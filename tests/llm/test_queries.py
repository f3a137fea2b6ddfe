"""Queries of this subpackage against their oracles, and accuracy of those that predict."""

import pytest

from ridgeline.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, name):
    oracle.same(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLES[name])


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").where("lang IS NOT NULL")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 100 and right >= 0.97 * n
