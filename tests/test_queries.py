"""Every query of the curve domain against its oracle, or for rows and a stable schema where it has none."""

import pytest

from ridgeline.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, con, name):
    oracle.same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0


def test_curve_mix_has_a_partner_for_every_curve(spark, tmp_path):
    spark.read.parquet(f"{oracle.DATA}/events.parquet").where("user_id IN (3, 7, 8, 12)").write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.QUERIES["curve_mix"](spark, str(tmp_path)).groupBy("curve_id", "partner").count().collect()
    assert sorted(map(tuple, out)) == [(3, 7, 200), (7, 8, 200), (8, 12, 200), (12, 3, 200)]
