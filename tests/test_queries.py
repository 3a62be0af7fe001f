"""Every registered query with a SQL twin agrees with it on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["a09_variant_statistics", "j06_customer_prior", "j08_seller_prior_outcomes", "p16_import_validate", "a02_rollup_payments",
          "e24_ks_wasserstein", "k03_stratified_equal_allocation", "p02_nfc"]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, _, note = compare(connect(SF), spark, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok or name not in entry.oracle_sql(), note
