"""Named queries against their SQL twins.

By default a few per module run on the smallest tables; EPOCHWISE_ALL=1 runs all of them, and
``python oracle_check.py`` does the same on the larger tables.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
FEW = [
    "c4_valid_times", "e1_window_counts", "f6_merged_episodes", "d5_remove_epochs", "h2_key_comparison", "e11_fold_metrics", "e18_tukey_threshold",
    "e24_median_spectrum", "j8_welch_epoch_spectra", "k1_band_power", "l4_balanced_split", "a3_filtered_waveform_scan", "b8_append_unique",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("EPOCHWISE_ALL") else FEW)
def test_query(spark, name):
    got = queries()[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert compare(got, duck(SF).execute(sql).df()) == ""


def test_entry(spark):
    assert entry(spark).count() == 72


def test_every_sql_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
