"""Every query of the catalog against its SQL twin on the smallest tables; those without one must give rows."""

from pathlib import Path

import pytest
from oracle import mismatch

import __spark_entry__ as entry
from waymeter.catalog import all_entries

FOLDER = "/root/testdata/sf0.001"
ENTRIES = all_entries()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, name):
    run, query = ENTRIES[name]
    if query is None:
        assert run(spark, FOLDER).count() > 0
    else:
        assert mismatch(run(spark, FOLDER), FOLDER, query) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
