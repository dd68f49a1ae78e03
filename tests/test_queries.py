"""Every query with SQL beside an independent engine; the others for their rows."""

import pytest
from oracle import same

from strandlake.plans import analysis, calling, queries, training

ALL = [(m, n) for m in (queries, calling, analysis, training) for n in m.QUERIES]


@pytest.mark.parametrize(("module", "name"), [(m, n) for m, n in ALL if n in m.ORACLE_SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_same(spark, module, name):
    same(spark, module, name)


@pytest.mark.parametrize(("module", "name"), [(m, n) for m, n in ALL if n not in m.ORACLE_SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_rows(spark, module, name):
    assert module.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
