import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registry_and_oracles_line_up():
    qs, orc = E.queries(), E.oracle_sql()
    assert len(qs) >= 30
    assert set(orc) <= set(qs)


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["id_block", "end_time", "cored_time", "time_delay"]
    assert df.count() >= 0


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle_at_smoke_scale(spark, name):
    from tools.oracle_check import duck, rows_of

    sdf = E.queries()[name](spark, SF)
    s_cols, s_rows = rows_of(list(sdf.columns), [tuple(r) for r in sdf.collect()])
    cur = duck(SF).execute(E.oracle_sql()[name])
    d_cols, d_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows
    from tools.oracle_check import type_mismatches
    assert type_mismatches(sdf, duck(SF), E.oracle_sql()[name]) == []
