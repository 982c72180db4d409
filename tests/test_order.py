"""Final orders that the jobs promise (O01, O02): rows come back sorted, nulls first."""

from stepwise import demo_queries as Q

SF = "/root/testdata/sf0.001"


def keys(df, *cols):
    return [tuple((r[c] is not None, r[c]) for c in cols) for r in df.collect()]


def test_sequence_gaps_come_by_unit_and_time(spark):
    got = keys(Q.q_sequence_gaps(spark, SF), "id_block", "this_end")
    assert len(got) > 10 and got == sorted(got)


def test_label_audit_comes_by_label_and_reason(spark):
    got = keys(Q.q_label_audit(spark, "/root/testdata/sf0.01"), "theoretical_label", "mistake")
    assert len(got) > 3 and got == sorted(got)


def test_thickness_comes_by_parent_layer_and_time(spark):
    got = keys(Q.q_thickness_report(spark, SF), "parent_id_block", "layer", "data_collection_complete_date")
    assert len(got) > 3 and got == sorted(got)


def test_cycle_time_comes_by_period_and_segment(spark):
    got = keys(Q.q_cycle_time_report(spark, SF), "period_rank", "segment_rank")
    assert got == sorted(got)
