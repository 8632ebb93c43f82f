"""Registered queries against their SQL on the smallest data set. ``check_oracle.py`` compares all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, connect
from verification.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["s6_heartbeat_ingest", "p5a_canonical_user", "p12_policy_quality", "x1_inquiry", "x5_all_matches",
          "d7_org_keywords_by_join", "c1_detections", "c7_redacted_extended", "t5_audit_row", "a5_top_users",
          "a7_risk_summary", "a13_saved_logs_by_user", "m1_upsert_users", "m5_append_policies", "m_maintain_all",
          "r1_stream_screening_by_join", "r2_stream_suppress_repeats", "s2_stream_ingest", "s3_audit_sink",
          "a18_policies_of_account"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry(spark).count() > 0
