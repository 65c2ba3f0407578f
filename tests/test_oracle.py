"""Registered queries against their SQL oracles on the smallest tables."""

import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from palisade.plans import registry

FOLDER = "/root/testdata/sf0.001"
# one or two per family; `check_oracles.py` runs all of them
CHOSEN = """
q1_search_name q10_dashboard_edges a1_graph_summary a2_table_access_counts a3_orphaned_tables a7_f6_sensitivity x3_code_using_dependency
x5_database_permissions g1_reach f3_edge_ids h7_a6_open_candidates m1_metadata_updates m6_m8_compliance_export s7c_ecs_edges s7i_sso_edges
s8_okta_edges j2_function_to_table j3_dockerfile_to_image_repo j7_dns_to_front_door j12_role_trust s2a_grant_edges m11_foreign_keys_postgres
s9_lock_edges f13_f18_function_tags f26_postgres_indexes
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_of_the_graph_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["urn", "depth", "node_type", "bucket", "label", "tags", "cve_ids"]
