import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from palisade.session import local_session  # noqa: E402
from palisade.sources.graph_json import from_rows  # noqa: E402

ORG = "00000000-0000-0000-0000-0000000000aa"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_graph(spark):
    """``make_graph([(urn, type, {meta}, parent?)], [(from, to, type, {meta}?)])``."""

    def build(nodes, edges=()):
        node_rows = [(n[0], ORG, n[3] if len(n) > 3 else None, n[1], json.dumps(n[2]), i) for i, n in enumerate(nodes)]
        edge_rows = [(f"e{i}", ORG, e[0], e[1], e[2], json.dumps(e[3] if len(e) > 3 else {}), i) for i, e in enumerate(edges)]
        frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).withColumn("metadata", F.parse_json("metadata"))
        return from_rows(
            frame(node_rows, "urn string, organization_id string, parent_urn string, node_type string, metadata string, ord bigint"),
            frame(edge_rows, "uuid string, organization_id string, from_urn string, to_urn string, edge_type string, metadata string, ord bigint"),
        )

    return build


def pairs(edges, *keys):
    """Sorted ``(from, to, metadata values...)`` tuples of an edge frame."""
    rows = edges.select("from_urn", "to_urn", *[F.col("metadata")[k].cast("string").alias(k) for k in keys]).collect()
    return sorted(tuple(r) for r in rows)
