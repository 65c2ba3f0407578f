"""Stitchers: joins that link the domains of an ingested graph.

All stitchers read the same ingested graph and only add edges; none sees
another's output, so they are independent queries united at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.model import Graph, union_all
from palisade.operators.stitch import code, containers, identity, network
from palisade.operators.stitch.common import Stitcher

STITCHERS: dict[str, Stitcher] = {
    "orm_class_to_table": code.orm_class_to_table,
    "function_to_table": code.function_to_table,
    "dockerfile_to_image_repo": containers.dockerfile_to_image_repo,
    "dockerfile_to_entrypoint": containers.dockerfile_to_entrypoint,
    "rds_to_database": network.rds_to_database,
    "ecs_task_to_repository": containers.ecs_task_to_repository,
    "dns_to_front_door": network.dns_to_front_door,
    "gateway_to_balancer": network.gateway_to_balancer,
    "pool_to_service": network.pool_to_service,
    "person_to_sso_user": identity.person_to_sso_user,
    "sso_to_iam": identity.sso_to_iam,
    "role_trust": identity.role_trust,
}
RESOLVERS = {"security_groups": network.resolve_security_groups}


def register_stitcher(name: str, fn: Stitcher) -> None:
    """Add a user's stitcher: a function from a graph to an edge frame."""
    STITCHERS[name] = fn


def register_resolver(name: str, fn) -> None:
    RESOLVERS[name] = fn


def stitch(graph: Graph, sources: DataFrame | None = None, names: list[str] | None = None) -> Graph:
    """Run the stitchers and append their edges."""
    found = []
    for name, fn in STITCHERS.items():
        if names is not None and name not in names:
            continue
        found.append(fn(graph, sources) if fn is code.function_to_table else fn(graph))
    return graph.with_edges(union_all([graph.edges, *found])) if found else graph


def resolve(graph: Graph) -> Graph:
    for fn in RESOLVERS.values():
        graph = fn(graph)
    return graph
