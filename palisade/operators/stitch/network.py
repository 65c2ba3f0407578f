"""Network: databases on hosts (J5), names to front doors (J7), gateways to balancers (J8), pools to services (J9), groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import ids, meta, scalars
from palisade.model import Graph, union_all
from palisade.operators.stitch.common import STEP, index_by, last_by, new_edges

PLACEHOLDER = ":unknown/sg/"


def rds_to_database(graph: Graph) -> DataFrame:
    """``hosts`` edges where an instance endpoint is a database's host."""
    nodes = graph.nodes
    instances = index_by(nodes, "rds_endpoint", "rds_urn").withColumnRenamed("rds_endpoint", "host")
    return new_edges(
        instances.join(index_by(nodes, "host", "db_urn"), "host"), "hosts", 5, "rds_urn", "db_urn", F.lit(0),
        detection_method="endpoint_match", confidence=1.0,
    )


def dns_to_front_door(graph: Graph) -> DataFrame:
    """``resolves_to`` edges; balancers register first, then gateways, the last of a name wins."""
    balancers, gateways = graph.of_type("load_balancer"), graph.of_type("api_gateway")
    named = lambda df, rank: df.select(
        meta.get(df, "lb_dns_name").alias("name"), F.col("urn").alias("door_urn"), F.struct(F.lit(rank), "ord", F.lit(-1)).alias("order")
    )
    domains = gateways.select(
        "urn", "ord", F.posexplode(meta.get(gateways, "api_gw_custom_domains")).alias("pos", "name")
    ).select("name", F.col("urn").alias("door_urn"), F.struct(F.lit(1), "ord", "pos").alias("order"))
    doors = named(balancers, 0).filter("name <> ''").union(named(gateways, 1).filter("name <> ''")).union(domains)
    by_name = last_by(doors.withColumn("key", scalars.dns_key(F.col("name"))), ["key"], "door_urn", "order")
    records = graph.of_type("dns_record")
    values = records.select("urn", "ord", F.posexplode(meta.get(records, "dns_values")).alias("pos", "value"))
    linked = values.withColumn("key", scalars.dns_key(F.col("value"))).join(by_name, "key")
    return new_edges(
        linked.withColumnRenamed("urn", "dns_urn"), "resolves_to", 7, "dns_urn", "door_urn", F.col("ord") + F.col("pos"),
        detection_method="dns_alias_match", confidence=1.0,
    )


def gateway_to_balancer(graph: Graph) -> DataFrame:
    """``routes_to`` edges; per integration URI the first balancer whose listener path it contains.

    "The URI contains ``listener/`` + path" means some text following a
    ``listener/`` starts with the path.  All prefixes of those texts are
    hash-joined with the paths: URIs are short, and no pair is tried in vain.
    """
    balancers = graph.of_type("load_balancer")
    arn = meta.get(balancers, "arn")
    paths = balancers.filter(arn.contains("loadbalancer/")).select(
        arn.alias("arn"), F.col("urn").alias("lb_urn"), "ord",
        F.regexp_extract(arn, r"(?s)^.*?loadbalancer/(.*)$", 1).alias("path"),
    )
    # a repeated ARN keeps its first place but its last URN
    by_arn = paths.groupBy("arn", "path").agg(F.max_by("lb_urn", "ord").alias("lb_urn"), F.min("ord").alias("lb_ord"))
    gateways = graph.of_type("api_gateway")
    uris = gateways.select("urn", "ord", F.posexplode(meta.get(gateways, "api_gw_integration_uris")).alias("pos", "uri"))
    tails = uris.select(
        "urn", "ord", "pos",
        F.explode(F.transform(
            F.filter(F.sequence(F.lit(1), F.length("uri")), lambda i: F.substr(F.col("uri"), i, F.lit(9)) == "listener/"),
            lambda i: F.substr(F.col("uri"), i + 9),
        )).alias("tail"),
    )
    prefixes = tails.select(
        "urn", "ord", "pos",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("tail")), lambda n: F.substr(F.col("tail"), F.lit(1), n))).alias("path"),
    ).distinct()
    first = (
        prefixes.join(by_arn, "path").groupBy("urn", "pos", "ord").agg(F.min_by("lb_urn", F.struct("lb_ord", "arn")).alias("lb_urn"))
    )
    return new_edges(
        first.withColumnRenamed("urn", "gw_urn"), "routes_to", 8, "gw_urn", "lb_urn", F.col("ord") + F.col("pos"),
        detection_method="apigw_integration_match", confidence=1.0,
    )


def pool_to_service(graph: Graph) -> DataFrame:
    """``routes_to`` edges from backend groups to the services registered in them."""
    pools = graph.of_type("backend_group")
    by_arn = last_by(pools.select(meta.get(pools, "arn").alias("arn"), F.col("urn").alias("pool_urn"), "ord").filter("arn <> ''"), ["arn"], "pool_urn")
    services = graph.of_type("ecs_service")
    targets = services.select("urn", "ord", F.posexplode(meta.get(services, "ecs_target_group_arns")).alias("pos", "arn"))
    return new_edges(
        targets.join(by_arn, "arn").withColumnRenamed("urn", "service_urn"), "routes_to", 9, "pool_urn", "service_urn",
        F.col("ord") + F.col("pos"), detection_method="ecs_target_group_match", confidence=1.0,
    )


def resolve_security_groups(graph: Graph) -> Graph:
    """Point placeholder ``protected_by`` edges at the real group; unmatched ones stay.

    A resolved edge gets the id of its new ends and moves to the end of the list.
    """
    groups = graph.of_type("security_group")
    real = last_by(groups.select(meta.get(groups, "sg_id").alias("sg_id"), F.col("urn").alias("sg_urn"), "ord").filter("sg_id <> ''"), ["sg_id"], "sg_urn")
    held = (F.col("edge_type") == "protected_by") & F.col("to_urn").contains(PLACEHOLDER)
    waiting = graph.edges.filter(held).withColumn("sg_id", F.regexp_extract("to_urn", r"(?s)^.*/sg/(.*)$", 1)).join(real, "sg_id", "left")
    hit = F.col("sg_urn").isNotNull()
    settled = waiting.withColumns(
        {
            "to_urn": F.coalesce("sg_urn", "to_urn"),
            "uuid": F.when(hit, ids.edge_id(F.col("from_urn"), F.col("sg_urn"), "protected_by")).otherwise(F.col("uuid")),
            "ord": F.when(hit, F.col("ord") + F.lit(13 * STEP)).otherwise(F.col("ord")),
        }
    ).select(*graph.edges.columns)
    return graph.with_edges(union_all([graph.edges.filter(~held), settled]))
