"""Security questions: sensitive data, dependencies, permissions, blast radius, attack surface (X1-X5, G6, G6r, G7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import labels, meta
from palisade.model import CODE_TO_DATA, Graph
from palisade.operators.code_data import _table_named
from palisade.operators.traverse import adjacency, reach
from palisade.session import stash

# --- fixed values: what each traversal follows and how nodes are grouped ------
BLAST_EDGES = "calls reads writes models references soft_reference depends_on".split()
REVERSE_EDGES = "reads writes models calls".split()
CODE_TYPES = ("function", "class")
DATA_TYPES = "table column s3_bucket s3_prefix s3_object".split()
ROLE_TYPES = ("db_role", "identity")
PUBLIC_CIDR = "0.0.0.0/0"


def find_sensitive_data(graph: Graph, category: str = "") -> DataFrame:
    """Tagged nodes; ``category`` is a prefix of any tag.  Columns name their table."""
    nodes = graph.nodes
    tags = meta.get(nodes, "data_sensitivity")
    hit = meta.truthy(nodes, "data_sensitivity")
    if category:
        hit = hit & F.exists(F.split(tags, ","), lambda t: t.startswith(category))
    found = nodes.filter(hit).select(
        "urn", "node_type", labels.security_label(nodes).alias("label"), tags.alias("tags"),
        F.when(meta.truthy(nodes, "column_name"), F.col("parent_urn")).alias("parent_urn"),
    )
    tables = graph.of_type("table")
    parents = tables.select(F.col("urn").alias("parent_urn"), meta.get(tables, "table_name").alias("table_name"))
    return found.join(parents, "parent_urn", "left").select("urn", "node_type", "label", "tags", "table_name")


def trace_sensitive_data_access(graph: Graph, table_name: str) -> DataFrame:
    """Tags of the (last) table of that name, its sensitive columns, and the code behind it."""
    target = _table_named(graph, table_name)
    nodes = graph.nodes
    facts = nodes.select(
        "urn", meta.get(nodes, "data_sensitivity").alias("tags"),
        meta.get(nodes, "column_name").alias("column_name"), labels.code_label(nodes).alias("code"),
    )
    table = facts.join(target, "urn", "left_semi").filter("tags <> ''")
    below = graph.edges_of("contains").join(target.withColumnRenamed("urn", "from_urn"), "from_urn", "left_semi")
    columns = below.select(F.col("to_urn").alias("urn")).join(facts, "urn").filter("tags <> ''")
    users = graph.edges_of(*CODE_TO_DATA).join(target.withColumnRenamed("urn", "to_urn"), "to_urn", "left_semi")
    code = users.select(F.col("from_urn").alias("urn")).join(facts, "urn")
    line = lambda df, part, name, tags: df.select(F.lit(part).alias("part"), "urn", name.alias("name"), tags.alias("tags"))
    none = F.lit(None).cast("string")
    return (
        line(table, "table", F.lit(table_name), F.col("tags"))
        .unionByName(line(columns, "column", F.coalesce("column_name", F.lit("?")), F.col("tags")))
        .unionByName(line(code, "code", F.col("code"), none))
    )


def _dependencies(graph: Graph) -> DataFrame:
    deps = graph.of_type("dependency")
    return deps.select(
        F.col("urn").alias("to_urn"), "ord", meta.get(deps, "package_name").alias("package"),
        meta.get(deps, "package_version").alias("version"), meta.get(deps, "cve_ids").alias("cve_ids"),
    )


def _importers(graph: Graph) -> DataFrame:
    edges, nodes = graph.edges_of("depends_on"), graph.nodes
    files = nodes.select(F.col("urn").alias("from_urn"), F.coalesce(meta.get(nodes, "file_path"), F.col("urn")).alias("file_path"))
    return edges.select(
        "from_urn", "to_urn", F.coalesce(meta.get(edges, "import_name"), F.lit("?")).alias("import_name")
    ).join(files, "from_urn", "left")


def find_code_using_dependency(graph: Graph, package: str) -> DataFrame:
    """Files importing the first dependency of that name (any case)."""
    named = _dependencies(graph).filter(F.lower("package") == package.lower())
    first = named.agg(F.min_by(F.struct("to_urn", "package", "version", "cve_ids"), F.struct("ord", "to_urn")).alias("d")).filter("d is not null").select("d.*")
    return first.join(_importers(graph), "to_urn", "left").select("package", "version", "cve_ids", "file_path", "import_name")


def find_vulnerable_code(graph: Graph) -> DataFrame:
    """Dependencies with known CVEs and the files using them (NULL file: none does)."""
    bad = _dependencies(graph).filter("cve_ids <> ''")
    return bad.join(_importers(graph), "to_urn", "left").select("package", "version", "cve_ids", "file_path")


def find_database_permissions(graph: Graph, table_name: str = "", role_name: str = "", compat: bool = False) -> DataFrame:
    """Grants of database roles.  ``compat`` accepts only ``db_role`` nodes."""
    roles = graph.of_type(*(ROLE_TYPES[:1] if compat else ROLE_TYPES))
    principals = roles.select(
        F.col("urn").alias("from_urn"), F.coalesce(meta.get(roles, "role_name"), F.lit("?")).alias("role_name"),
        meta.truthy(roles, "role_superuser").alias("superuser"),
    )
    nodes = graph.nodes
    targets = nodes.select(F.col("urn").alias("to_urn"), meta.get(nodes, "table_name").alias("table_name"))
    edges = graph.edges_of("reads", "writes")
    grants = edges.select(
        "from_urn", "to_urn", "edge_type", F.coalesce(meta.get(edges, "privilege"), F.lit("?")).alias("privilege"),
        meta.truthy(edges, "is_grantable").alias("grantable"),
    )
    if role_name:
        principals = principals.filter(F.col("role_name") == role_name)
    if table_name:
        targets = targets.filter(F.col("table_name") == table_name)
    return grants.join(principals, "from_urn").join(targets, "to_urn").select(
        "role_name", "edge_type", "privilege", F.coalesce("table_name", F.lit("?")).alias("table_name"), "superuser", "grantable"
    )


def blast_radius(graph: Graph, urn: str, max_depth: int = 5) -> DataFrame:
    """What a compromised node reaches, with its distance and bucket.

    Dangling and otherwise typed vertices count towards the total (bucket ``other``).
    """
    found = reach(adjacency(graph, BLAST_EDGES, "outgoing"), urn, max_depth).filter(F.col("urn") != urn)
    nodes = graph.nodes
    facts = nodes.select(
        "urn", "node_type", labels.security_label(nodes).alias("label"),
        F.nullif(meta.get(nodes, "data_sensitivity"), F.lit("")).alias("tags"),
        F.nullif(meta.get(nodes, "cve_ids"), F.lit("")).alias("cve_ids"),
    )
    bucket = (
        F.when(F.col("node_type").isin(*CODE_TYPES), "code")
        .when(F.col("node_type").isin(*DATA_TYPES), "data")
        .when(F.col("node_type") == "dependency", "dependency")
        .otherwise("other")
    )
    return found.join(facts, "urn", "left").select(
        "urn", "depth", F.coalesce("node_type", F.lit("unknown")).alias("node_type"), bucket.alias("bucket"),
        F.coalesce("label", "urn").alias("label"),
        F.when(bucket == "data", F.col("tags")).alias("tags"),
        F.when(bucket == "dependency", F.col("cve_ids")).alias("cve_ids"),
    )


def blast_summary(radius: DataFrame) -> DataFrame:
    """G6 totals: reachable, sensitive data and CVE-affected dependencies."""
    return radius.agg(
        F.count("*").alias("reachable"),
        F.count_if(F.col("bucket") == "code").alias("code"),
        F.count_if(F.col("bucket") == "data").alias("data"),
        F.count_if(F.col("bucket") == "dependency").alias("dependencies"),
        F.count("tags").alias("sensitive"),
        F.count("cve_ids").alias("vulnerable"),
    )


def reverse_blast_radius(graph: Graph, urn: str, max_depth: int = 5, compat: bool = False) -> DataFrame:
    """G6r: code, principals and HTTP endpoints upstream of a data node."""
    found = reach(adjacency(graph, REVERSE_EDGES, "incoming"), urn, max_depth).filter(F.col("urn") != urn)
    nodes = graph.nodes
    facts = nodes.select(
        "urn", "node_type", labels.security_label(nodes).alias("label"),
        meta.truthy(nodes, "route_path").alias("routed"),
        F.concat_ws(
            " ", F.coalesce(meta.get(nodes, "http_method"), F.lit("?")),
            F.coalesce(F.nullif(meta.get(nodes, "full_route_path"), F.lit("")), meta.get(nodes, "route_path"), F.lit("?")),
        ).alias("route"),
        F.nullif(meta.get(nodes, "auth_scheme"), F.lit("")).alias("auth_scheme"),
    )
    roles = ROLE_TYPES[:1] if compat else ROLE_TYPES
    bucket = F.when(F.col("node_type").isin(*CODE_TYPES), "code").when(F.col("node_type").isin(*roles), "principal").otherwise("other")
    endpoint = (bucket == "code") & F.coalesce("routed", F.lit(False))
    return found.join(facts, "urn", "left").select(
        "urn", "depth", F.coalesce("node_type", F.lit("unknown")).alias("node_type"), bucket.alias("bucket"),
        F.coalesce("label", "urn").alias("label"), endpoint.alias("endpoint"),
        F.when(endpoint, F.col("route")).alias("route"), F.when(endpoint, F.col("auth_scheme")).alias("auth_scheme"),
    )


# --- attack surface -----------------------------------------------------------


def guarding_groups(graph: Graph) -> DataFrame:
    """``(urn, groups)``: names of a resource's security groups, open ones marked PUBLIC."""
    groups = graph.of_type("security_group")
    rules = meta.get(groups, "sg_rules_ingress")
    is_open = F.coalesce(F.exists(rules, lambda r: r["cidr"] == PUBLIC_CIDR), F.lit(False))
    name = F.coalesce(meta.get(groups, "sg_name"), F.col("urn"))
    named = groups.select(F.col("urn").alias("to_urn"), F.when(is_open, F.concat(name, F.lit(" [PUBLIC]"))).otherwise(name).alias("group"))
    return graph.edges_of("protected_by").join(named, "to_urn").select(F.col("from_urn").alias("urn"), "group")


def service_roles(graph: Graph) -> DataFrame:
    """``(service, role)``: service -> task definition -> IAM role."""
    tasks = graph.of_type("ecs_task_definition").select(F.col("urn").alias("task"))
    nodes = graph.nodes
    roles = nodes.select(F.col("urn").alias("role_urn"), F.coalesce(meta.get(nodes, "role_name"), F.col("urn")).alias("role"))
    uses = graph.edges_of("references").select(F.col("from_urn").alias("service"), F.col("to_urn").alias("task"))
    takes = graph.edges_of("assumes").select(F.col("from_urn").alias("task"), F.col("to_urn").alias("role_urn"))
    return uses.join(tasks, "task").join(takes, "task").join(roles, "role_urn").select("service", "role")


def exposed_doors(graph: Graph, include_internal: bool = False) -> DataFrame:
    """G7 fronts: DNS record -> internet-facing balancer, one row per record and balancer."""
    records = graph.of_type("dns_record")
    if not include_internal:
        records = records.filter(~meta.truthy(records, "dns_zone_private"))
    names = records.select(F.col("urn").alias("dns_urn"), F.coalesce(meta.get(records, "dns_record_name"), F.lit("?")).alias("dns_name"))
    doors = graph.nodes
    fronts = doors.filter(meta.get(doors, "lb_scheme") == "internet-facing").select(
        F.col("urn").alias("lb_urn"), F.coalesce(meta.get(doors, "lb_type"), F.lit("?")).alias("lb_type"),
        F.coalesce(meta.get(doors, "lb_dns_name"), F.lit("?")).alias("lb_dns"),
    )
    resolves = graph.edges_of("resolves_to").select(F.col("from_urn").alias("dns_urn"), F.col("to_urn").alias("lb_urn"))
    return resolves.join(names, "dns_urn").join(fronts, "lb_urn")


def exposed_chains(graph: Graph, include_internal: bool = False) -> DataFrame:
    """G7 chains: each exposed record with each service behind its balancer.

    A chain without any service keeps one row with a NULL service.  The rows are
    records times services of a balancer: ask for it after choosing some, and use
    :func:`attack_surface_parts` for all.
    """
    return exposed_doors(graph, include_internal).join(services_behind(graph), "lb_urn", "left")


def attack_surface_parts(graph: Graph, include_internal: bool = False) -> DataFrame:
    """G7 in linear size: records to balancers (``front``), balancers to services (``behind``), services with a public IP (``direct``)."""
    groups = stash(_csv_by(guarding_groups(graph), "urn", "group", "security_groups"), "groups")
    roles = _csv_by(service_roles(graph), "service", "role", "iam_roles").withColumnRenamed("service", "service_urn")
    doors = stash(exposed_doors(graph, include_internal), "doors")
    columns = "part dns_urn dns_name lb_urn lb_type lb_dns security_groups service_urn service iam_roles".split()

    def part(name: str, df: DataFrame) -> DataFrame:
        named = df.withColumn("part", F.lit(name))
        return named.select(*[c if c in named.columns else F.lit(None).cast("string").alias(c) for c in columns])

    front = doors.join(groups.withColumnRenamed("urn", "lb_urn"), "lb_urn", "left")
    behind = services_behind(graph).distinct().join(doors.select("lb_urn", "lb_type", "lb_dns").distinct(), "lb_urn").join(roles, "service_urn", "left")
    direct = directly_exposed(graph).join(groups.withColumnRenamed("urn", "service_urn"), "service_urn", "left").join(roles, "service_urn", "left")
    return part("front", front).unionByName(part("behind", behind)).unionByName(part("direct", direct))


def services_behind(graph: Graph) -> DataFrame:
    """``(lb_urn, service_urn, service)`` through backend groups."""
    pools = graph.of_type("backend_group").select(F.col("urn").alias("pool"))
    services = graph.of_type("ecs_service")
    named = services.select(F.col("urn").alias("service_urn"), F.coalesce(meta.get(services, "ecs_service_name"), F.lit("?")).alias("service"))
    routes = graph.edges_of("routes_to")
    first = routes.select(F.col("from_urn").alias("lb_urn"), F.col("to_urn").alias("pool")).join(pools, "pool")
    second = routes.select(F.col("from_urn").alias("pool"), F.col("to_urn").alias("service_urn")).join(named, "service_urn")
    return first.join(second, "pool").select("lb_urn", "service_urn", "service")


def directly_exposed(graph: Graph) -> DataFrame:
    """G7 direct exposure: services with a public IP (the inputs must supply the key)."""
    services = graph.of_type("ecs_service")
    return services.filter(meta.truthy(services, "ecs_public_ip")).select(
        F.col("urn").alias("service_urn"), F.coalesce(meta.get(services, "ecs_service_name"), F.lit("?")).alias("service")
    )


def _csv_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias(name))


def find_public_attack_surface(graph: Graph, include_internal: bool = False) -> DataFrame:
    """Chains and directly exposed services in one frame, groups and roles as text.

    Per resource the groups and roles are few (a handful of attachments each),
    so only those two are rendered as lists.
    """
    groups = _csv_by(guarding_groups(graph), "urn", "group", "security_groups")
    roles = _csv_by(service_roles(graph), "service", "role", "iam_roles")
    roles = roles.withColumnRenamed("service", "service_urn")
    lb_groups = groups.withColumnRenamed("urn", "lb_urn")
    svc_groups = groups.withColumnRenamed("urn", "service_urn")
    none = lambda: F.lit(None).cast("string")
    chains = (
        exposed_chains(graph, include_internal).join(lb_groups, "lb_urn", "left").join(roles, "service_urn", "left")
        .select(F.lit("chain").alias("kind"), "dns_urn", "dns_name", "lb_urn", "lb_type", "lb_dns", "security_groups", "service_urn", "service", "iam_roles")
    )
    direct = (
        directly_exposed(graph).join(svc_groups, "service_urn", "left").join(roles, "service_urn", "left")
        .select(
            F.lit("direct").alias("kind"), none().alias("dns_urn"), none().alias("dns_name"), none().alias("lb_urn"),
            none().alias("lb_type"), none().alias("lb_dns"), "security_groups", "service_urn", "service", "iam_roles",
        )
    )
    return chains.unionByName(direct)
