"""Projection of the star-schema tables onto a property graph.

The same projection is spelled in SQL in ``plans/oracle.py``; the two must stay
equal row by row.  Frames are built per node and edge type, and only when a
query asks for the type, so a query scans just the tables and columns it needs.

====================  ============  =============================================
table                 node type     URN
====================  ============  =============================================
region                codebase      urn:tpch:geo:::region/{k}
nation                file          urn:tpch:geo:::nation/{k}
customer              function      urn:tpch:party:::customer/{k}
supplier              class         urn:tpch:party:::supplier/{k}
distinct p_brand      schema        urn:tpch:catalog:::{brand}
part                  table         urn:tpch:catalog:::{brand}/{k}
part                  column        urn:tpch:catalog:::{brand}/{k}/{column}
distinct type, size   dependency    urn:tpch:deps:::{package}
distinct user_id      identity      urn:tpch:catalog:::roles/{user}
====================  ============  =============================================
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import build
from palisade.model import Graph, union_all
from palisade.plans.tables import Tables

# --- fixed values: column names the projection deals out to tables -----------
COLUMN_NAMES = (
    "email phone_number ssn full_name zip_code password_hash api_key price "
    "card_number created_at status mailing"
).split()

RANK = 1_000_000_000_000  # distance between the ordinals of two branches

_NAMES = "array(" + ", ".join(f"'{n}'" for n in COLUMN_NAMES) + ")"


def region_urn(k: str) -> str:
    return f"concat('urn:tpch:geo:::region/', {k})"


def nation_urn(k: str) -> str:
    return f"concat('urn:tpch:geo:::nation/', {k})"


def customer_urn(k: str) -> str:
    return f"concat('urn:tpch:party:::customer/', {k})"


def supplier_urn(k: str) -> str:
    return f"concat('urn:tpch:party:::supplier/', {k})"


def schema_urn(brand: str) -> str:
    return f"concat('urn:tpch:catalog:::', {brand})"


def table_urn(brand: str, k: str) -> str:
    return f"concat('urn:tpch:catalog:::', {brand}, '/', {k})"


def column_urn(brand: str, k: str, name: str) -> str:
    return f"concat('urn:tpch:catalog:::', {brand}, '/', {k}, '/', {name})"


def package(kind: str, size: str) -> str:
    return f"concat(lower({kind}), '-', {size})"


def dependency_urn(kind: str, size: str) -> str:
    return f"concat('urn:tpch:deps:::', lower({kind}), '-', {size})"


def role_urn(user: str) -> str:
    return f"concat('urn:tpch:catalog:::roles/', {user})"


def column_name(index: str) -> str:
    return f"{_NAMES}[cast(({index}) % {len(COLUMN_NAMES)} as int)]"


def source_path(nation: str) -> str:
    return f"concat('src/nation_', {nation}, '.py')"


def node_frame(df: DataFrame, kind: str, rank: int, urn: str, parent: str | None, key: str, **fields: str) -> DataFrame:
    return build.node_frame(df, kind, urn, parent, f"{rank * RANK}L + {key}", **fields)


def edge_frame(df: DataFrame, kind: str, rank: int, src: str, dst: str, key: str, **fields: str) -> DataFrame:
    return build.edge_frame(df, kind, src, dst, f"{rank * RANK}L + {key}", **fields)


class MarketNodes:
    """Node frames by type; each attribute is one lazily built frame."""

    TYPES = "codebase file function class schema table column dependency identity".split()

    def __init__(self, t: Tables):
        self.t = t

    @cached_property
    def codebase(self) -> DataFrame:
        return node_frame(
            self.t.region, "codebase", 1, region_urn("r_regionkey"), None, "r_regionkey",
            repo_name="r_name", repo_url="concat('https://git.example.com/', r_name, '.git')",
        )

    @cached_property
    def file(self) -> DataFrame:
        return node_frame(
            self.t.nation, "file", 2, nation_urn("n_nationkey"), region_urn("n_regionkey"), "n_nationkey",
            file_path=source_path("n_nationkey"), language="'python'",
        )

    @cached_property
    def function(self) -> DataFrame:
        building = "c_mktsegment = 'BUILDING'"
        return node_frame(
            self.t.customer, "function", 3, customer_urn("c_custkey"), nation_urn("c_nationkey"), "c_custkey",
            function_name="c_name", file_path=source_path("c_nationkey"),
            http_method=f"case when {building} then 'GET' end",
            route_path=f"case when {building} then concat('/customers/', c_custkey) end",
            auth_scheme="case when c_acctbal >= 0 then 'HTTPBearer' end",
        )

    @property
    def class_(self) -> DataFrame:
        orm = self.t.part.selectExpr("p_partkey as s_suppkey", "p_name as orm_table")
        return node_frame(
            self.t.supplier.join(orm, "s_suppkey", "left"),
            "class", 4, supplier_urn("s_suppkey"), nation_urn("s_nationkey"), "s_suppkey",
            class_name="s_name", file_path=source_path("s_nationkey"), orm_table="orm_table",
        )

    @cached_property
    def schema(self) -> DataFrame:
        brands = self.t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
        return node_frame(brands, "schema", 5, schema_urn("p_brand"), None, "k", schema_name="p_brand")

    @cached_property
    def table(self) -> DataFrame:
        return node_frame(
            self.t.part, "table", 6, table_urn("p_brand", "p_partkey"), schema_urn("p_brand"), "p_partkey",
            table_name="p_name", schema_name="p_brand",
        )

    @cached_property
    def column(self) -> DataFrame:
        dealt = f"array_distinct(array({column_name('p_size')}, {column_name('p_partkey * 5 + 1')}))"
        columns = self.t.part.selectExpr("p_partkey", "p_brand", f"explode({dealt}) as name")
        return node_frame(
            columns, "column", 7, column_urn("p_brand", "p_partkey", "name"), table_urn("p_brand", "p_partkey"),
            f"p_partkey * 100 + array_position({_NAMES}, name)", column_name="name",
        )

    @cached_property
    def dependency(self) -> DataFrame:
        packages = self.t.part.groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("k"))
        return node_frame(
            packages, "dependency", 8, dependency_urn("p_type", "p_size"), None, "k",
            package_name=package("p_type", "p_size"), package_version="concat('1.', p_size)",
            package_ecosystem="'PyPI'",
            cve_ids="case when p_type = 'PROMO' then concat('CVE-2024-', p_size) end",
        )

    @cached_property
    def identity(self) -> DataFrame:
        users = self.t.events.groupBy("user_id").agg(F.max("value").alias("top"))
        return node_frame(
            users, "identity", 9, role_urn("user_id"), None, "user_id",
            role_name="concat('user_', user_id)", role_superuser="top > 60",
        )

    def of(self, kind: str) -> DataFrame:
        return self.class_ if kind == "class" else getattr(self, kind)


class MarketEdges:
    """Edge frames by type; a type may be fed by several frames."""

    TYPES = "contains calls reads writes models references depends_on".split()

    def __init__(self, t: Tables, nodes: MarketNodes):
        self.t = t
        self.nodes = nodes

    def of(self, kind: str) -> list[DataFrame]:
        return getattr(self, kind)()

    def contains(self) -> list[DataFrame]:
        # a class's parent needs no look at the parts its other fields come from
        classes = node_frame(self.t.supplier, "class", 4, supplier_urn("s_suppkey"), nation_urn("s_nationkey"), "s_suppkey", class_name="s_name")
        frames = [self.nodes.of(k) for k in "file function table column".split()]
        children = [f.select("urn", "parent_urn", "ord") for f in [*frames, classes]]
        return [edge_frame(c, "contains", 0, "parent_urn", "urn", "ord") for c in children]

    def calls(self) -> list[DataFrame]:
        """A customer calls whoever of the same nation placed the next order."""
        buyers = self.t.orders.selectExpr("o_orderkey as k", "o_custkey as c_custkey").join(
            self.t.customer.select("c_custkey", "c_nationkey"), "c_custkey"
        )
        later = buyers.selectExpr("k - 1 as k", "c_custkey as callee", "c_nationkey")
        pairs = (
            buyers.join(later, ["k", "c_nationkey"])
            .filter("c_custkey <> callee")
            .groupBy("c_custkey", "callee")
            .agg(F.min("k").alias("k"))
        )
        return [edge_frame(pairs, "calls", 10, customer_urn("c_custkey"), customer_urn("callee"), "k")]

    def _purchases(self, lines: DataFrame) -> DataFrame:
        bought = lines.selectExpr("l_orderkey as o_orderkey", "l_partkey as p_partkey")
        return self.t.orders.select("o_orderkey", "o_custkey").join(bought, "o_orderkey")

    def _code_to_table(self, kind: str, rank: int) -> DataFrame:
        """Every line is an access: returned goods are writes, all others reads."""
        way = F.when(F.col("l_returnflag") == "R", "writes").otherwise("reads")
        bought = (
            self._purchases(self.t.lineitem.filter(way == kind))
            .groupBy("o_custkey", "p_partkey")
            .agg(F.min("o_orderkey").alias("k"))
            .join(self.t.part.select("p_partkey", "p_brand"), "p_partkey")
        )
        return edge_frame(
            bought, kind, rank, customer_urn("o_custkey"), table_urn("p_brand", "p_partkey"), "k",
            detection_method="'orm_reference'", confidence="0.9",
        )

    def _grants(self, way: str, rank: int) -> DataFrame:
        """One row per (user, table, direction) with the least privilege text."""
        privileges = {"reads": "'view', 'click', 'signup', 'error'", "writes": "'purchase', 'signup'"}[way]
        granted = (
            self.t.events.filter(f"event_type in ({privileges})")
            .selectExpr(
                "user_id",
                "cast(get_json_object(props, '$.k') as bigint) as p_partkey",
                "case event_type when 'purchase' then 'INSERT' when 'signup' then 'ALL' else 'SELECT' end as privilege",
            )
            .groupBy("user_id", "p_partkey")
            .agg(F.min("privilege").alias("privilege"))
            .join(self.t.part.select("p_partkey", "p_brand"), "p_partkey")
        )
        return edge_frame(
            granted, way, rank, role_urn("user_id"), table_urn("p_brand", "p_partkey"), "user_id * 1000 + p_partkey",
            privilege="privilege",
        )

    def reads(self) -> list[DataFrame]:
        return [self._code_to_table("reads", 11), self._grants("reads", 16)]

    def writes(self) -> list[DataFrame]:
        return [self._code_to_table("writes", 12), self._grants("writes", 17)]

    def models(self) -> list[DataFrame]:
        lines = (
            self.t.lineitem.groupBy("l_suppkey", "l_partkey")
            .agg(F.min("l_orderkey").alias("k"))
            .join(self.t.part.selectExpr("p_partkey as l_partkey", "p_brand", "p_name"), "l_partkey")
        )
        return [
            edge_frame(
                lines, "models", 13, supplier_urn("l_suppkey"), table_urn("p_brand", "l_partkey"), "k",
                detection_method="'orm_tablename'", confidence="1.0", table_name="p_name",
            )
        ]

    def references(self) -> list[DataFrame]:
        """Foreign keys between the first columns of neighbouring parts of one type."""
        keyed = self.t.part.selectExpr("p_partkey", "p_type", "p_brand", f"{column_name('p_size')} as name")
        nxt = keyed.selectExpr("p_partkey - 1 as p_partkey", "p_type", "p_brand as brand2", "name as name2")
        return [
            edge_frame(
                keyed.join(nxt, ["p_partkey", "p_type"]), "references", 14,
                column_urn("p_brand", "p_partkey", "name"), column_urn("brand2", "p_partkey + 1", "name2"),
                "p_partkey", constraint_name="concat('fk_', p_partkey)", ordinal_position="1",
            )
        ]

    def depends_on(self) -> list[DataFrame]:
        uses = (
            self._purchases(self.t.lineitem)
            .join(self.t.customer.selectExpr("c_custkey as o_custkey", "c_nationkey"), "o_custkey")
            .join(self.t.part.select("p_partkey", "p_type", "p_size"), "p_partkey")
            .groupBy("c_nationkey", "p_type", "p_size")
            .agg(F.min("o_orderkey").alias("k"))
        )
        return [
            edge_frame(
                uses, "depends_on", 15, nation_urn("c_nationkey"), dependency_urn("p_type", "p_size"), "k",
                import_name="lower(p_type)",
            )
        ]


class MarketGraph(Graph):
    """A graph whose node and edge types are built only when asked for."""

    def __init__(self, t: Tables):
        object.__setattr__(self, "tables", t)
        object.__setattr__(self, "by_type", MarketNodes(t))
        object.__setattr__(self, "edges_by", MarketEdges(t, self.by_type))
        object.__setattr__(self, "soft_links", None)

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    @cached_property
    def nodes(self) -> DataFrame:  # type: ignore[override]
        return union_all([self.by_type.of(k) for k in MarketNodes.TYPES])

    @cached_property
    def edges(self) -> DataFrame:  # type: ignore[override]
        return self.edges_of(*MarketEdges.TYPES)

    def of_type(self, *types: str) -> DataFrame:
        known = [k for k in types if k in MarketNodes.TYPES]
        if not known:
            return super().of_type(*types)
        return union_all([self.by_type.of(k) for k in known])

    def edges_of(self, *types: str) -> DataFrame:
        known = [k for k in types if k in MarketEdges.TYPES]
        if not known:
            return super().edges_of(*types)
        return union_all([f for k in known for f in self.edges_by.of(k)])

    def edge_types(self) -> list[str]:
        return list(MarketEdges.TYPES)

    def version(self) -> str:
        """Folder, and number, sizes and times of the files of its tables."""
        return f"market {self.tables.folder} {self.tables.state('customer', 'events', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier')}"

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(nodes, self.edges, self.soft_links)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges, self.soft_links)


def market_graph(spark: SparkSession, folder: str) -> MarketGraph:
    return MarketGraph(Tables(spark, folder))

