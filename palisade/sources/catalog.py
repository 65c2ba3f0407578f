"""Relational catalogs as graphs.

Catalog tables come as DataFrames, read over JDBC or from an extract; the joins
that a catalog driver writes in SQL are DataFrame joins here.  All frames use
the common column names listed at :func:`load_catalog`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.build import edge_frame, node_frame
from palisade.functions import scalars
from palisade.model import Graph, union_all

# --- fixed values: schemas that belong to the database itself -----------------
SYSTEM_SCHEMAS = {
    "postgres": "pg_catalog information_schema pg_toast".split(),
    "mysql": "information_schema mysql performance_schema sys".split(),
}
WRITE_PRIVILEGES = ("INSERT", "UPDATE", "DELETE")
SAMPLE_SIZE = 20

# --- fixed values: catalog tables each dialect exposes -------------------------
CATALOG_TABLES = {
    "postgres": {
        "schemata": "information_schema.schemata", "tables": "information_schema.tables", "columns": "information_schema.columns",
        "table_constraints": "information_schema.table_constraints", "key_column_usage": "information_schema.key_column_usage",
        "referential_constraints": "information_schema.referential_constraints", "indexes": "pg_indexes", "roles": "pg_roles",
        "grants": "information_schema.role_table_grants",
    },
    "mysql": {
        "schemata": "information_schema.schemata", "tables": "information_schema.tables", "columns": "information_schema.columns",
        "table_constraints": "information_schema.table_constraints", "key_column_usage": "information_schema.key_column_usage",
        "statistics": "information_schema.statistics",
    },
    "oracle": {
        "tables": "dba_tables", "views": "dba_views", "columns": "dba_tab_columns", "constraints": "dba_constraints",
        "cons_columns": "dba_cons_columns", "indexes": "dba_indexes", "ind_columns": "dba_ind_columns",
    },
}


def read_catalog(spark: SparkSession, url: str, dialect: str, **options: str) -> dict[str, DataFrame]:
    """S3: a database's catalog tables over JDBC, lazily; filters on them are pushed to the database."""
    read = spark.read.format("jdbc").option("url", url).options(**options)
    return {name: read.option("dbtable", table).load() for name, table in CATALOG_TABLES[dialect].items()}


def user_schemas(df: DataFrame, column: str, dialect: str) -> DataFrame:
    return df.filter(~F.col(column).isin(SYSTEM_SCHEMAS[dialect]))


# --- joins over catalog tables (M11) -------------------------------------------


def constraints(table_constraints: DataFrame, key_column_usage: DataFrame, kinds: tuple[str, ...] = ("PRIMARY KEY", "UNIQUE", "CHECK")) -> DataFrame:
    """Constraints with their columns; a CHECK without columns keeps one row (PostgreSQL, MySQL)."""
    on = ["constraint_name", "table_schema", "table_name"]
    keys = key_column_usage.select(*on, "column_name", "ordinal_position")
    wanted = table_constraints.filter(F.col("constraint_type").isin(*kinds)).select(*on, "constraint_type")
    return wanted.join(keys, on, "left").select(
        "constraint_name", F.replace("constraint_type", F.lit(" "), F.lit("_")).alias("constraint_type"),
        F.col("table_schema").alias("schema_name"), "table_name", F.coalesce("column_name", F.lit("")).alias("column_name"), "ordinal_position",
    )


def foreign_keys_standard(referential: DataFrame, usage: DataFrame) -> DataFrame:
    """PostgreSQL: referential constraints joined to both sides' key columns by position."""
    own = usage.select("constraint_name", "constraint_schema", F.col("table_schema").alias("fk_schema"), F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"), "ordinal_position")
    far = usage.select(
        F.col("constraint_name").alias("unique_constraint_name"), F.col("constraint_schema").alias("unique_constraint_schema"),
        F.col("table_schema").alias("ref_schema"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "ordinal_position",
    )
    return referential.join(own, ["constraint_name", "constraint_schema"]).join(
        far, ["unique_constraint_name", "unique_constraint_schema", "ordinal_position"]
    ).select("constraint_name", "fk_schema", "fk_table", "fk_column", "ref_schema", "ref_table", "ref_column", "ordinal_position")


def foreign_keys_mysql(usage: DataFrame) -> DataFrame:
    """MySQL states the referenced column next to the key column."""
    return usage.filter("referenced_table_name is not null").select(
        "constraint_name", F.col("table_schema").alias("fk_schema"), F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"),
        F.col("referenced_table_schema").alias("ref_schema"), F.col("referenced_table_name").alias("ref_table"),
        F.col("referenced_column_name").alias("ref_column"), "ordinal_position",
    )


def foreign_keys_oracle(cons: DataFrame, cons_columns: DataFrame) -> DataFrame:
    """Oracle: two constraint rows and two column rows per key column."""
    cols = cons_columns.select("owner", "constraint_name", "column_name", "position")
    own = cons.filter("constraint_type = 'R'").select("owner", "constraint_name", F.col("table_name").alias("fk_table"), "r_owner", "r_constraint_name").join(
        cols, ["owner", "constraint_name"]
    ).select(F.col("owner").alias("fk_schema"), "constraint_name", "fk_table", F.col("column_name").alias("fk_column"), "r_owner", "r_constraint_name", "position")
    far = cons.select("owner", "constraint_name", F.col("table_name").alias("ref_table")).join(cols, ["owner", "constraint_name"]).select(
        F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), "ref_table", F.col("column_name").alias("ref_column"), "position"
    )
    return own.join(far, ["r_owner", "r_constraint_name", "position"]).select(
        "constraint_name", "fk_schema", "fk_table", "fk_column", F.col("r_owner").alias("ref_schema"), "ref_table", "ref_column", F.col("position").alias("ordinal_position")
    )


def oracle_tables(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Oracle lists tables and views apart."""
    return tables.select(F.col("owner").alias("table_schema"), "table_name", F.lit("BASE_TABLE").alias("table_type")).unionAll(
        views.select(F.col("owner").alias("table_schema"), F.col("view_name").alias("table_name"), F.lit("VIEW").alias("table_type"))
    )


def oracle_constraint_type(code: Column) -> Column:
    return F.when(code == "P", "PRIMARY_KEY").when(code == "U", "UNIQUE").when(code == "C", "CHECK")


def index_columns(rows: DataFrame, keys: list[str], column: str = "column_name", position: str = "seq_in_index") -> DataFrame:
    """One row per index with its columns in order.  An index has at most a few dozen."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(column).alias("c")))), lambda x: x["c"])
    return rows.groupBy(*keys).agg(listed.alias("columns"))


def postgres_indexes(indexes: DataFrame) -> DataFrame:
    """PostgreSQL indexes from their definition text."""
    text = F.col("indexdef")
    return indexes.select(
        F.col("schemaname").alias("schema_name"), F.col("tablename").alias("table_name"), F.col("indexname").alias("index_name"),
        scalars.index_method(text).alias("index_type"), F.upper(text).contains("UNIQUE INDEX").alias("is_unique"),
        scalars.index_columns(text, F.col("tablename")).alias("columns"),
    )


def sample_values(table: DataFrame, column: str, size: int = SAMPLE_SIZE) -> DataFrame:
    """Up to ``size`` distinct non-NULL values as text; a missing column gives none."""
    if column not in table.columns:
        return table.sparkSession.createDataFrame([], "value string")
    return table.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().limit(size)


# --- the graph (S2) --------------------------------------------------------------


def grant_directions(privilege: Column) -> Column:
    """Edge types one privilege stands for."""
    return (
        F.when(privilege == "ALL", F.array(F.lit("reads"), F.lit("writes")))
        .when(privilege.isin(*WRITE_PRIVILEGES), F.array(F.lit("writes")))
        .otherwise(F.array(F.lit("reads")))
    )


def grant_edges(grants: DataFrame, roles: DataFrame, urn) -> list[DataFrame]:
    """``reads``/``writes`` edges of known grantees; all privileges of a pair are kept as a list.

    ``privilege`` is the last of them in catalog order, which is what remains
    when edges with one id overwrite each other.
    """
    known = grants.join(roles.select(F.col("role_name").alias("grantee")), "grantee", "left_semi")
    merged = (
        known.withColumn("way", F.explode(grant_directions(F.col("privilege_type"))))
        .groupBy("grantee", "table_schema", "table_name", "way")
        .agg(F.array_sort(F.collect_set("privilege_type")).alias("privileges"), F.max("is_grantable").alias("is_grantable"))
    )
    return [
        edge_frame(
            merged.filter(F.col("way") == way), way, urn("'roles'", "grantee"), urn("table_schema", "table_name"),
            "xxhash64(grantee, table_schema, table_name) & 281474976710655L", privilege="element_at(privileges, -1)", privileges="privileges", is_grantable="is_grantable",
        )
        for way in ("reads", "writes")
    ]


def load_catalog(frames: dict[str, DataFrame], database: str, host: str, port: int) -> Graph:
    """Database, schemas, tables and columns, foreign keys, roles and grants.

    ``schemata(schema_name)``, ``tables(table_schema, table_name, table_type)``,
    ``columns(table_schema, table_name, column_name, ordinal_position, data_type,
    is_nullable, character_maximum_length, numeric_precision, numeric_scale)``,
    ``foreign_keys`` as the functions above give them, ``roles(role_name,
    can_login, is_superuser)`` and ``grants(grantee, table_schema, table_name,
    privilege_type, is_grantable)``; the last three are optional.
    """
    base = f"urn:onprem:postgres:{host}:{port}:{database}"
    urn = lambda *cols: f"concat_ws('/', '{base}', {', '.join(cols)})"
    order = lambda *cols: f"xxhash64({', '.join(cols)}) & 281474976710655L"
    spark = frames["schemata"].sparkSession
    schemas = user_schemas(frames["schemata"], "schema_name", "postgres")
    inside = schemas.select(F.col("schema_name").alias("table_schema"))
    tables = frames["tables"].filter("table_type in ('BASE TABLE', 'BASE_TABLE', 'VIEW')").join(inside, "table_schema", "left_semi")
    columns = frames["columns"].join(tables.select("table_schema", "table_name"), ["table_schema", "table_name"], "left_semi")
    place = Window.partitionBy("table_schema", "table_name").orderBy("ordinal_position")  # the columns of one table
    numbered = columns.withColumns({
        "place": F.row_number().over(place) - 1,
        "type_text": scalars.sql_type_text(F.col("data_type"), F.col("character_maximum_length"), F.col("numeric_precision"), F.col("numeric_scale")),
    })
    nodes = [
        node_frame(spark.range(1), "database", f"'{base}'", None, "0", database_name=f"'{database}'", host=f"'{host}'", port=str(port)),
        node_frame(schemas, "schema", urn("schema_name"), f"'{base}'", order("schema_name"), schema_name="schema_name"),
        node_frame(
            tables, "table", urn("table_schema", "table_name"), urn("table_schema"), order("table_schema", "table_name"),
            table_name="table_name", table_type="replace(upper(table_type), ' ', '_')",
        ),
        node_frame(
            numbered, "column", urn("table_schema", "table_name", "column_name"), urn("table_schema", "table_name"),
            order("table_schema", "table_name", "column_name"), column_name="column_name", data_type="type_text", nullable="is_nullable", ordinal_position="place",
        ),
    ]
    children = union_all([n.select("urn", "parent_urn", "ord") for n in nodes[1:]])
    edges = [edge_frame(children, "contains", "parent_urn", "urn", "ord")]
    if "foreign_keys" in frames:
        edges.append(edge_frame(
            frames["foreign_keys"], "references", urn("fk_schema", "fk_table", "fk_column"), urn("ref_schema", "ref_table", "ref_column"),
            order("constraint_name", "ordinal_position"), constraint_name="constraint_name", ordinal_position="ordinal_position",
        ))
    if "roles" in frames:
        roles = frames["roles"].filter("role_name not like 'pg#_%' escape '#'")
        nodes.append(node_frame(roles, "identity", urn("'roles'", "role_name"), None, order("role_name"), role_name="role_name", role_login="can_login", role_superuser="is_superuser"))
        if "grants" in frames:
            grants = user_schemas(frames["grants"], "table_schema", "postgres")
            edges += grant_edges(grants, roles, urn)
    return Graph(union_all(nodes), union_all(edges))
