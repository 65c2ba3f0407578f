"""A source tree, lock files, catalogs and containers derived from the star-schema tables.

One view file per customer, one model file per supplier and one Dockerfile per
nation; texts are put together by Spark, then scanned like any checked-out tree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.build import edge_frame, node_frame
from palisade.model import Graph, union_all
from palisade.plans.tables import Tables
from palisade.session import shared_folder
from palisade.sources.code import CodeScan, language_of
from palisade.sources.dispatch import Target, load_target
from palisade.sources.files import write_files

BASE, ROOT = "urn:local:codebase:derived:_", "app"


def _file(df: DataFrame, path: str, text: str) -> DataFrame:
    return df.selectExpr(f"{path} as file_path", f"{text} as source")


def source_files(t: Tables) -> DataFrame:
    """``(file_path, language, source, size_bytes)`` of the derived tree."""
    orm = t.part.selectExpr("p_partkey as s_suppkey", "p_name")
    models = _file(
        t.supplier.join(orm, "s_suppkey"), "concat('models/m', s_suppkey, '.py')",
        """concat('from sqlalchemy import Column\\n\\n\\nclass Model', s_suppkey, '(Base):\\n    __tablename__ = "', p_name,
        '"\\n\\n    def label(self):\\n        return str(self)\\n')""",
    )
    auth = "if(c_acctbal >= 5000, ', user=Depends(scheme)', if(c_acctbal < 0, ', cred: HTTPBasicCredentials = None', ''))"
    save = "if(c_mktsegment = 'BUILDING', '    session.add(rows)\\n    session.commit()\\n', '')"
    bucket = "if(c_mktsegment = 'MACHINERY', '    boto3.client(\"s3\").put_object(Key=1)\\n    s3.get_object()\\n', '')"
    views = _file(
        t.customer, "concat('views/v', c_custkey, '.py')",
        f"""concat('import os\\nimport boto3\\nimport requests\\nfrom fastapi import APIRouter, Depends\\nfrom sqlalchemy import select\\nfrom app.models.m', c_nationkey,
        ' import Model', c_nationkey, ' as M\\n\\nrouter = APIRouter(prefix="/c', c_custkey, '")\\nscheme = HTTPBearer()\\n\\n\\ndef helper(x):\\n    return os.getenv("X")\\n\\n\\n',
        'def fetch(u):\\n    return requests.get(u)\\n\\n\\n@router.get("/items/{{id}}")\\n@trace\\ndef read_', c_custkey, '(session', {auth}, '):\\n    rows = session.query(Model', c_nationkey,
        ').all()\\n', {save}, {bucket}, '    helper(1)\\n    return M()\\n')""",
    )
    wiring = _file(t.spark.range(1), "'main.py'", "'from fastapi import FastAPI\\nfrom app.views.v1 import router as r1\\napp = FastAPI()\\napp.include_router(r1, prefix=\"/v1\")\\n'")
    start = "case n_regionkey when 0 then 'ENTRYPOINT [\"python3\", \"/srv/views/v' when 1 then 'CMD python views/v' when 2 then 'CMD [\"uvicorn\", \"--reload\", \"views.v' when 3 then 'ENTRYPOINT [\"$HOME/v' else 'RUN echo views/v' end"
    ending = "case n_regionkey when 0 then '.py\"]' when 1 then '.py' when 2 then ':router\"]' when 3 then '\"]' else '.py' end"
    docker = _file(
        t.nation, "concat('deploy/n', n_nationkey, '/Dockerfile')",
        f"concat('FROM golang:1.22 AS build\\nENTRYPOINT [\"ignored\"]\\nFROM --platform=linux/amd64 python:3.', n_nationkey, '\\nWORKDIR /srv\\nCOPY --chown=a . /srv\\n', {start}, n_nationkey, {ending}, '\\n')",
    )
    files = models.unionAll(views).unionAll(wiring).unionAll(docker)
    return files.select("file_path", language_of(F.col("file_path")).alias("language"), "source", F.octet_length("source").cast("bigint").alias("size_bytes"))


def code_scan(spark: SparkSession, folder: str) -> CodeScan:
    return CodeScan(source_files(Tables(spark, folder)), BASE, ROOT, spread=spark.sparkContext.defaultParallelism)


def rust_scan(spark: SparkSession, folder: str) -> CodeScan:
    """One Rust file per supplier, using the file of its nation's number."""
    text = (
        "concat('use crate::m', s_nationkey, '::{f', s_nationkey, ' as g, other};\\n\\npub fn f', s_suppkey, '(x: i32) -> i32 {\\n    g(); // f9999()\\n    crate::m', s_nationkey, "
        "'::f', s_nationkey, '();\\n    assert!(helper(2));\\n    x.method();\\n    std::fs::read(\"a\");\\n    helper(1)\\n}\\n\\nfn helper(x: i32) -> i32 { x }\\n')"
    )
    files = Tables(spark, folder).supplier.selectExpr("concat('src/m', s_suppkey, '.rs') as file_path", "'rust' as language", f"{text} as source")
    return CodeScan(files.withColumn("size_bytes", F.octet_length("source").cast("bigint")), BASE, ROOT, spread=spark.sparkContext.defaultParallelism)


def tables_of_parts(t: Tables) -> DataFrame:
    return node_frame(t.part, "table", "concat('urn:tpch:catalog:::', p_brand, '/', p_partkey)", "concat('urn:tpch:catalog:::', p_brand)", "6000000000000L + p_partkey", table_name="p_name")


#: A text per customer ``#``, by extension; those of customers in debt are torn at the mark ``~``.
SCRIPTS = {
    "js": """import x from "y"
const t = `class Fake# { }`
export class Store# extends Base {
  load(a = {b: 1}) { return fetch(`/u/${a}`) }
  get total() { return /[/{]class No {/.test(1) }
}
async function run#(x) {
  if (x) { return () => 1 }
}
class Cut# {
  open() {
~  }
}
""",
    "ts": """interface Shape# { area(): number }
export class Repo#<T extends { id: number }> extends Base<T> {
  find<K>(key: K): { a: number } { return null }
  over(a: string): void
  over(a: any): void {}
}
export function pick#(o: { a: 1 }): void {
}
class Cut# {
  open(): void {
~  }
}
""",
    "java": """package a;
public class Order# extends Model {
    @Override
    public String label() { return "} class No {"; }
    public Order#(int a) { }
    abstract int area();
    interface Inner { void go(); }
}
class Cut# {
    void open() {
~    }
}
""",
}


def script_scan(spark: SparkSession, folder: str, extension: str) -> CodeScan:
    """One file per customer."""
    text = F.replace(F.lit(SCRIPTS[extension]), F.lit("#"), F.col("c_custkey").cast("string"))
    torn = F.substring_index(text, "~", 1)
    files = Tables(spark, folder).customer.select(
        F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(f".{extension}")).alias("file_path"),
        F.when(F.col("c_acctbal") < 0, torn).otherwise(F.replace(text, F.lit("~"), F.lit(""))).alias("source"),
    )
    files = files.select("file_path", language_of(F.col("file_path")).alias("language"), "source", F.octet_length("source").cast("bigint").alias("size_bytes"))
    return CodeScan(files, BASE, ROOT, spread=spark.sparkContext.defaultParallelism)


def lock_rows(t: Tables) -> DataFrame:
    """Lock files as text: one per brand, its parts' types and sizes as packages."""
    entry = "concat('[[package]]\\nname = \"', lower(p_type), '-', p_size, '\"\\nversion = \"1.', p_size, '\"\\ndependencies = [{ name = \"', lower(p_type), '-', p_size + 1, '\" }]\\n')"
    packages = t.part.select("p_brand", "p_type", "p_size").distinct().selectExpr("p_brand", f"{entry} as entry")
    # types and sizes are fixed domains (a few hundred packages), so a brand's file stays small
    return packages.groupBy(F.concat(F.lit("urn:tpch:code:::"), "p_brand").alias("codebase_urn")).agg(
        F.concat(F.lit("version = 1\n\n"), F.array_join(F.array_sort(F.collect_list("entry")), "\n")).alias("source")
    )


#: A clone URL, the commit its checkout stands at, and the URN of its code.
CLONED, COMMIT, CLONE_URN = "https://Git.Example.com/acme/app.git", "6f1ed002ab5595859014ebf0951522d9", "urn:git:repo:git.example.com:_:app"


def checked_out(spark: SparkSession, folder: str) -> Graph:
    """A repository on disk, a file per customer, loaded as a target."""
    t = Tables(spark, folder)
    own = t.customer.selectExpr(
        "concat(if(c_acctbal < 0, 'node_modules', 'src'), '/n', c_nationkey, '/_v', c_custkey, '.py') as file_path",
        "concat('import ', lower(substr(c_mktsegment, 1, 4)), '\\n\\n\\ndef f', c_custkey, '():\\n    return 1\\n') as source",
    )
    packages = t.customer.selectExpr("lower(substr(c_mktsegment, 1, 4)) as name").distinct()
    entries = packages.selectExpr("concat('[[package]]\\nname = \"', name, '\"\\nversion = \"1.0\"\\n') as entry").agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("source"))
    rest = {
        "src/__init__.py": "", "README.md": "text", "sub/uv.lock": "no lock of the root", "Dockerfile": "FROM python:3\n",
        ".git/HEAD": "ref: refs/heads/main\n", ".git/packed-refs": f"# pack-refs\n{'0' * 32} refs/heads/old\n{COMMIT} refs/heads/main\n", ".git/no.py": "def no(): pass\n",
    }
    texts = F.map_from_arrays(F.array(*[F.lit(k) for k in rest]), F.array(*[F.lit(v) for v in rest.values()]))
    fixed = spark.range(1).select(F.explode(texts).alias("file_path", "source"))
    place = f"{shared_folder(spark)}/checkout-{uuid.uuid4().hex}"
    write_files(own.unionAll(entries.selectExpr("'uv.lock' as file_path", "source")).unionAll(fixed), place)
    return load_target(spark, Target(f"urn:git:repo:_:_:{CLONED}", place))


#: What a customer's view imports besides what all views do, by market segment.
LIBRARIES = "case c_mktsegment when 'BUILDING' then 'economy' when 'MACHINERY' then 'promo' else 'medium' end"


def vulnerable_tree(spark: SparkSession, folder: str) -> tuple[CodeScan, DataFrame, DataFrame]:
    """A tree whose views import packages, its lock file with one or two versions of each, and what is known of the versions.

    Packages are the first words of part types; sizes of odd number make up the second version.
    """
    t = Tables(spark, folder)
    files = t.customer.selectExpr(
        "concat('lib/c', c_custkey, '.py') as file_path", "'python' as language", f"concat('import os\\nimport ', {LIBRARIES}, '\\n\\n\\ndef f():\\n    return 1\\n') as source"
    )
    scan = CodeScan(files.withColumn("size_bytes", F.octet_length("source").cast("bigint")), BASE, ROOT, spread=spark.sparkContext.defaultParallelism)
    versions = t.part.selectExpr("lower(split_part(p_type, ' ', 1)) as name", "if(p_type like 'P%' and p_size % 2 = 1, '2.0', '1.0') as version").distinct()
    entry = "concat('[[package]]\\nname = \"', name, '\"\\nversion = \"', version, '\"\\n', if(name = 'promo', '', 'dependencies = [{ name = \"promo\", version = \"2.0\" }, { name = \"gone\" }]\\n'))"
    # a few first words of types
    lock = versions.selectExpr(f"{entry} as entry").agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("source"))
    known = t.part.filter("p_type like 'P%'").selectExpr(
        "lower(split_part(p_type, ' ', 1)) as name", "'2.0' as version", "array(struct(concat('CVE-2024-', p_size) as id, cast(null as array<string>) as aliases)) as vulns"
    ).distinct()
    return scan, lock.select(F.lit(scan.urn).alias("codebase_urn"), "source"), known


def osv_extract(t: Tables) -> DataFrame:
    vulns = "array(struct(concat('GHSA-', p_size) as id, array(concat('CVE-2024-', p_size), concat('CVE-2023-', p_size)) as aliases), struct(concat('CVE-2024-', p_size) as id, cast(null as array<string>) as aliases))"
    return t.part.filter("p_type = 'PROMO'").select("p_type", "p_size").distinct().selectExpr(
        "concat(lower(p_type), '-', p_size) as name", "concat('1.', p_size) as version", f"{vulns} as vulns"
    )


def container_graph(spark: SparkSession, folder: str) -> Graph:
    """Codebases per ten customers, Dockerfiles per customer, repositories and images per supplier."""
    t = Tables(spark, folder)
    base = "concat('urn:git:repo:git.example.com:_:n', {0})"
    repo = "concat('urn:arn:aws:ecr:r:1:repository/s', s_suppkey)"
    suffix = "case when s_acctbal < 2000 then '' when s_acctbal < 4000 then '-api' when s_acctbal < 6000 then '_web' else '-worker' end"
    own = "c_custkey div 10"
    codebases = t.customer.selectExpr(f"{own} as k").distinct()
    none = union_all([
        node_frame(codebases, "codebase", base.format("k"), None, "k", repo_name="concat('n', k)", repo_url="concat('https://git.example.com/N', k, '.git/')", clone_url="null"),
        node_frame(
            t.customer, "file", f"concat({base.format(own)}, '/svc', c_custkey, '/Dockerfile')", base.format(own), "100000 + c_custkey",
            file_path="concat('svc', c_custkey, '/Dockerfile')", dockerfile_base_images="case when c_mktsegment <> 'HOUSEHOLD' then 'python:3.12' end",
            dockerfile_cmd="case when c_mktsegment = 'BUILDING' then 'python main.py' end",
        ),
        node_frame(t.supplier, "image_repository", repo, None, "s_suppkey", repository_name=f"concat('s', s_suppkey, '/n', s_suppkey, {suffix})"),
        node_frame(
            t.supplier, "image", f"concat({repo}, '/image/1')", repo, "s_suppkey",
            oci_source="case when s_nationkey < 5 then concat('git@git.example.com:n', s_suppkey, '.git') end",
        ),
    ])
    files = t.customer.filter("c_acctbal < 0")
    builds = edge_frame(files, "builds", f"concat({base.format(own)}, '/svc', c_custkey, '/Dockerfile')", "'urn:arn:aws:ecr:r:1:repository/s0'", "c_custkey")
    return Graph(none, builds)


def catalog_frames(t: Tables) -> dict[str, DataFrame]:
    """Catalog extracts: brands as schemas, parts as tables with two or three columns, users as roles."""
    grants = t.events.selectExpr(
        "concat('user_', user_id) as grantee", "cast(get_json_object(props, '$.k') as bigint) as p_partkey",
        "case event_type when 'view' then 'SELECT' when 'click' then 'REFERENCES' when 'purchase' then 'INSERT' when 'error' then 'DELETE' else 'ALL' end as privilege_type",
        "value > 50 as is_grantable",
    ).distinct().join(t.part.selectExpr("p_partkey", "p_brand as table_schema", "concat('t', p_partkey) as table_name"), "p_partkey").drop("p_partkey")
    column = (
        "explode(array(struct('id' as n, 7 as pos, 'bigint' as ty, cast(null as int) as len, 64 as prec, 0 as sc), "
        "struct('email' as n, 9 as pos, 'varchar' as ty, p_size as len, cast(null as int) as prec, cast(null as int) as sc), "
        "struct('price' as n, 12 as pos, 'numeric' as ty, cast(null as int) as len, 10 as prec, p_size % 3 as sc))) as c"
    )
    linked = t.part.selectExpr("p_partkey", "p_brand", "p_partkey - 1 as prev").alias("a").join(t.part.selectExpr("p_partkey as prev", "p_brand as ref_brand"), "prev")
    return {
        "schemata": t.part.selectExpr("p_brand as schema_name").distinct().unionAll(t.spark.range(1).selectExpr("'pg_catalog' as schema_name")),
        "tables": t.part.selectExpr("p_brand as table_schema", "concat('t', p_partkey) as table_name", "case when p_type = 'PROMO' then 'VIEW' when p_type = 'SMALL' then 'FOREIGN' else 'BASE TABLE' end as table_type"),
        "columns": t.part.selectExpr("p_brand as table_schema", "concat('t', p_partkey) as table_name", column).selectExpr(
            "table_schema", "table_name", "c.n as column_name", "c.pos as ordinal_position", "c.ty as data_type", "c.n <> 'id' as is_nullable",
            "c.len as character_maximum_length", "c.prec as numeric_precision", "c.sc as numeric_scale",
        ),
        "foreign_keys": linked.selectExpr(
            "concat('fk_', p_partkey) as constraint_name", "p_brand as fk_schema", "concat('t', p_partkey) as fk_table", "'id' as fk_column",
            "ref_brand as ref_schema", "concat('t', prev) as ref_table", "'id' as ref_column", "1 as ordinal_position",
        ),
        "roles": t.events.groupBy("user_id").agg(F.max("value").alias("top")).filter("top > 55").selectExpr("concat('user_', user_id) as role_name", "true as can_login", "top > 60 as is_superuser"),
        "grants": grants,
    }
