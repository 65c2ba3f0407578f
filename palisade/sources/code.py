"""Source trees as graphs: files, definitions, calls, imports and framework tags."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.build import edge_frame, node_frame
from palisade.functions import docker, meta, source_text
from palisade.model import Graph, union_all
from palisade.session import stash
from palisade.sources.files import list_tree, read_contents, read_small
from palisade.sources.lockfile import load_lock
from palisade.sources.parsing import FACT_SCHEMA, facts_of

# --- fixed values: languages by file extension, and folders never scanned -----
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "jsx": "javascript",
    "java": "java",
    "rb": "ruby",
    "rs": "rust",
    "kt": "kotlin",
    "scala": "scala",
    "cs": "c_sharp",
    "c": "c",
    "cpp": "cpp",
    "h": "c",
    "hpp": "cpp",
    "swift": "swift",
    "sql": "sql",
}
SKIPPED_FOLDERS = (
    "node_modules vendor .venv venv __pycache__ .git dist build target .tox .mypy_cache .pytest_cache .ruff_cache egg-info"
).split()

FACTS_PER_BATCH = 4096

# --- fixed values: web framework patterns; a variable is looked for from its first letter only, so long words take linear time
FASTAPI_ROUTE = r"""@(\w+)\.(get|post|put|patch|delete|head|options)\(\s*["']([^"']*)["']"""
FASTAPI_ROUTER = r"""(?<!\w)(\w++)\s*+=\s*APIRouter\((?:[^)]*prefix\s*=\s*["']([^"']*)["'])?"""
FASTAPI_INCLUDE = r"""\.include_router\(\s*(\w+)(?:[^)]*prefix\s*=\s*["']([^"']*)["'])?"""
FASTAPI_CREDENTIALS = r"\b(HTTPAuthorizationCredentials|HTTPBasicCredentials)\b"
FASTAPI_SCHEME = (
    r"(?<!\w)(\w++)\s*+=\s*(HTTPBearer|HTTPBasic|OAuth2PasswordBearer|OAuth2AuthorizationCodeBearer|APIKeyHeader|APIKeyQuery|APIKeyCookie)\s*\("
)
FRAMEWORKS = "sqlalchemy boto3 flask requests fastapi".split()
FASTAPI_DEPENDS = r"Depends\s*\(\s*(\w+)"
FASTAPI_ROUTER_DEPENDS = r"(?<!\w)(\w++)\s*+=\s*APIRouter\s*\([^)]*dependencies\s*=\s*\[([^\]]*)\]"
ROUTER_PATTERNS = {"routers": FASTAPI_ROUTER, "includes": FASTAPI_INCLUDE, "schemes": FASTAPI_SCHEME, "router_depends": FASTAPI_ROUTER_DEPENDS}


def language_of(path: Column) -> Column:
    """Language by extension, NULL when unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    suffix = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    return table[suffix]


LOCK_FILE = "uv.lock"


def read_tree(spark: SparkSession, folder: str, skipped: tuple[str, ...] = tuple(SKIPPED_FOLDERS)) -> DataFrame:
    """``(file_path, language, source, size_bytes)`` of a checked-out tree, each kept file read once.

    Kept are files of a known language, Dockerfiles, and the lock file at the root, whose
    language is ``lock``.  Folders that are skipped are not entered.
    """
    listed = list_tree(spark, folder, skipped).withColumn("language", language_of(F.col("file_path")))
    language = F.when(F.col("file_path") == LOCK_FILE, "lock").otherwise(F.col("language"))
    kept = listed.withColumn("language", language).filter(F.col("language").isNotNull() | docker.is_dockerfile(F.col("file_path")))
    text = read_contents(kept).withColumn("language", language_of(F.col("file_path"))).withColumn("language", language)
    return text.select("file_path", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("source"), "size_bytes")


def head_commit(folder: str) -> str | None:
    """The commit that a checked-out tree stands at, as its ``.git`` folder states it."""
    git = f"{folder.rstrip('/')}/.git"
    head = (read_small(f"{git}/HEAD") or "").strip()
    if not head.startswith("ref:"):
        return head or None
    name = head[4:].strip()
    own = read_small(f"{git}/{name}")
    if own is not None:
        return own.strip() or None
    packed = (line.split(" ", 1) for line in (read_small(f"{git}/packed-refs") or "").splitlines() if not line.startswith(("#", "^")))
    return next((parts[0] for parts in packed if parts[1:] == [name]), None)


def repo_parts(url: Column) -> list[Column]:
    """Host and path of a clone URL, HTTPS or SSH."""
    ssh = url.startswith("git@") | (~url.startswith("http") & url.contains(":"))
    host = F.when(ssh, F.substring_index(F.substring_index(url, ":", 1), "@", -1)).otherwise(F.regexp_extract(url, r"^\w+://(?:[^@/]*@)?([^/:]+)", 1))
    path = F.when(ssh, F.regexp_replace(url, r"^[^:]*:", "")).otherwise(F.regexp_extract(url, r"^\w+://[^/]*(/[^?#]*)?", 1))
    clean = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), r"^/+|/+$", "")
    return [F.lower(F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))).alias("host"), clean.alias("path")]


def extract_facts(files: DataFrame, spread: int | None = None) -> DataFrame:
    """Parse every file once, in Arrow batches; the facts are kept as a table for the joins.

    ``spread`` redistributes the files over that many tasks first; use it when
    they come in few splits, as parsing costs far more than reading.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in FACT_SCHEMA.split(", ")]
        for batch in batches:
            found: list[dict] = []
            for row in batch.itertuples(index=False):
                found += facts_of(row.file_path, row.language, row.source)
                if len(found) >= FACTS_PER_BATCH:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    parsed = files.filter("language is not null").select("file_path", "language", "source")
    if spread:
        parsed = parsed.repartition(spread, "file_path")
    return stash(parsed.mapInPandas(parse, FACT_SCHEMA), "facts")


class CodeScan:
    """A scanned source tree; every property is one frame of the resulting graph.

    ``base`` is the URN prefix of the tree (``urn:local:codebase:{host}:_``) and
    ``root`` its name, the first path segment and the package prefix of imports.
    """

    def __init__(self, files: DataFrame, base: str, root: str, spread: int | None = None, repo_url: str | None = None, commit: str | None = None):
        self.base, self.root, self.spread = base, root, spread
        self.repo_url, self.commit = repo_url, commit
        self.urn = f"{base}:{root}"
        self.files = files

    @cached_property
    def facts(self) -> DataFrame:
        return extract_facts(self.files, self.spread)

    def _fact(self, kind: str) -> DataFrame:
        return self.facts.filter(F.col("fact") == kind)

    # --- nodes -------------------------------------------------------------------

    def file_urn(self, path: str = "file_path") -> str:
        return f"concat('{self.urn}/', {path})"

    def _definition_urn(self) -> str:
        return f"concat_ws('/', '{self.urn}', file_path, array_join(chain, '/'), display)"

    def definitions(self) -> DataFrame:
        """Classes and functions with URN, parent and line range."""
        named = self.facts.filter("fact in ('class', 'function')")
        path = "array_join(filter(flatten(array(array('{0}', file_path), chain, {1})), x -> x <> ''), '/')"
        return named.selectExpr(
            "*", f"{path.format(self.urn, 'array(display)')} as urn", f"{path.format(self.urn, 'array()')} as parent_urn",
            "(xxhash64(file_path) & 268435455L) * 1048576 + seq as ord",
        )

    @cached_property
    def gates(self) -> DataFrame:
        """F15/F19 per Python file, in one pass over the texts: frameworks imported and router patterns.

        Flags and short match lists travel on, never the texts.
        """
        flags = [source_text.imports(F.col("source"), lib).alias(f"uses_{lib}") for lib in FRAMEWORKS]
        # a text is searched once for each pattern, its short matches are taken apart
        pairs = [
            F.transform(F.regexp_extract_all("source", F.lit(p), F.lit(0)), _both_groups(p)).alias(name)
            for name, p in ROUTER_PATTERNS.items()
        ]
        modules = top_level_imports(F.col("source")).alias("modules")
        return stash(self.files.filter("language = 'python'").select("file_path", *flags, *pairs, modules), "gates")

    def nodes(self) -> DataFrame:
        count = self.files.filter("language is not null").agg(F.count("*").alias("n"))
        classes, functions = self.class_tags, self.function_tags
        return union_all([
            node_frame(
                count, "codebase", f"'{self.urn}'", None, "0", repo_name=f"'{self.root}'", file_count="n",
                **{k: _literal(v) for k, v in (("repo_url", self.repo_url), ("scanned_commit", self.commit)) if v},
            ),
            self.file_nodes(),
            node_frame(
                classes, "class", "urn", "parent_urn", "ord", class_name="name", start_line="start", end_line="end", file_path="file_path", base_classes="bases",
                orm_table="orm_table", orm_framework="if(orm_table is not null, 'sqlalchemy', null)", aws_s3_client="s3_client",
            ),
            node_frame(
                functions, "function", "urn", "parent_urn", "ord", function_name="name", start_line="start", end_line="end", is_method="size(chain) > 0",
                file_path="file_path", **{k: k for k in FUNCTION_TAGS},
            ),
        ])

    @cached_property
    def file_tags(self) -> DataFrame:
        """files with what their Dockerfile states; written once, as several steps read it."""
        content = F.col("source")
        images = docker.base_images(content)
        is_docker = docker.is_dockerfile(F.col("file_path")) & (F.size(images) > 0)
        tag = lambda c: F.when(is_docker, c)
        tagged = self.files.select(
            "file_path", "language", "size_bytes", tag(F.array_join(images, ",")).alias("images"), tag(docker.entrypoint(content)).alias("entry"),
            tag(docker.cmd(content)).alias("cmd"), tag(docker.workdir(content)).alias("workdir"),
            tag(F.nullif(F.array_join(docker.copy_targets(content), ","), F.lit(""))).alias("copies"),
        )
        return stash(tagged, "files").filter("language is not null or images is not null")

    def file_nodes(self) -> DataFrame:
        return node_frame(
            self.file_tags, "file", self.file_urn(), f"'{self.urn}'", "xxhash64(file_path) & 1099511627775L", file_path="file_path",
            language="coalesce(language, 'dockerfile')", size_bytes="size_bytes", dockerfile_base_images="images", dockerfile_entrypoint="entry",
            dockerfile_cmd="cmd", dockerfile_workdir="workdir", dockerfile_copy_targets="copies",
        )

    # --- framework tags ------------------------------------------------------------

    @cached_property
    def class_tags(self) -> DataFrame:
        """F13/F14 on classes: mapped table and object-store client, gated by the file's imports."""
        text = F.col("text")
        classes = self.definitions().filter("fact = 'class'").join(self.gates.select("file_path", *[f"uses_{lib}" for lib in FRAMEWORKS]), "file_path", "left")
        tagged = classes.withColumns({
            "orm_table": F.when(F.col("uses_sqlalchemy"), source_text.orm_table(text)),
            "s3_client": F.when(F.col("uses_boto3") & source_text.uses_s3_client(text), F.lit(True)),
        })
        return stash(tagged.drop("text", "head"), "classes")

    @cached_property
    def function_tags(self) -> DataFrame:
        """F13-F18 on functions; web frameworks override the standard-library tag."""
        text, full = F.col("text"), F.col("full")
        functions = self.definitions().filter("fact = 'function'").join(self.gates.select("file_path", *[f"uses_{lib}" for lib in FRAMEWORKS]), "file_path", "left")
        functions = functions.withColumn("full", F.concat(F.coalesce("head", F.lit("")), text))
        routed = F.col("uses_fastapi") & full.rlike(FASTAPI_ROUTE)
        group = lambda i: F.when(routed, F.regexp_extract(full, FASTAPI_ROUTE, i))
        credentials = F.when(F.col("uses_fastapi"), F.nullif(F.regexp_extract(full, FASTAPI_CREDENTIALS, 1), F.lit("")))
        seen = stash(functions.select(
            "urn", "parent_urn", "ord", "file_path", "name", "chain", "start", "end", "text",
            source_text.stdlib_io(text).alias("io"), F.when(F.col("uses_flask"), source_text.flask_route(full)).alias("flask"),
            (F.coalesce("uses_requests", F.lit(False)) & source_text.calls_requests(text)).alias("calls_out"),
            group(1).alias("router_variable"), F.upper(group(2)).alias("fast_method"), group(3).alias("fast_path"),
            F.when(credentials == "HTTPAuthorizationCredentials", "HTTPBearer").when(credentials == "HTTPBasicCredentials", "HTTPBasic").alias("typed_auth"),
            F.when(F.col("uses_boto3") & source_text.uses_s3_client(text), F.lit(True)).alias("aws_s3_client"),
            F.when(F.col("uses_boto3"), source_text.s3_operations(text)).alias("aws_s3_operations"),
            F.when(F.col("uses_sqlalchemy"), source_text.orm_operations(text)).alias("orm_operations"),
        ), "functions")
        tagged = seen.withColumns({
            "aws_s3_operation_type": source_text.s3_operation_types(F.col("aws_s3_operations")),
            "orm_operation_type": source_text.orm_operation_types(F.col("orm_operations")),
            "orm_framework": F.when(F.col("orm_operations").isNotNull(), "sqlalchemy"),
            "route_path": F.coalesce("flask.route_path", "fast_path"), "http_method": F.coalesce("flask.http_method", "fast_method"),
            "api_framework": F.when(F.col("flask").isNotNull(), "flask").when(F.col("fast_path").isNotNull(), "fastapi"),
            "io_direction": F.when(F.col("calls_out"), "egress").when(F.col("flask").isNotNull(), "ingress").otherwise(F.col("io.io_direction")),
            "io_type": F.when(F.col("calls_out") | F.col("flask").isNotNull(), "network").otherwise(F.col("io.io_type")),
        })
        return stash(self._orm_models(self._fastapi_paths(tagged)), "tags")

    def _matches(self, name: str) -> DataFrame:
        """``(file_path, pos, a, b)``: both groups of every match of a router pattern."""
        return self.gates.select("file_path", F.posexplode(name).alias("pos", "m")).select("file_path", "pos", "m.a", "m.b")

    def _fastapi_paths(self, functions: DataFrame) -> DataFrame:
        """full route paths from router and include prefixes, and the auth scheme in force."""
        order = F.struct("file_path", "pos")
        prefixes = self._matches("routers").groupBy("file_path", F.col("a").alias("router_variable")).agg(F.max_by("b", "pos").alias("router_prefix"))
        included = (
            self._matches("includes").withColumnRenamed("a", "name").join(self.imports().select("file_path", "name", "source_file"), ["file_path", "name"])
            .filter("source_file is not null").groupBy(F.col("source_file").alias("file_path")).agg(F.max_by("b", order).alias("include_prefix"))
        )
        schemes = self._matches("schemes").groupBy(F.col("a").alias("var")).agg(F.max_by("b", order).alias("scheme"))
        router_deps = self._matches("router_depends").select(
            "file_path", F.col("a").alias("router_variable"), "pos", F.posexplode(F.regexp_extract_all("b", F.lit(FASTAPI_DEPENDS), F.lit(1))).alias("dep", "var")
        )
        router_auth = router_deps.join(schemes, "var").groupBy("file_path", "router_variable").agg(F.max_by("scheme", F.struct("pos", "dep")).alias("router_auth"))
        depends = functions.filter("fast_path is not null").select("urn", F.posexplode(F.regexp_extract_all("text", F.lit(FASTAPI_DEPENDS), F.lit(1))).alias("pos", "var"))
        own_auth = depends.join(schemes, "var").groupBy("urn").agg(F.min_by(F.struct("var", "scheme"), "pos").alias("own_auth"))
        joined = (
            functions.join(prefixes, ["file_path", "router_variable"], "left").join(included, "file_path", "left")
            .join(router_auth, ["file_path", "router_variable"], "left").join(own_auth, "urn", "left")
        )
        blank = lambda c: F.coalesce(c, F.lit(""))
        return joined.withColumns({
            "full_route_path": F.when(F.col("fast_path").isNotNull(), F.concat(blank("include_prefix"), blank("router_prefix"), "fast_path")),
            "auth_scheme": F.coalesce("own_auth.scheme", F.when(F.col("fast_path").isNotNull(), F.col("router_auth")), "typed_auth"),
            "auth_scheme_var": F.col("own_auth.var"),
        })

    def model_references(self, functions: DataFrame) -> DataFrame:
        """``(urn, class_name, class_urn)`` for ORM classes named as a word in ORM functions.

        Words of the text are matched by equality, so no function meets a class
        whose name it does not contain.
        """
        classes = self.class_tags.filter("orm_table is not null").groupBy("name").agg(F.max_by("urn", "ord").alias("class_urn"))
        words = functions.filter("orm_operations is not null").select(
            "urn", "ord", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("name")
        )
        return words.join(classes, "name")

    def _orm_models(self, functions: DataFrame) -> DataFrame:
        named = self.model_references(functions).groupBy("urn").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("orm_models"))
        return functions.join(named, "urn", "left")

    # --- imports and calls -----------------------------------------------------------

    def imports(self) -> DataFrame:
        """from-imports resolved to files; ``source_file`` is NULL for external modules."""
        found = self._fact("import").groupBy("file_path", "name").agg(F.max_by(F.struct("module", "source_name"), "seq").alias("i")).select("file_path", "name", "i.*")
        rest = F.regexp_replace(F.substr(F.col("module"), F.lit(len(self.root) + 1)), r"^\.", "")
        path = F.replace(rest, F.lit("."), F.lit("/"))
        candidates = F.when(rest == "", F.array(F.lit("__init__.py"))).otherwise(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py"))))
        inside = F.when(F.col("module").startswith(self.root), candidates)
        return self._first_existing(found, inside, ["file_path", "name"])

    def _first_existing(self, rows: DataFrame, candidates: Column, key: list[str]) -> DataFrame:
        """Add ``source_file``: the first candidate path that is a scanned file."""
        options = rows.select(*key, F.posexplode(candidates).alias("rank", "option"))
        files = self.files.select(F.col("file_path").alias("option"))
        best = options.join(files, "option").groupBy(*key).agg(F.min_by("option", "rank").alias("source_file"))
        return rows.join(best, key, "left")

    def _rust_imports(self) -> DataFrame:
        """``use`` items, groups and aliases split, resolved to files."""
        uses = self.files.filter("language = 'rust'").select(
            "file_path", F.posexplode(F.regexp_extract_all("source", F.lit(r"(?m)^use\s+([^;]+);"), F.lit(1))).alias("seq", "body")
        )
        body = F.trim("body")
        grouped = body.contains("::{") & body.endswith("}")
        prefix = F.when(grouped, F.substring_index(body, "::{", 1))
        inner = F.when(grouped, F.split(F.regexp_extract(body, r"(?s)::\{(.*)\}$", 1), ",")).otherwise(F.array(body))
        items = uses.select("file_path", "seq", prefix.alias("prefix"), F.explode(F.filter(F.transform(inner, F.trim), lambda i: i != "")).alias("item"))
        target, alias = F.trim(F.substring_index("item", " as ", 1)), F.trim(F.substring_index("item", " as ", -1))
        last = F.substring_index(target, "::", -1)
        lone = F.when(target.contains("::"), F.regexp_replace(target, r"::[^:]*$", "")).otherwise("")
        split = items.select(
            "file_path", "seq", F.when(F.col("item").contains(" as "), alias).otherwise(F.when(F.col("prefix").isNull(), last).otherwise(target)).alias("name"),
            F.when(F.col("prefix").isNull(), last).otherwise(target).alias("source_name"), F.coalesce("prefix", lone).alias("module"),
        )
        latest = split.groupBy("file_path", "name").agg(F.max_by(F.struct("module", "source_name"), "seq").alias("i")).select("file_path", "name", "i.*")
        return self._first_existing(latest, rust_candidates(F.col("module"), F.col("file_path")), ["file_path", "name"])

    def call_edges(self) -> DataFrame:
        """``calls`` and ``instantiates`` edges; imports first, then the same file."""
        definitions = self.definitions()
        functions = definitions.filter("fact = 'function'")
        key = ["file_path", "chain", "display"]
        python = self._fact("call").select("file_path", "chain", "display", F.col("name").alias("callee")).join(functions.select(*key, "urn", F.col("name").alias("caller"), "ord"), key)
        rust_texts = functions.join(self.files.filter("language = 'rust'").select("file_path"), "file_path", "left_semi")
        rust = rust_texts.select("file_path", "urn", F.col("name").alias("caller"), "ord", F.explode(rust_calls(F.col("text"))).alias("full"))
        rust = rust.select("*", F.substring_index("full", "::", -1).alias("callee"))
        qualified = self._qualified(rust.filter("full like '%::%'"), definitions)
        plain = python.select("file_path", "urn", "caller", "ord", "callee").unionByName(
            rust.join(qualified.select("urn", "full"), ["urn", "full"], "left_anti").select("file_path", "urn", "caller", "ord", "callee")
        ).distinct()
        imports = self.imports().select("file_path", F.col("name").alias("callee"), "source_file", "source_name").unionByName(
            self._rust_imports().select("file_path", F.col("name").alias("callee"), "source_file", "source_name")
        )
        index = lambda kind: definitions.filter(F.col("fact") == kind).groupBy("file_path", "name").agg(F.max_by("urn", "ord").alias("target"), F.count("*").alias("n"))
        fn, cls = index("function"), index("class")
        at = lambda df, path, name, out: df.select(F.col("file_path").alias(path), F.col("name").alias(name), F.col("target").alias(out))
        resolved = (
            plain.join(imports.withColumn("imported", F.lit(True)), ["file_path", "callee"], "left")
            .join(at(fn, "source_file", "source_name", "far_fn"), ["source_file", "source_name"], "left")
            .join(at(cls, "source_file", "source_name", "far_cls"), ["source_file", "source_name"], "left")
            .join(fn.select("file_path", F.col("name").alias("callee"), F.col("target").alias("near_fn"), "n"), ["file_path", "callee"], "left")
            .join(at(cls, "file_path", "callee", "near_cls"), ["file_path", "callee"], "left")
        )
        others = F.col("n") - F.when(F.col("caller") == F.col("callee"), 1).otherwise(0)  # the caller itself does not count
        external = F.col("imported") & F.col("source_file").isNull()
        target = F.when(~F.coalesce(external, F.lit(False)), F.coalesce("far_fn", "far_cls", F.when(others > 0, F.col("near_fn")), "near_cls"))
        local = resolved.withColumn("target", target).filter("target is not null").select("urn", "ord", "callee", "target")
        links = stash(local.unionByName(qualified.select("urn", "ord", "callee", "target")).distinct(), "calls")
        makes = "(substr(callee, 1, 1) = upper(substr(callee, 1, 1)) and substr(callee, 1, 1) rlike '[A-Za-z]')"
        kind = lambda cond, edge, text: edge_frame(links.filter(cond), edge, "urn", "target", "ord", call_type=f"'{text}'")
        return union_all([kind(f"not {makes}", "calls", "function_call"), kind(makes, "instantiates", "class_instantiation")])

    def _qualified(self, calls: DataFrame, definitions: DataFrame) -> DataFrame:
        """``a::b::f()`` by ever shorter module prefixes, the function name kept."""
        parts = F.split("full", "::")
        tries = calls.select("urn", "ord", "full", "callee", "file_path", F.posexplode(F.transform(
            F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::")
        )).alias("cut", "module"))
        placed = self._first_existing(tries, rust_candidates(F.col("module"), F.col("file_path")), ["urn", "full", "cut"]).filter("source_file is not null")
        spots = definitions.groupBy(F.col("file_path").alias("source_file"), F.col("name").alias("callee")).agg(
            F.max_by("urn", F.struct((F.col("fact") == "function").cast("int"), "ord")).alias("target")
        )
        return placed.join(spots, ["source_file", "callee"]).groupBy("urn", "ord", "full", "callee").agg(F.min_by("target", "cut").alias("target"))

    # --- the graph -------------------------------------------------------------------

    def sources(self) -> DataFrame:
        """``(file_urn, source)`` of the files that can hold definitions."""
        return self.files.filter("language is not null").selectExpr(f"{self.file_urn()} as file_urn", "source")

    def locked(self, packages: DataFrame, osv: DataFrame | None = None) -> Graph:
        """The lock file's packages (rows as ``lockfile.packages`` gives them), what is known of
        their versions (``lockfile.read_vulnerabilities``), and the files that import them."""
        own = load_lock(packages, osv)
        python = self.files.filter("language = 'python'").selectExpr(f"{self.file_urn()} as urn", "source")
        return own.merge(Graph(own.nodes.limit(0), dependency_links(python, own.of_type("dependency"))))

    def graph_with_lock(self, packages: DataFrame, osv: DataFrame | None = None) -> Graph:
        return self.graph().merge(self.locked(packages, osv))

    def graph(self) -> Graph:
        nodes = self.nodes()
        children = nodes.filter("parent_urn is not null").select("parent_urn", "urn", "ord")
        orm = self.model_references(self.function_tags)
        return Graph(nodes, union_all([
            edge_frame(children, "contains", "parent_urn", "urn", "ord"),
            self.call_edges(),
            edge_frame(
                orm, "calls", "urn", "class_urn", "ord", detection_method="'orm_model_reference'", confidence="0.9", orm_framework="'sqlalchemy'", orm_class="name",
            ),
        ]))


def _both_groups(pattern: str):
    """Match of a pattern to its first two groups."""
    return lambda match: F.struct(F.regexp_extract(match, pattern, 1).alias("a"), F.regexp_extract(match, pattern, 2).alias("b"))


def _literal(text: str) -> str:
    """SQL text of a string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


FUNCTION_TAGS = (
    "http_method route_path full_route_path api_framework router_variable auth_scheme auth_scheme_var io_direction io_type "
    "orm_operations orm_operation_type orm_models orm_framework aws_s3_client aws_s3_operations aws_s3_operation_type"
).split()


def rust_candidates(module: Column, path: Column) -> Column:
    """Files a Rust module path may live in, in the order they are tried."""
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    above = F.when(folder.contains("/"), F.regexp_replace(folder, r"/[^/]*$", "")).otherwise("")
    slashes = lambda c: F.replace(F.regexp_replace(c, "^::", ""), F.lit("::"), F.lit("/"))
    under = lambda base, rest: F.array_join(F.filter(F.array(base, rest), lambda s: s != ""), "/")
    rest = lambda word: slashes(F.substr(module, F.lit(len(word) + 1)))
    where = (
        F.when(module.startswith("crate"), rest("crate"))
        .when(module.startswith("super"), under(above, rest("super")))
        .when(module.startswith("self"), under(folder, rest("self")))
        .otherwise(slashes(module))
    )
    return F.when(where != "", F.array(*[F.concat(F.lit(a), where, F.lit(b)) for a in ("", "src/") for b in (".rs", "/mod.rs")]))


def rust_calls(text: Column) -> Column:
    """Names called in a Rust function text, methods and macros left out; the function's own head too."""
    bare = F.regexp_replace(F.regexp_replace(text, r"//[^\n]*|(?s)/\*.*?\*/", " "), r'"(?:\\.|[^"\\])*"', '""')
    called = F.regexp_extract_all(bare, F.lit(r"(?<![\w.:!])(?<!\bfn\s)((?:\w+::)*[A-Za-z_]\w*)\s*\("), F.lit(1))
    words = F.array(*[F.lit(w) for w in "if while for match return loop in let else move fn unsafe async await".split()])
    return F.array_distinct(F.filter(called, lambda c: ~F.array_contains(words, c)))


def dependency_links(files: DataFrame, dependencies: DataFrame, import_names: DataFrame | None = None) -> DataFrame:
    """``depends_on`` edges from files to the packages they import.

    ``files``: ``urn, source``; ``dependencies``: node frame; ``import_names``:
    ``(package, import_name)`` as stated by installed distributions.  A package
    without a statement imports under its own name, hyphens as underscores.  Of several packages
    with one import name the last counts, in all versions it is locked in.
    """
    package = meta.get(dependencies, "package_name")
    deps = dependencies.filter(package != "").select(F.col("urn").alias("dep_urn"), "ord", F.replace(F.lower(package), F.lit("_"), F.lit("-")).alias("package"))
    own = F.replace(F.col("package"), F.lit("-"), F.lit("_"))
    if import_names is None:
        named = deps.withColumn("import_name", own)
    else:
        named = deps.join(import_names, "package", "left").withColumn("import_name", F.lower(F.coalesce("import_name", own)))
    last = named.groupBy(F.col("import_name").alias("l_import")).agg(F.max_by("package", "ord").alias("l_package"))
    by_import = named.join(last, (F.col("import_name") == F.col("l_import")) & (F.col("package") == F.col("l_package"))).select("import_name", "dep_urn").distinct()
    used = files.select("urn", F.explode(top_level_imports(F.col("source"))).alias("import_name")).join(by_import, "import_name")
    return edge_frame(used, "depends_on", "urn", "dep_urn", "xxhash64(urn, dep_urn) & 281474976710655L", import_name="import_name")


def top_level_imports(source: Column) -> Column:
    """lower-cased top-level modules a Python text imports."""
    found = F.regexp_extract_all(source, F.lit(r"(?m)^(?:import|from)\s+(\w+)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))
