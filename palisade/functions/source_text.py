"""Pattern questions about source text as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: line ends that separate source lines ----------------------
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"

# --- fixed values: object-store calls by kind ---------------------------------
S3_WRITE = "put_object upload_file upload_fileobj copy_object create_bucket".split()
S3_READ = "get_object download_file download_fileobj head_object head_bucket list_objects_v2 list_objects".split()
S3_DELETE = "delete_object delete_objects delete_bucket".split()
S3_CLIENT = r"""\.(?:client|resource)\s*\(\s*["']s3["']"""
S3_PAGINATOR = r"""\.get_paginator\s*\(\s*["'](list_objects(?:_v2)?)["']"""

# --- fixed values: ORM calls by kind -------------------------------------------
ORM_READ = "query execute get scalar scalars".split()
ORM_WRITE = "add add_all merge bulk_save_objects flush commit".split()
ORM_DELETE = ["delete"]
ORM_TABLE = r"""__tablename__\s*=\s*["']([^"']+)["']"""
ORM_FILTER_DELETE = r"\.filter\s*\([^)]*\)\s*\.delete\s*\("

# --- fixed values: standard-library I/O, first match wins ---------------------
STDLIB_IO = [
    (r"\bos\.environ\b", "ingress", "env"),
    (r"\bos\.getenv\s*\(", "ingress", "env"),
    (r"\bsys\.argv\b", "ingress", "cli"),
    (r"\bsys\.stdin\b", "ingress", "file"),
    (r"\bsubprocess\.(run|Popen|call)\s*\(", "egress", "subprocess"),
    (r"\bArgumentParser\s*\(", "ingress", "cli"),
    (r"\.add_argument\s*\(", "ingress", "cli"),
    (r"\.parse_args\s*\(", "ingress", "cli"),
    (r"\bsocket\.bind\s*\(|\.bind\s*\(", "ingress", "network"),
    (r"\bsocket\.listen\s*\(|\.listen\s*\(", "ingress", "network"),
    (r"\.connect\s*\(", "egress", "network"),
]

# --- fixed values: web patterns -------------------------------------------------
FLASK_ROUTE = r"""@(\w+)\.route\(\s*["']([^"']*)["'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?"""
REQUESTS_CALL = r"\brequests\.(?:get|post|put|patch|delete|head|options)\s*\("
REQUESTS_SESSION = r"\brequests\.Session\s*\("


def lines(source: Column) -> Column:
    """Lines of a text; a trailing line end opens no further line."""
    return F.split(F.regexp_replace(source, rf"(?:{LINE_END})\z", ""), LINE_END)


def lines_between(source: Column, start: Column, end: Column) -> Column:
    """text of 0-based inclusive line range, joined with newlines."""
    first = (start + 1).cast("int")
    count = F.greatest(F.lit(0), end - start + 1).cast("int")
    return F.array_join(F.slice(lines(source), first, count), "\n")


def imports(source: Column, library: str) -> Column:
    """some line starts with ``import library`` or ``from library``."""
    return source.rlike(rf"(?m)^(?:from\s+|import\s+)\Q{library}\E\b")


def _calls(names: list[str]) -> str:
    return r"\.(" + "|".join(names) + r")\s*\("


def _kinds(ops: Column, write: list[str], delete: list[str]) -> Column:
    kind = lambda op: F.when(op.isin(write), "write").when(op.isin(delete), "delete").otherwise("read")
    return F.array_sort(F.array_distinct(F.transform(ops, kind)))


def _csv_or_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ","))


def s3_operations(source: Column) -> Column:
    """sorted CSV of the object-store calls in a text, NULL when none."""
    called = F.regexp_extract_all(source, F.lit(_calls(S3_WRITE + S3_READ + S3_DELETE)), F.lit(1))
    paged = F.slice(F.regexp_extract_all(source, F.lit(S3_PAGINATOR), F.lit(1)), 1, 1)
    return _csv_or_null(F.array_sort(F.array_distinct(F.concat(called, paged))))


def s3_operation_types(operations: Column) -> Column:
    """read/write/delete classes of a CSV of calls."""
    return F.array_join(_kinds(F.split(operations, ","), S3_WRITE, S3_DELETE), ",")


def uses_s3_client(source: Column) -> Column:
    return source.rlike(S3_CLIENT)


def orm_table(class_source: Column) -> Column:
    """value of ``__tablename__``, NULL when not set."""
    return F.nullif(F.regexp_extract(class_source, ORM_TABLE, 1), F.lit(""))


def orm_operations(source: Column) -> Column:
    """sorted CSV of ORM calls in a text, NULL when none."""
    called = F.regexp_extract_all(source, F.lit(_calls(ORM_READ + ORM_WRITE + ORM_DELETE)), F.lit(1))
    bulk = F.when(source.rlike(ORM_FILTER_DELETE), F.array(F.lit("delete"))).otherwise(F.array().cast("array<string>"))
    return _csv_or_null(F.array_sort(F.array_distinct(F.concat(called, bulk))))


def orm_operation_types(operations: Column) -> Column:
    return F.array_join(_kinds(F.split(operations, ","), ORM_WRITE, ORM_DELETE), ",")


def flask_route(source: Column) -> Column:
    """F16: struct of path and upper-cased methods CSV; NULL without a route."""
    methods = F.filter(
        F.transform(F.split(F.regexp_extract(source, FLASK_ROUTE, 3), ","), lambda m: F.upper(F.regexp_replace(F.trim(m), "^[\"']+|[\"']+$", ""))),
        lambda m: m != "",
    )
    return F.when(
        source.rlike(FLASK_ROUTE),
        F.struct(
            F.regexp_extract(source, FLASK_ROUTE, 2).alias("route_path"),
            F.when(F.size(methods) > 0, F.array_join(methods, ",")).alias("http_method"),
        ),
    )


def calls_requests(source: Column) -> Column:
    """text makes an HTTP call through ``requests``."""
    return source.rlike(REQUESTS_CALL) | source.rlike(REQUESTS_SESSION)


def stdlib_io(source: Column) -> Column:
    """struct of direction and type of the first matching pattern, else NULL."""
    cascade = None
    for pattern, direction, kind in STDLIB_IO:
        value = F.struct(F.lit(direction).alias("io_direction"), F.lit(kind).alias("io_type"))
        hit = source.rlike(pattern)
        cascade = F.when(hit, value) if cascade is None else cascade.when(hit, value)
    return cascade
