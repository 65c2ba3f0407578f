"""Scalar column functions: sensitivity tags, URL/DNS keys, ports, type text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: sensitivity patterns, matched case-insensitively -----------
# Words are delimited by "_" or the ends of the column name.
COLUMN_TAG_WORDS = [
    ("pii.email", r"e?_?mail(?:_address)?"),
    ("pii.phone", r"(?:phone|mobile|cell|telephone)"),
    ("pii.ssn", r"(?:ssn|social_security|tax_id)"),
    ("pii.name", r"(?:first_name|last_name|full_name|surname)"),
    ("pii.address", r"(?:address|street|city|zip_code|postal)"),
    ("secret.password", r"(?:password|passwd|pwd|pass_hash)"),
    ("secret.token", r"(?:token|api_key|secret_key|access_key|refresh_token)"),
    ("financial.amount", r"(?:balance|amount|price|salary)"),
    ("financial.account", r"(?:account_number|routing_number|iban|card_number)"),
]
PATH_TAG_PATTERNS = [
    ("pii", r"\bpii\b"),
    ("secret", r"\bsecrets?\b"),
    ("financial", r"\bfinancial\b"),
    ("pii.address", r"\baddress(?:es)?\b"),
]

# --- fixed values: confidence levels of user-made links ----------------------
CONFIDENCE_LEVELS = {"VERY_HIGH": 0.95, "HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4}

# --- fixed values: tool names and the action each one counts as --------------
TOOL_ACTIONS = {
    "mcp__knowledge__add_soft_link": "SOFT_LINK_ADDED",
    "mcp__knowledge__remove_soft_link": "SOFT_LINK_REMOVED",
    "mcp__github__create_pull_request": "PR_CREATED",
    "mcp__github__create_branch": "BRANCH_CREATED",
    "mcp__github__create_or_update_file": "FILE_CHANGED",
}


def _tags(subject: Column, patterns: list[tuple[str, str]]) -> Column:
    hits = [F.when(subject.rlike(p), F.lit(tag)) for tag, p in patterns]
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def column_tags(name: Column) -> Column:
    """sensitivity tags of a column name, in pattern order."""
    return _tags(name, [(tag, rf"(?i)(?:^|_){words}(?:$|_)") for tag, words in COLUMN_TAG_WORDS])


def path_tags(path: Column) -> Column:
    """sensitivity tags of an object path, in pattern order."""
    return _tags(path, [(tag, rf"(?i){p}") for tag, p in PATH_TAG_PATTERNS])


def repo_key(url: Column) -> Column:
    """comparison key of a repository URL, whatever its scheme."""
    key = F.regexp_replace(url, r"/+$", "")
    key = F.regexp_replace(key, r"\.git$", "")
    key = F.regexp_replace(key, r"^https?://", "")
    return F.lower(F.regexp_replace(key, r"^git@([^:]+):", "$1/"))


def dns_key(name: Column) -> Column:
    """comparison key of a DNS name or endpoint URL."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), r"^https?://", "")
    return F.regexp_replace(key, r"[./]+$", "")


def port_range(low: Column, high: Column) -> Column:
    """``all``, one port, or ``low-high`` (``None`` spells a missing end)."""
    spell = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return (
        F.when(low.isNull() & high.isNull(), F.lit("all"))
        .when(low.eqNullSafe(high), low.cast("string"))
        .otherwise(F.concat_ws("-", spell(low), spell(high)))
    )


def sql_type_text(base: Column, length: Column, precision: Column, scale: Column) -> Column:
    """``varchar(255)``, ``numeric(10,2)``, ``numeric(10)`` or the bare name.

    A zero counts as missing, so scale 0 leaves the precision alone.
    """
    given = lambda c: F.coalesce(c != 0, F.lit(False))
    call = lambda *args: F.concat(base, F.lit("("), F.concat_ws(",", *[a.cast("string") for a in args]), F.lit(")"))
    return (
        F.when(given(length), call(length))
        .when(given(precision) & given(scale), call(precision, scale))
        .when(given(precision), call(precision))
        .otherwise(base)
    )


def index_method(indexdef: Column) -> Column:
    """access method named after USING; BTREE unless it is a special one."""
    found = F.upper(F.regexp_extract(indexdef, r"(?i)using (gin|gist|hash|brin)", 1))
    return F.when(found != "", found).otherwise("BTREE")


def index_columns(indexdef: Column, table: Column) -> Column:
    """columns in the parentheses right after the table name, unquoted; empty when there are none."""
    pattern = F.concat(F.lit(r"(?is)\Q"), table, F.lit(r"\E\s*\((.*?)\)"))
    inner = F.call_function("regexp_extract", indexdef, pattern, F.lit(1))
    bare = lambda c: F.regexp_replace(F.trim(c), r"^[\"']+|[\"']+$", "")
    return F.when(inner != "", F.transform(F.split(inner, ","), bare)).otherwise(F.array().cast("array<string>"))


def confidence_score(level: Column) -> Column:
    """numeric confidence of a level name; NULL for an unknown level."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CONFIDENCE_LEVELS.items())])
    return table[F.upper(level)]


def action_type(tool: Column, updated_keys: Column) -> Column:
    """what a tool call did; ``updated_keys`` are the metadata keys it wrote."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(TOOL_ACTIONS.items())])
    marked = F.coalesce(
        F.exists(updated_keys, lambda k: k.endswith("_last_evaluated_at")), F.lit(False)
    )
    return (
        F.when(table[tool].isNotNull(), table[tool])
        .when((tool == "mcp__knowledge__update_node_metadata") & marked, "EVALUATED_AT_MARKED")
        .when(tool == "mcp__knowledge__update_node_metadata", "METADATA_UPDATED")
        .when(tool.startswith("mcp__"), "MCP_TOOL_CALL")
        .otherwise("UNKNOWN")
    )


def glob_pattern(pattern: str) -> str:
    """Q13: a ``*`` glob as a case-insensitive whole-string regex."""
    return "(?i)^" + pattern.replace("*", ".*") + "$"


def excluded(name: Column, patterns: list[str], system: tuple[str, ...] = ()) -> Column:
    """Q13: name is a system one (exactly) or matches an exclusion glob (in any case)."""
    hit = name.isin(list(system)) if system else F.lit(False)
    for p in patterns:
        hit = hit | name.rlike(glob_pattern(p))
    return hit
