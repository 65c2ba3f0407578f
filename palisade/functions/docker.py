"""Dockerfile parsing and path mapping as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: program names that are never the executed file ------------
RUNNERS = (
    "python python3 node uvicorn gunicorn java npm sh bash ruby perl php "
    "dotnet go run exec deno uv npx poetry pipenv conda"
).split()


def command_words(instruction: Column) -> Column:
    """Words of an ENTRYPOINT/CMD: JSON exec form when it parses, else the shell form."""
    raw = F.trim(instruction)
    exec_form = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    shell_form = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    return F.when(F.size(exec_form) > 0, exec_form).otherwise(shell_form)


def _program_path(arg: Column) -> Column:
    """Path of a program argument; ``app.main:app`` names a module, variables name nothing."""
    module = F.substring_index(arg, ":", 1)
    is_module = arg.contains(":") & ~arg.startswith("/") & ~module.contains("/")
    path = F.when(is_module, F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))).otherwise(arg)
    unusable = (arg == "") | arg.contains("$") | arg.contains("%")
    return F.when(~unusable, path)


def target_file(instruction: Column) -> Column:
    """file a container command runs; NULL when it names none or uses a variable.

    The first remaining word is mapped inside the array, so its expression is
    stated once however often the path rule mentions it.
    """
    words = F.filter(
        command_words(instruction),
        lambda w: ~w.startswith("-") & ~F.substring_index(w, "/", -1).isin(RUNNERS),
    )
    return F.get(F.transform(F.slice(words, 1, 1), _program_path), F.lit(0))


def _strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^/+|/+$", "")


def repo_path(file_arg: Column, workdir: Column, copy_targets: Column) -> Column:
    """F8: container path to repository path.  ``copy_targets`` is an array of destinations."""
    dests = F.transform(F.coalesce(copy_targets, F.array().cast("array<string>")), _strip_slashes)

    def rule(arg: Column) -> Column:
        path = F.regexp_replace(arg, r"^/+", "")
        wd = _strip_slashes(workdir)
        holding = F.filter(dests, lambda d: (d != "") & path.startswith(F.concat(d, F.lit("/"))))
        below = lambda base: path.substr(F.length(base) + 2, F.length(path))
        has_wd = F.coalesce(workdir != "", F.lit(False))
        return (
            F.when(~arg.startswith("/"), path)
            .when(has_wd & path.startswith(F.concat(wd, F.lit("/"))), below(wd))
            .when(has_wd & (path == wd), F.lit(""))
            .when(F.size(holding) > 0, below(F.get(holding, F.lit(0))))
            .otherwise(path)
        )

    return F.get(F.transform(F.array(file_arg), rule), F.lit(0))


def base_images(content: Column) -> Column:
    """image references of every FROM line, in order."""
    pattern = r"(?m)^\s*FROM\s+(?:--platform=\S+\s+)?(\S+?)(?:\s+[Aa][Ss]\s+\S+)?\s*$"
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def final_stage(content: Column) -> Column:
    """Text from the last FROM line on; the whole text when there is none."""
    stage = F.regexp_extract(content, r"(?is)^(?:.*\n)?([ \t]*FROM\s+.*)$", 1)
    return F.when(stage != "", stage).otherwise(content)


def _first_match(text: Column, pattern: str) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def entrypoint(content: Column) -> Column:
    return F.nullif(F.trim(_first_match(final_stage(content), r"(?m)^\s*ENTRYPOINT\s+(.*)")), F.lit(""))


def cmd(content: Column) -> Column:
    return F.nullif(F.trim(_first_match(final_stage(content), r"(?m)^\s*CMD\s+(.*)")), F.lit(""))


def workdir(content: Column) -> Column:
    found = F.regexp_extract_all(final_stage(content), F.lit(r"(?m)^\s*WORKDIR\s+(\S+)"), F.lit(1))
    return F.element_at(F.when(F.size(found) > 0, found), -1)


def copy_targets(content: Column) -> Column:
    pattern = r"(?m)^\s*COPY\s+(?:--[^\s]+\s+)*(.+?)\s+(\S+)\s*$"
    return F.regexp_extract_all(final_stage(content), F.lit(pattern), F.lit(2))


def is_dockerfile(path: Column) -> Column:
    """Path names a Dockerfile: ``Dockerfile``, ``Dockerfile.*`` or ``*.dockerfile``."""
    name = F.substring_index(path, "/", -1)
    return (name == "Dockerfile") | name.startswith("Dockerfile.") | name.endswith(".dockerfile")
