"""Which plugins run for which source trees (S12, L8), and plugins that others bring.

A tree's profile is the languages of its files and the names at its root.  A plugin names the languages it
knows (None: any) and the root files that make it relevant (none: its languages do).  Whatever the mode, a
plugin never runs on a tree that has none of its languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.model import Graph

if TYPE_CHECKING:
    from palisade.sources.dispatch import Tree

MODES = ("all", "relevant", "manual")


@dataclass(frozen=True)
class CodePlugin:
    """``extend`` gives a tree's graph with what the plugin adds to it."""

    name: str
    extend: Callable[[Tree, Graph], Graph]
    languages: frozenset[str] | None = None
    markers: frozenset[str] = frozenset()


CODE_PLUGINS: dict[str, CodePlugin] = {}


def register_code_plugin(plugin: CodePlugin) -> None:
    CODE_PLUGINS[plugin.name] = plugin


def profiles(files: DataFrame, *keys: str, plugins: Iterable[CodePlugin] | None = None) -> DataFrame:
    """``(keys, languages, markers)`` of trees: ``files`` has ``file_path`` and ``language``.

    Only languages and marker names that plugins ask for are gathered, so a profile is small.
    """
    wanted = sorted({m for p in (CODE_PLUGINS.values() if plugins is None else plugins) for m in p.markers})
    name = F.when(F.col("file_path").isin(*wanted), F.col("file_path")) if wanted else F.lit(None).cast("string")
    return files.groupBy(*keys).agg(F.collect_set("language").alias("languages"), F.collect_set(name).alias("markers"))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def choices(trees: DataFrame, plugins: Iterable[CodePlugin] | None = None) -> DataFrame:
    """``trees`` with ``plugin``, a row for each that runs: ``languages`` and ``markers`` as :func:`profiles` gives them,
    ``mode`` (all, relevant or manual) and ``listed``, names that override the mode (null: none do)."""
    registered = F.array(*[
        F.struct(
            F.lit(p.name).alias("plugin"), (F.lit(None).cast("array<string>") if p.languages is None else _texts(p.languages)).alias("knows"), _texts(p.markers).alias("needs")
        )
        for p in (CODE_PLUGINS.values() if plugins is None else plugins)
    ])
    supported = F.col("knows").isNull() | F.arrays_overlap("knows", "languages")
    relevant = supported & ((F.size("needs") == 0) | F.arrays_overlap("needs", "markers"))
    runs = (
        F.when(F.col("listed").isNotNull(), supported & F.array_contains("listed", F.col("plugin")))
        .when(F.col("mode") == "all", supported)
        .when(F.col("mode") == "relevant", relevant)
        .otherwise(F.lit(False))
    )
    return trees.select("*", F.inline(registered)).filter(runs).drop("knows", "needs")


def chosen(files: DataFrame, mode: str, listed: tuple[str, ...] | None) -> list[CodePlugin]:
    """Plugins of one tree, those for some languages before those for any."""
    if mode not in MODES:
        raise ValueError(f"unknown plugin mode {mode!r}")
    unknown = sorted(set(listed or ()) - CODE_PLUGINS.keys())
    if unknown:
        raise ValueError(f"no such plugins: {', '.join(unknown)}; known: {', '.join(sorted(CODE_PLUGINS))}")
    one = profiles(files).withColumns({"mode": F.lit(mode), "listed": F.lit(None).cast("array<string>") if listed is None else _texts(listed)})
    names = [r["plugin"] for r in choices(one).select("plugin").collect()]  # as many as are registered
    return sorted((CODE_PLUGINS[n] for n in names), key=lambda p: (p.languages is None, p.name))


__all__ = ["CODE_PLUGINS", "MODES", "CodePlugin", "choices", "chosen", "profiles", "register_code_plugin"]
