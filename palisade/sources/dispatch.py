"""Targets to loaders by provider and service (S12), and plugin selection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.model import Graph
from palisade.sources import okta
from palisade.sources.aws import SERVICES, Account, Dump, load_account
from palisade.sources.catalog import load_catalog
from palisade.session import stash
from palisade.sources.code import LOCK_FILE, CodeScan, head_commit, read_tree
from palisade.sources.lockfile import packages, read_vulnerabilities
from palisade.sources.plugins import CodePlugin, chosen, register_code_plugin

Loader = Callable[[SparkSession, "Target"], Graph]


@dataclass(frozen=True)
class Target:
    """A scan target: its URN, where its extract lies, and plugin choice.

    ``plugins`` names services of an account or plugins of a source tree; without it ``mode`` decides which run on a
    tree: all that know its languages, the relevant ones, or none (manual).  Source trees may have an extract of vulnerabilities.
    """

    urn: str
    location: str
    plugins: tuple[str, ...] | None = None
    vulnerabilities: str | None = None
    mode: str = "all"

    def part(self, index: int) -> str:
        pieces = self.urn.split(":", 5)
        if len(pieces) != 6 or pieces[0] != "urn":
            raise ValueError(f"Invalid URN format: {self.urn}")
        return pieces[index]


def _aws(spark: SparkSession, target: Target) -> Graph:
    account = Account(target.part(3), target.part(4))
    return load_account(Dump.from_folder(spark, target.location), account, list(target.plugins) if target.plugins is not None else None)


def _okta(spark: SparkSession, target: Target) -> Graph:
    return okta.load_directory(okta.read_extract(spark, target.location), target.part(3))


def _host_and_path(url: str) -> tuple[str, str]:
    """Host and path of a clone URL, by HTTPS or SSH; a plain path has the host ``unknown``."""
    address = re.fullmatch(r"(?:\w+://)?(?:[^@/]*@)?([^/:]+)(?::\d+(?=/))?[:/](.*)", url) if not url.startswith(("/", ".")) else None
    host, path = address.groups() if address else ("unknown", url)
    return host.lower(), path.strip("/").removesuffix(".git")


class Tree:
    """A scanned source tree: its files are listed and read once, for the graph, the lock file and the texts."""

    def __init__(self, spark: SparkSession, target: Target):
        self.target = target
        self.files = files = stash(read_tree(spark, target.location), "files")
        own = files.filter("language is null or language <> 'lock'")
        url = target.part(5)
        if target.part(1) == "git":
            host, path = _host_and_path(url)
            self.scan = CodeScan(own, f"urn:git:repo:{host}:_", path.rsplit("/", 1)[-1], repo_url=url, commit=head_commit(target.location))
        else:
            self.scan = CodeScan(own, "urn:local:codebase:_:_", url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
        self.lock = files.filter("language = 'lock'").select(F.lit(self.scan.urn).alias("codebase_urn"), "source")
        self.known = read_vulnerabilities(spark, target.vulnerabilities) if target.vulnerabilities else None

    def graph(self) -> Graph:
        graph = self.scan.graph()
        for plugin in chosen(self.files, self.target.mode, self.target.plugins):
            graph = plugin.extend(self, graph)
        return graph


def _uv(tree: Tree, graph: Graph) -> Graph:
    """Packages of the lock file at the root, and the files that import them."""
    return graph.merge(tree.scan.locked(packages(tree.lock), tree.known))


register_code_plugin(CodePlugin("uv", _uv, markers=frozenset({LOCK_FILE})))


def _tree(spark: SparkSession, target: Target) -> Graph:
    return Tree(spark, target).graph()


def _postgres(spark: SparkSession, target: Target) -> Graph:
    names = ("schemata", "tables", "columns", "foreign_keys", "roles", "grants")
    frames = {n: spark.read.parquet(f"{target.location}/{n}") for n in names}
    return load_catalog(frames, target.part(5), target.part(3), int(target.part(4)))


#: Schemes of source trees.
TREES = (("git", "repo"), ("_", "repo"))

LOADERS: dict[tuple[str, str], Loader] = {
    ("aws", "account"): _aws,
    ("okta", "idp"): _okta,
    ("onprem", "postgres"): _postgres,
    **dict.fromkeys(TREES, _tree),
}


def register_loader(provider: str, service: str, loader: Loader) -> None:
    LOADERS[(provider, service)] = loader


def load_target(spark: SparkSession, target: Target) -> Graph:
    """Run the loader of the target's scheme; an unknown scheme lists the known ones."""
    scheme = (target.part(1), target.part(2))
    if scheme not in LOADERS:
        known = ", ".join(f"{p}:{s}" for p, s in sorted(LOADERS))
        raise ValueError(f"no loader for {':'.join(scheme)}; known schemes: {known}")
    return LOADERS[scheme](spark, target)


def load_with_sources(spark: SparkSession, target: Target) -> tuple[Graph, DataFrame | None]:
    """A target's graph, and ``(file_urn, source)`` of its files if it is a source tree."""
    if (target.part(1), target.part(2)) not in TREES:
        return load_target(spark, target), None
    tree = Tree(spark, target)
    return tree.graph(), tree.scan.sources()


def chosen_plugins(mode: str, relevant: list[str], listed: list[str] | None = None) -> list[str]:
    """Plugins to run: an explicit list overrides the mode (all, relevant or manual)."""
    if listed is not None:
        return listed
    if mode == "all":
        return list(SERVICES)
    if mode == "relevant":
        return relevant
    if mode == "manual":
        return []
    raise ValueError(f"unknown plugin mode {mode!r}")
