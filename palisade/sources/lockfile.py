"""Dependency lock files and vulnerability extracts."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.build import edge_frame, node_frame
from palisade.model import Graph, union_all

LOCK_SCHEMA = "codebase_urn string, name string, version string, dependencies array<struct<name:string,version:string>>"
#: What is known of a package version, as the vulnerability service answers: one JSON line for each.
VULNERABILITIES = "name string, version string, vulns array<struct<id:string,aliases:array<string>>>"


def packages(locks: DataFrame) -> DataFrame:
    """Package rows of ``uv.lock`` texts; ``locks`` is ``(codebase_urn, source)``.

    Lock files are TOML, which Spark cannot read, so each is parsed where it
    lies; an unreadable file gives no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    listed = tomllib.loads(row.source).get("package", [])
                except tomllib.TOMLDecodeError:
                    continue
                found = [
                    {"codebase_urn": row.codebase_urn, "name": p.get("name", ""), "version": p.get("version", ""),
                     "dependencies": [{"name": d.get("name", ""), "version": d.get("version")} for d in p.get("dependencies", [])]}
                    for p in listed
                ]
                yield pd.DataFrame(found, columns=["codebase_urn", "name", "version", "dependencies"])

    return locks.select("codebase_urn", "source").mapInPandas(parse, LOCK_SCHEMA)


def read_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """An extract of the vulnerability service's answers, one package version a line."""
    return spark.read.schema(VULNERABILITIES).json(path)


def vulnerability_ids(vulns: Column, prefix: str = "CVE-") -> Column:
    """Sorted distinct ids of one family among ids and aliases of OSV records."""
    names = F.flatten(F.transform(vulns, lambda v: F.concat(F.array(v["id"]), F.coalesce(v["aliases"], F.array().cast("array<string>")))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.startswith(prefix))))


def dependency_rows(rows: DataFrame) -> DataFrame:
    """``packages``' rows, one per locked version, with ``dep``, the last part of its URN.

    A package that is locked once is known by its name; one that is locked in several versions
    is a node for each, known by name and version.
    """
    locked = rows.filter("name <> '' and version <> ''").groupBy("codebase_urn", "name", "version").agg(
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("dependencies", F.array().cast("array<struct<name:string,version:string>>"))))).alias("dependencies")
    )
    per_name = locked.groupBy(F.col("codebase_urn").alias("n_base"), F.col("name").alias("n_name")).agg(F.count("*").alias("versions"))
    many = locked.join(per_name, (F.col("codebase_urn") == F.col("n_base")) & (F.col("name") == F.col("n_name")))
    dep = F.when(F.col("versions") > 1, F.concat("name", F.lit("@"), "version")).otherwise(F.col("name"))
    return many.select("codebase_urn", "name", "version", "dependencies", dep.alias("dep"))


def load_lock(rows: DataFrame, osv: DataFrame | None = None) -> Graph:
    """Manifest and dependency nodes with ``depends_on`` edges, direct and transitive.

    ``rows`` as :func:`packages` gives them; ``osv`` as :func:`read_vulnerabilities` does, joined by
    name and exact version.  A dependency on a package leads to the version that the lock file states, to
    all locked ones where it states none.
    """
    valid = dependency_rows(rows)
    if osv is not None:
        known = osv.select(F.col("name").alias("v_name"), F.col("version").alias("v_version"), F.explode(vulnerability_ids(F.col("vulns"))).alias("id"))
        ids = known.groupBy("v_name", "v_version").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("cve_ids"))
        valid = valid.join(ids, (F.col("name") == F.col("v_name")) & (F.col("version") == F.col("v_version")), "left")
    else:
        valid = valid.withColumn("cve_ids", F.lit(None).cast("string"))
    order = "xxhash64(codebase_urn, dep) & 281474976710655L"
    manifest, dep = "concat(codebase_urn, '/uv.lock')", "concat(codebase_urn, '/dep/', dep)"
    roots = rows.select("codebase_urn").distinct()
    needs = valid.select("codebase_urn", "dep", F.explode("dependencies").alias("d")).select("codebase_urn", "dep", "d.name", F.col("d.version").alias("wanted"))
    targets = valid.select(F.col("codebase_urn").alias("t_base"), F.col("name").alias("t_name"), "version", F.col("dep").alias("target"))
    links = needs.join(targets, (F.col("codebase_urn") == F.col("t_base")) & (F.col("name") == F.col("t_name"))).filter("wanted is null or wanted = version")
    links = links.select("codebase_urn", "dep", "target").distinct()
    return Graph(
        union_all([
            node_frame(
                roots, "package_manifest", manifest, "codebase_urn", "xxhash64(codebase_urn) & 281474976710655L",
                package_manager="'uv'", manifest_file="'uv.lock'", package_ecosystem="'PyPI'",
            ),
            node_frame(
                valid, "dependency", dep, manifest, order, package_name="name", package_version="version", package_ecosystem="'PyPI'", cve_ids="cve_ids",
            ),
        ]),
        union_all([
            edge_frame(roots, "contains", "codebase_urn", manifest, "xxhash64(codebase_urn) & 281474976710655L"),
            edge_frame(valid, "depends_on", manifest, dep, order),
            edge_frame(links, "depends_on", dep, "concat(codebase_urn, '/dep/', target)", "xxhash64(codebase_urn, dep, target) & 281474976710655L"),
        ]),
    )
