"""Containers: Dockerfiles to image repositories (J3) and code files (J4), tasks to repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import docker, meta, scalars
from palisade.model import Graph, union_all
from palisade.operators.stitch.common import index_by, last_by, new_edges

# --- fixed values: one suffix a repository name may carry over its codebase's --
SERVICE_SUFFIX = r"[-_](api|app|service|server|web)$"


def _repositories(graph: Graph) -> DataFrame:
    repos = graph.of_type("image_repository")
    named = repos.select(meta.get(repos, "repository_name").alias("repo"), F.col("urn").alias("repo_urn"), "ord").filter("repo <> ''")
    return named.groupBy("repo").agg(F.max_by("repo_urn", "ord").alias("repo_urn"), F.max("ord").alias("ord"))


def _dockerfiles(graph: Graph) -> DataFrame:
    files = graph.of_type("file")
    return files.filter(meta.present(files, "dockerfile_base_images") & F.col("parent_urn").isNotNull()).select(
        F.col("urn").alias("file_urn"), F.col("parent_urn").alias("codebase_urn"), F.col("ord").alias("file_ord")
    )


def _labelled_repositories(graph: Graph, repos: DataFrame) -> DataFrame:
    """Repositories whose (last labelled) image names a known codebase as its source."""
    images = graph.of_type("image")
    sources = images.select(
        F.col("parent_urn").alias("repo_urn"), meta.get(images, "oci_source").alias("oci_source"), "ord"
    ).filter("oci_source <> '' and repo_urn is not null")
    stated = last_by(sources, ["repo_urn"], "oci_source").withColumn("url", scalars.repo_key(F.col("oci_source")))
    bases = graph.of_type("codebase")
    url = lambda key, rank: bases.select(
        meta.get(bases, key).alias("raw"), F.col("urn").alias("codebase_urn"), F.struct("ord", F.lit(rank)).alias("order")
    )
    urls = url("repo_url", 0).unionByName(url("clone_url", 1)).filter("raw <> ''")
    by_url = last_by(urls.withColumn("url", scalars.repo_key(F.col("raw"))), ["url"], "codebase_urn", "order")
    return repos.join(stated, "repo_urn").join(by_url, "url").select("repo", "repo_urn", "codebase_urn")


def _name_matched(graph: Graph, repos: DataFrame) -> DataFrame:
    bases = graph.of_type("codebase")
    named = bases.select(meta.get(bases, "repo_name").alias("name"), F.col("urn").alias("codebase_urn"), "ord").filter("name <> ''")
    by_name = last_by(named, ["name"], "codebase_urn")
    base = F.substring_index("repo", "/", -1)
    guesses = repos.select("repo", "repo_urn", base.alias("name"), F.regexp_replace(base, SERVICE_SUFFIX, "").alias("bare"))
    return (
        guesses.join(by_name, "name", "left")
        .join(by_name.select(F.col("name").alias("bare"), F.col("codebase_urn").alias("bare_urn")), "bare", "left")
        .select("repo", "repo_urn", F.coalesce("codebase_urn", "bare_urn").alias("codebase_urn"))
        .filter("codebase_urn is not null")
    )


def dockerfile_to_image_repo(graph: Graph) -> DataFrame:
    """``builds`` edges by OCI source label, else by name.

    A repository whose label names a known codebase counts as linked even when
    that codebase has no Dockerfile, so the name guess never applies to it.
    """
    repos, files = _repositories(graph), _dockerfiles(graph)
    labelled = _labelled_repositories(graph, repos)
    guessed = _name_matched(graph, repos.join(labelled, "repo", "left_anti"))
    edges = lambda found, method, score: new_edges(
        found.join(files, "codebase_urn"), "builds", 3, "file_urn", "repo_urn", F.col("file_ord"),
        detection_method=method, confidence=score,
    )
    return union_all([edges(labelled, "oci_label", 1.0), edges(guessed, "name_heuristic", 0.8)])


def dockerfile_to_entrypoint(graph: Graph) -> DataFrame:
    """``executes`` edges to the file a Dockerfile runs, within its codebase."""
    files = graph.of_type("file")
    view = files.select(
        "urn", "parent_urn", "ord", meta.get(files, "file_path").alias("path"),
        meta.get(files, "dockerfile_entrypoint").alias("entrypoint"), meta.get(files, "dockerfile_cmd").alias("cmd"),
        meta.get(files, "dockerfile_workdir").alias("workdir"), meta.get(files, "dockerfile_copy_targets").alias("copies"),
    ).filter("parent_urn is not null")
    registry = last_by(view.filter("path is not null").withColumnRenamed("urn", "target_urn"), ["parent_urn", "path"], "target_urn")
    runs = view.filter("entrypoint is not null or cmd is not null").withColumn(
        "target", docker.target_file(F.coalesce(F.nullif("entrypoint", F.lit("")), "cmd"))
    )
    copies = F.filter(F.split("copies", ","), lambda c: c != "")
    mapped = runs.filter("target is not null").select(
        F.col("urn").alias("file_urn"), "parent_urn", "ord", docker.repo_path(F.col("target"), F.col("workdir"), copies).alias("path")
    )
    linked = mapped.filter("path <> ''").join(registry, ["parent_urn", "path"])
    return new_edges(linked, "executes", 4, "file_urn", "target_urn", F.col("ord"), detection_method="static_parse", confidence=0.9)


def ecs_task_to_repository(graph: Graph) -> DataFrame:
    """``references`` edges from task definitions to the repositories of their images."""
    tasks = graph.of_type("ecs_task_definition")
    images = tasks.select("urn", "ord", F.posexplode(meta.get(tasks, "ecs_container_images")).alias("pos", "image"))
    uri = F.substring_index(F.substring_index("image", ":", 1), "@", 1)
    linked = images.withColumn("repository_uri", uri).join(index_by(graph.nodes, "repository_uri", "repo_urn"), "repository_uri")
    return new_edges(
        linked.withColumnRenamed("urn", "task_urn"), "references", 6, "task_urn", "repo_urn", F.col("ord") + F.col("pos"),
        detection_method="image_uri_match", confidence=1.0,
    )
