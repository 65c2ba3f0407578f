"""Rule queries producing candidates for review (H1-H7)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import ids, meta
from palisade.model import Graph, union_all
from palisade.operators.search import metadata_filter
from palisade.operators.traverse import shortest_paths


@dataclass(frozen=True)
class Rule:
    """A data-driven rule (H6): a filter on sources, optionally paths to filtered destinations."""

    name: str
    source_node_type: str
    metadata_keys: dict[str, object] = field(default_factory=dict)
    metadata_key_op: str = "OR"
    terminal_actions: tuple[str, ...] = ("mark_evaluated",)
    skill_file: str = ""
    instructions: str = ""
    dest_node_type: str | None = None
    dest_node_metadata: dict[str, object] = field(default_factory=dict)
    dest_metadata_key_op: str = "OR"
    forbidden: dict[str, object] = field(default_factory=dict)  # keys that must be absent
    without_edge: tuple[str, str] | None = None  # (direction, edge type) that must not exist

    def to_dict(self) -> dict:
        data = asdict(self)
        data["terminal_actions"] = list(self.terminal_actions)
        return data

    @classmethod
    def from_dict(cls, data: dict) -> Rule:
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__ and v is not None}
        if "terminal_actions" in known:
            known["terminal_actions"] = tuple(known["terminal_actions"])
        if known.get("without_edge"):
            known["without_edge"] = tuple(known["without_edge"])
        return cls(**known)


def _matching(graph: Graph, kind: str, filters: dict[str, object], op: str) -> DataFrame:
    nodes = graph.of_type(kind)
    return nodes.filter(metadata_filter(nodes, filters, op))


def sources(graph: Graph, rule: Rule) -> DataFrame:
    found = _matching(graph, rule.source_node_type, rule.metadata_keys, rule.metadata_key_op)
    for key in rule.forbidden:
        found = found.filter(~meta.present(found, key))
    if rule.without_edge:
        direction, kind = rule.without_edge
        end = "from_urn" if direction == "outgoing" else "to_urn"
        linked = graph.edges_of(kind).select(F.col(end).alias("urn"))
        found = found.join(linked, "urn", "left_anti")
    return found


def find(graph: Graph, rule: Rule) -> DataFrame:
    """Candidates of one rule, in the candidate schema."""
    found = sources(graph, rule)
    base = found.select(
        F.col("urn").alias("source_urn"), F.col("node_type").alias("source_node_type"),
        F.to_json("metadata").alias("source_metadata"),
    )
    fixed = [
        F.lit(rule.name).alias("heuristic_name"),
        F.array(*[F.lit(a) for a in rule.terminal_actions]).alias("terminal_actions"),
        F.lit(rule.skill_file).alias("skill_file"),
    ]
    if rule.dest_node_type is None:
        none = F.lit(None).cast("string")
        return base.select(
            ids.candidate_id(F.col("source_urn"), rule.name).alias("id"), "source_urn", "source_node_type", "source_metadata",
            *fixed, none.alias("dest_urn"), none.alias("dest_node_type"), none.alias("dest_metadata"),
            F.array().cast("array<string>").alias("path"), F.lit("pending").alias("status"),
        )
    dests = _matching(graph, rule.dest_node_type, rule.dest_node_metadata, rule.dest_metadata_key_op)
    ends = dests.select(F.col("urn").alias("dest"), F.col("node_type").alias("dest_node_type"), F.to_json("metadata").alias("dest_metadata"))
    paths = shortest_paths(graph, base.select(F.col("source_urn").alias("urn")), ends.select(F.col("dest").alias("urn")))
    return (
        paths.join(base.withColumnRenamed("source_urn", "source"), "source")
        .join(ends, "dest")
        .select(
            ids.candidate_id(F.col("source"), rule.name, F.col("dest")).alias("id"), F.col("source").alias("source_urn"),
            "source_node_type", "source_metadata", *fixed, F.col("dest").alias("dest_urn"), "dest_node_type",
            "dest_metadata", "path", F.lit("pending").alias("status"),
        )
    )


# --- fixed values: what a reviewer may do about a finding ---------------------
MARK_AND_LINK = ("mark_evaluated", "create_soft_link")
MARK_AND_FIX = ("mark_evaluated", "create_pr")


def builtin_rules(strict: bool = False) -> list[Rule]:
    """H1-H5.  ``strict`` adds to H1/H2 the missing-``builds`` test their names promise."""
    return [
        Rule(
            "unlinked_dockerfile", "file", {"dockerfile_base_images": True},
            terminal_actions=MARK_AND_LINK, skill_file="link-dockerfile-to-ecr.md",
            without_edge=("outgoing", "builds") if strict else None,
        ),
        Rule(
            "orphaned_ecr_repo", "image_repository",
            terminal_actions=MARK_AND_LINK, skill_file="link-dockerfile-to-ecr.md",
            without_edge=("incoming", "builds") if strict else None,
        ),
        Rule(
            "insecure_endpoint", "function", {"http_method": True}, forbidden={"auth_scheme": True},
            terminal_actions=MARK_AND_FIX, skill_file="detect-insecure-endpoint.md",
        ),
        Rule(
            "vulnerable_dependency", "dependency", {"cve_ids": True},
            terminal_actions=MARK_AND_FIX, skill_file="remediate-vulnerable-dependency.md",
        ),
        Rule(
            "unlinked_entrypoint", "file", {"dockerfile_entrypoint": True, "dockerfile_cmd": True},
            terminal_actions=MARK_AND_LINK, skill_file="link-dockerfile-to-entrypoint.md",
            without_edge=("outgoing", "executes"),
        ),
    ]


def gather(graph: Graph, names: list[str] | None = None, extra: tuple[Rule, ...] = (), strict: bool = False) -> DataFrame:
    """H7: candidates of all (named) rules in one frame."""
    chosen = [r for r in (*builtin_rules(strict), *extra) if names is None or r.name in names]
    if not chosen:
        raise ValueError(f"no rule named any of {names}")
    return union_all([find(graph, r) for r in chosen])


def drop_evaluated(candidates: DataFrame, graph: Graph, names: list[str]) -> DataFrame:
    """H7: drop candidates whose source carries ``<rule>_last_evaluated_at``."""
    nodes = graph.nodes
    marks = [
        F.when(meta.present(nodes, f"{n}_last_evaluated_at"), F.lit(n)) for n in names
    ]
    done = nodes.select(
        F.col("urn").alias("source_urn"), F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("heuristic_name")
    )
    return candidates.join(done, ["source_urn", "heuristic_name"], "left_anti").select(*candidates.columns)


def candidate_histogram(candidates: DataFrame) -> DataFrame:
    """Candidates per rule."""
    return candidates.groupBy("heuristic_name").agg(F.count("*").alias("n"))
