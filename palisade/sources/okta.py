"""Okta directory from API extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.build import stable_ordinal
from palisade.model import PartGraph
from palisade.sources.aws.services import edge, node

# --- fixed values: the response fields the loader reads, per resource ---------
SCHEMAS = {
    "users": "id string, status string, profile struct<email:string,login:string,firstName:string,lastName:string>",
    "groups": "id string, profile struct<name:string,description:string>",
    "apps": "id string, name string, label string, signOnMode string, status string",
    "group_users": "group_id string, user_id string",
    "app_users": "app_id string, user_id string",
    "app_groups": "app_id string, group_id string",
    "app_group_push": "app_id string, source_group_id string",
}


def read_extract(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}.json") for name, schema in SCHEMAS.items()}


def load_directory(frames: dict[str, DataFrame], domain: str) -> PartGraph:
    """People, groups and applications with their links; unknown ends drop out."""
    urn = lambda kind, key: f"concat('urn:okta:idp:{domain}::{kind}/', {key})"
    full = "nullif(trim(concat(coalesce(profile.firstName, ''), ' ', coalesce(profile.lastName, ''))), '')"
    apps = frames["apps"].filter("id <> ''")
    users, groups = frames["users"], frames["groups"]
    known = {
        "user_id": users.selectExpr("id as user_id"), "group_id": groups.selectExpr("id as group_id"), "app_id": apps.selectExpr("id as app_id"),
    }

    def links(name: str, kind: str, src: tuple[str, str], dst: tuple[str, str]) -> tuple[str, DataFrame]:
        rows = frames[name]
        if "source_group_id" in rows.columns:
            rows = rows.withColumnRenamed("source_group_id", "group_id")
        for _, key in (src, dst):
            rows = rows.join(known[key], key, "left_semi")
        return edge(rows, kind, urn(*src), urn(*dst), stable_ordinal(src[1], dst[1]))

    nodes = [
        node(
            users, "person", urn("user", "id"), None, stable_ordinal("id"), person_okta_id="id", person_email="profile.email",
            person_login="profile.login", person_status="status", person_display_name=full,
        ),
        node(groups, "group", urn("group", "id"), None, stable_ordinal("id"), group_okta_id="id", group_name="profile.name", group_description="profile.description"),
        node(
            apps, "application", urn("app", "id"), None, stable_ordinal("id"), app_okta_id="id", app_name="name", app_label="label",
            app_sign_on_mode="signOnMode", app_status="status",
        ),
    ]
    user, group, app = ("user", "user_id"), ("group", "group_id"), ("app", "app_id")
    edges = [
        links("group_users", "okta:part_of", user, group),
        links("app_users", "okta:assigned_to", user, app),
        links("app_groups", "okta:assigned_to", group, app),
        links("app_group_push", "okta:pushes_to", group, app),
    ]
    return PartGraph(nodes, edges)
