"""Identity: directory people to SSO users (J10), SSO to IAM roles (J11), role trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import meta
from palisade.model import Graph, union_all
from palisade.operators.stitch.common import LATER, first_by, last_by, new_edges

# --- fixed values: names AWS generates, and the actions that grant a role ------
RESERVED_ROLE = r"^AWSReservedSSO_(.+)_[0-9a-fA-F]{8,16}$"
ASSUME_ACTIONS = ["*", "sts:*", "sts:AssumeRole", "sts:AssumeRoleWithSAML", "sts:AssumeRoleWithWebIdentity"]
WILDCARD_URN = "urn:aws:iam:wildcard::*"
ACCOUNT_ROOT = r"^arn:aws:iam::(\d{12}):root$"
SAML_PROVIDER = r"^arn:aws:iam::(\d{12}):saml-provider/(.+)$"
INTERNAL_SAML = r"AWSSSO_[0-9a-fA-F]+_DO_NOT_DELETE$"


def person_to_sso_user(graph: Graph) -> DataFrame:
    """``okta:maps_to`` edges by external id, else by e-mail; the first user of a key wins."""
    users = graph.of_type("sso_user")
    view = users.select(
        meta.get(users, "sso_user_external_id").alias("ext"), F.lower(meta.get(users, "sso_user_email")).alias("mail"), "urn", "ord"
    )
    by_ext = first_by(view.filter("ext <> ''").withColumnRenamed("urn", "ext_urn"), "ext", "ext_urn")
    by_mail = first_by(view.filter("mail <> ''").withColumnRenamed("urn", "mail_urn"), "mail", "mail_urn")
    people = graph.of_type("person")
    asked = people.select(
        "urn", "ord", meta.get(people, "person_okta_id").alias("ext"), F.lower(meta.get(people, "person_email")).alias("mail")
    )
    found = asked.join(by_ext, "ext", "left").join(by_mail, "mail", "left").withColumn("sso_urn", F.coalesce("ext_urn", "mail_urn"))
    by_id = F.col("ext_urn").isNotNull()
    return new_edges(
        found.filter("sso_urn is not null").withColumnRenamed("urn", "person_urn"), "okta:maps_to", 10, "person_urn", "sso_urn", F.col("ord"),
        detection_method="okta_to_identity_center", match_key=F.when(by_id, "externalId").otherwise("email"),
        match_value=F.when(by_id, F.col("ext")).otherwise(F.col("mail")), confidence=F.when(by_id, 1.0).otherwise(0.85),
    )


def role_account(urn: Column, compat: bool = False) -> Column:
    """Account of a role URN, in the plain and (unless ``compat``) the ARN-wrapped shape."""
    plain = F.when(urn.startswith("urn:aws:iam:"), F.nullif(F.element_at(F.split(urn, ":"), 4), F.lit("")))
    if compat:
        return plain
    wrapped = F.when(urn.startswith("urn:arn:aws:iam::"), F.nullif(F.element_at(F.split(urn, ":"), 6), F.lit("")))
    return F.coalesce(plain, wrapped)


def provisioned_roles(graph: Graph, compat: bool = False) -> DataFrame:
    """Permission sets matched with the roles generated for them, one row per match."""
    sets, roles = graph.of_type("aws:permission_set"), graph.of_type("iam_role")
    wanted = sets.select(
        F.col("urn").alias("ps_urn"), F.col("ord").alias("ps_ord"), F.replace(meta.get(sets, "permission_set_name"), F.lit(" "), F.lit("")).alias("name"),
        meta.get(sets, "permission_set_arn").alias("ps_arn"),
    ).filter("name <> ''")
    generated = roles.select(
        F.col("urn").alias("role_urn"), F.col("ord").alias("role_ord"), F.regexp_extract(meta.get(roles, "role_name"), RESERVED_ROLE, 1).alias("name"),
        role_account(F.col("urn"), compat).alias("account"),
    ).filter("name <> '' and account is not null")
    return wanted.join(generated, "name")


def sso_to_iam(graph: Graph, compat: bool = False) -> DataFrame:
    """``assumes`` edges permission set -> role, principal -> role, and members of groups -> role.

    A role that a user has both by an own assignment and through groups is through the group
    that was assigned last: group edges come after all others.
    """
    matches = provisioned_roles(graph, compat)
    structural = new_edges(
        matches, "assumes", 11, "ps_urn", "role_urn", F.col("ps_ord"),
        assumed_via="iam:permission_set_role", account_id=F.col("account"), permission_set_arn=F.col("ps_arn"),
    )
    # of several roles for one (set, account) the last one counts from here on
    chosen = last_by(matches, ["ps_urn", "ps_arn", "account"], "role_urn", "role_ord")
    assigned = graph.edges_of("sso:assigned_to")
    granted = assigned.select(
        F.col("from_urn").alias("principal"), F.col("to_urn").alias("ps_urn"), meta.get(assigned, "account_id").alias("account"), "ord"
    ).join(chosen, ["ps_urn", "account"])
    direct = new_edges(
        granted, "assumes", 11, "principal", "role_urn", F.col("ord"),
        assumed_via="sso:permission_set", account_id=F.col("account"), permission_set_arn=F.col("ps_arn"),
    )
    groups = graph.of_type("sso_group").select(F.col("urn").alias("principal"))
    members = graph.edges_of("member_of").select(F.col("from_urn").alias("member"), F.col("to_urn").alias("principal"))
    fanned = granted.join(groups, "principal", "left_semi").join(members, "principal")
    via_group = new_edges(
        fanned, "assumes", 11, "member", "role_urn", F.col("ord") + LATER,
        assumed_via="sso:permission_set", account_id=F.col("account"), via_group=F.col("principal"), permission_set_arn=F.col("ps_arn"),
    )
    return union_all([structural, direct, via_group])


def _texts(value: Column, path: str) -> Column:
    """A JSON field that is one string or a list of strings, as an array; empty when missing."""
    many = F.try_variant_get(value, path, "array<string>")
    one = F.try_variant_get(value, path, "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def trust_statements(graph: Graph) -> DataFrame:
    """Allow statements of all role trust policies that grant assuming the role."""
    roles = graph.of_type("iam_role")
    policy = meta.get(roles, "iam_trust_policy")
    many = F.try_variant_get(policy, "$.Statement", "array<variant>")
    one = F.try_variant_get(policy, "$.Statement", "variant")
    stated = roles.select(
        F.col("urn").alias("role_urn"), "ord", F.posexplode(F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).alias("no", "stmt")
    )
    stmt = F.col("stmt")
    return stated.filter(
        (F.try_variant_get(stmt, "$.Effect", "string") == "Allow")
        & F.exists(_texts(stmt, "$.Action"), lambda a: a.isin(ASSUME_ACTIONS))
    )


def role_trust(graph: Graph) -> DataFrame:
    """``assumes`` edges from whoever a role's trust policy admits.

    Wildcards, account roots and federated providers get synthetic, dangling
    source URNs; AWS services, unknown ARNs and the role itself get no edge.
    """
    stmt = F.col("stmt")
    anyone = F.try_variant_get(stmt, "$.Principal", "map<string,variant>").isNull() & (
        F.try_variant_get(stmt, "$.Principal", "string") == "*"
    )
    aws = F.when(anyone, F.array(F.lit("*"))).otherwise(_texts(stmt, "$.Principal.AWS"))
    tag = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("who"))
    named = F.concat(F.transform(aws, tag("aws")), F.transform(_texts(stmt, "$.Principal.Federated"), tag("federated")))
    principals = trust_statements(graph).select(
        "role_urn", "ord", F.try_variant_get(stmt, "$.Condition", "variant").alias("condition"), F.col("no"), F.posexplode(named).alias("pos", "p")
    ).select("role_urn", "ord", "condition", "no", "pos", "p.*")
    roles = graph.of_type("iam_role")
    by_arn = last_by(roles.select(meta.get(roles, "arn").alias("who"), F.col("urn").alias("source_urn"), "ord").filter("who <> ''"), ["who"], "source_urn")
    known = principals.join(by_arn.withColumn("kind", F.lit("aws")), ["kind", "who"], "left")
    who, is_aws = F.col("who"), F.col("kind") == "aws"
    root = F.nullif(F.regexp_extract("who", ACCOUNT_ROOT, 1), F.lit(""))
    account, name = F.regexp_extract("who", SAML_PROVIDER, 1), F.regexp_extract("who", SAML_PROVIDER, 2)
    saml = name != ""
    via = (
        F.when(is_aws & (who == "*"), "iam:trust_policy_wildcard")
        .when(is_aws & root.isNotNull(), "iam:trust_policy_account_root")
        .when(is_aws, "iam:trust_policy")
        .when(saml, "iam:trust_policy_saml")
        .otherwise("iam:trust_policy_federated")
    )
    source = (
        F.when(is_aws & (who == "*"), F.lit(WILDCARD_URN))
        .when(is_aws & root.isNotNull(), F.concat(F.lit("urn:aws:iam:"), root, F.lit("::root")))
        .when(is_aws, F.when(F.col("source_urn") != F.col("role_urn"), F.col("source_urn")))
        .when(saml & name.rlike(INTERNAL_SAML), F.lit(None))
        .when(saml, F.concat(F.lit("urn:aws:iam:"), account, F.lit("::saml-provider/"), name))
        .otherwise(F.concat(F.lit("urn:aws:iam:federated::"), who))
    )
    flag = F.when(via == "iam:trust_policy_wildcard", "wildcard").when(via == "iam:trust_policy_account_root", "account_root")
    linked = known.select(
        "role_urn", source.alias("from"), via.alias("via"), flag.alias("flag"), F.when(is_aws & root.isNotNull(), root).alias("account"),
        F.when(~is_aws, who).alias("provider"), "condition", (F.col("ord") + F.col("no") * 64 + F.col("pos")).alias("ord"),
    ).filter(F.col("from").isNotNull())
    return new_edges(
        linked, "assumes", 12, "from", "role_urn", F.col("ord"), assumed_via=F.col("via"), insecure_trust_policy=F.col("flag"),
        account_id=F.col("account"), saml_provider_arn=F.col("provider"), trust_policy_condition=F.col("condition"),
    )
