"""AWS account loader (S7): services over API dumps, and the account above them."""

from __future__ import annotations

import logging

from palisade.model import PartGraph
from palisade.sources.aws.dump import Dump
from palisade.sources.aws.services import SERVICES, Account, edge, node

log = logging.getLogger(__name__)


def load_account(dump: Dump, account: Account, services: list[str] | None = None) -> PartGraph:
    """Nodes and edges of an account.

    A service whose response shape cannot be resolved is logged and left out, as
    one broken extract must not stop the scan.  The account ``contains`` every
    node whose parent it is.
    """
    root = node(
        dump.spark.range(1), "aws_account", account.root, None, "0", account_id=f"'{account.id}'", region=f"'{account.region}'"
    )
    nodes, edges = [root], []
    for name, service in SERVICES.items():
        if services is not None and name not in services:
            continue
        try:
            found_nodes, found_edges = service(dump, account)
        except Exception:  # noqa: BLE001 - swallowed by design, see above
            log.exception("service %s failed", name)
            continue
        nodes += found_nodes
        edges += found_edges
    below = [
        edge(frame.filter(f"parent_urn = {account.root}").select("parent_urn", "urn", "ord"), "contains", "parent_urn", "urn", "ord")
        for kind, frame in nodes
        if kind != "aws_account"
    ]
    return PartGraph(nodes, [*below, *edges])


__all__ = ["SERVICES", "Account", "Dump", "load_account"]
