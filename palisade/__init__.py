"""Security knowledge graphs as Spark DataFrames."""

from palisade.model import Graph

__all__ = ["Graph"]
