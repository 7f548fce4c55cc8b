"""Nearest-ancestor attributes over parent pointers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from foliograph.catalog import INHERITED_KEYS
from foliograph.session import settle, settle_counting


def inherit_attributes(
    nodes: DataFrame, keys: list[str] = INHERITED_KEYS, scope: list[str] | None = None
) -> DataFrame:
    """Fill the attribute columns ``keys`` of (node_id, parent_id, keys...) from the nearest
    ancestor that has one; an own value wins. Cycles end where they close.
    ``scope`` columns (a document, say) are part of the node identity.
    """
    return take_from_parents(nodes, resolve_parents(nodes, keys, scope), keys, scope)


def resolve_parents(
    nodes: DataFrame, keys: list[str] = INHERITED_KEYS, scope: list[str] | None = None
) -> DataFrame:
    """Every node that is a parent, with its own and inherited values.

    Only these nodes take part in the rounds. Each round doubles the distance a node looks
    up: it takes what its pointer's node knows and then points where that one points, so a
    chain of depth d needs about log2(d) rounds. A round that fills nothing proves that no
    later one can.
    """
    scope = scope or []
    wanted = nodes.select(*scope, F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    inner = settle(
        nodes.select(*scope, "node_id", F.col("parent_id").alias("up"), *keys).join(
            wanted, [*scope, "node_id"], "left_semi"
        )
    )
    filled = 1
    while filled:
        above = inner.select(
            *[F.col(s).alias(f"_a_{s}") for s in scope],
            F.col("node_id").alias("_a_id"),
            F.col("up").alias("_a_up"),
            *[F.col(k).alias(f"_a_{k}") for k in keys],
        )
        match = F.col("up") == F.col("_a_id")
        for s in scope:
            match &= F.col(s) == F.col(f"_a_{s}")
        learns = [F.col(k).isNull() & F.col(f"_a_{k}").isNotNull() for k in keys]
        inner, filled = settle_counting(
            inner.join(above, match, "left")
            .withColumn("_learns", reduce(or_, learns))
            .select(
                *scope,
                "node_id",
                F.col("_a_up").alias("up"),
                *[F.coalesce(k, f"_a_{k}").alias(k) for k in keys],
                "_learns",
            ),
            F.col("_learns"),
        )
        inner = inner.drop("_learns")
    return inner.drop("up")


def take_from_parents(
    nodes: DataFrame, parents: DataFrame, keys: list[str] = INHERITED_KEYS, scope: list[str] | None = None
) -> DataFrame:
    """Fill gaps from the finished parents: one join, whatever the depth."""
    scope = scope or []
    above = parents.select(
        *scope, F.col("node_id").alias("parent_id"), *[F.col(k).alias(f"_a_{k}") for k in keys]
    )
    joined = nodes.join(above, [*scope, "parent_id"], "left")
    return joined.select(
        *[F.coalesce(c, f"_a_{c}").alias(c) if c in keys else F.col(c) for c in nodes.columns]
    )
