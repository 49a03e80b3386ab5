"""Who works on what: every key belongs to the node that ranks highest for it (rendezvous hashing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference(node: Column, key: Column) -> Column:
    """A node's rank for a key: the first 8 bytes of SHA-256 of "node:key", as 16 hex digits, which sort alike."""
    return F.substring(F.sha2(F.concat_ws(":", node, key), 256), 1, 16)


def owners(keys: DataFrame, nodes: list[str], key: str = "name") -> DataFrame:
    """key and owner; null without nodes. Each row ranks the nodes by itself: no join, no shuffle."""
    if not nodes:
        return keys.select(key, F.lit(None).cast("string").alias("owner"))
    ranked = F.array(*[F.struct(preference(F.lit(n), F.col(key)).alias("rank"), F.lit(n).alias("node")) for n in nodes])
    return keys.select(key, F.array_max(ranked)["node"].alias("owner"))


def share(leases: int, nodes: int) -> int:
    """How many of the leases one node may hold."""
    return -(-leases // nodes)
