"""Placement of keys: by hash on shards, or on virtual shards that a table maps to groups."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.hashing import fnv1a, shard_of


@dataclass
class Placement:
    """vshards[i] is the group that owns virtual shard i. Every change makes a new version."""

    groups: int
    vshards: list[int] = field(default_factory=list)
    version: int = 0

    @classmethod
    def round_robin(cls, vshards: int, groups: int) -> Placement:
        return cls(groups, [i % groups for i in range(vshards)])

    def reassign(self, vshard: int, group: int) -> Placement:
        if not 0 <= vshard < len(self.vshards):
            raise ValueError(f"virtual shard {vshard} is not in 0..{len(self.vshards) - 1}")
        if not 0 <= group < self.groups:
            raise ValueError(f"group {group} is not in 0..{self.groups - 1}")
        new = list(self.vshards)
        new[vshard] = group
        return Placement(self.groups, new, self.version + 1)

    def owner(self, key: str) -> int:
        """The group that owns a key; -1 without virtual shards."""
        return self.vshards[fnv1a(key) % len(self.vshards)] if self.vshards else -1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.vshards)), "vshard int, group int")

    def vshard_column(self, key: Column) -> Column:
        return shard_of(key, len(self.vshards)) if self.vshards else F.lit(-1)

    def owned(self, docs: DataFrame, group: int, key: str = "doc_key") -> DataFrame:
        """The documents of a group. An empty table owns nothing."""
        if not self.vshards:
            return docs.where(F.lit(False))
        owners = F.array(*map(F.lit, self.vshards))
        return docs.where(F.get(owners, self.vshard_column(F.col(key))) == group)

    def save(self, path: str) -> None:
        """Replaced as a whole: a reader sees the old table or the new one."""
        folder = os.path.dirname(path) or "."
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
            json.dump({"groups": self.groups, "vshards": self.vshards, "version": self.version}, f)
        os.replace(f.name, path)

    @classmethod
    def load(cls, path: str) -> Placement:
        with open(path) as f:
            return cls(**json.load(f))


def owned_modulo(docs: DataFrame, shard: int, shards: int, key: str = "doc_key") -> DataFrame:
    """The documents of one of ``shards`` shards by hash."""
    return docs.where(shard_of(F.col(key), shards) == shard)
