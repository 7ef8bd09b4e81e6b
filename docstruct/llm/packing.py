"""Problem 8: fixed-capacity containers filled by bounded-space online best fit.

Items come one by one; a fixed number of containers is open. The open
containers are kept in a bitset keyed by their free space (bit f is set if some
open container has f units free), so the best fit is the lowest set bit at or
above the item's size. If none fits and all places are taken, the fullest
container, the lowest set bit, closes first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.tokenize import BYTE_BPE_50K, count_tokens
from docstruct.scale import config_rows

#: Containers open at a time in a shard.
OPEN_BINS = 512
#: Items a shard has on average; shards are packed independently of each other.
SHARD_ITEMS = 40_000


class BestFit:
    """The state of one shard: place items with ``put``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # the bitset
        self.at: dict[int, list[int]] = {}  # containers by free space
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        same = self.at[space]
        b = same.pop()
        if not same:
            self.free ^= 1 << space
        return b

    def put(self, size: int) -> int:
        """The container of an item with 0 <= size <= capacity."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.n_open -= 1
            b, space = self.n_bins, self.capacity
            self.n_bins += 1
            self.n_open += 1
        left = space - size
        if left:
            self.at.setdefault(left, []).append(b)
            self.free |= 1 << left
        else:
            self.n_open -= 1
        return b


def pieces(size: int, capacity: int) -> list[int]:
    """An item's pieces: the item itself, or full pieces and the rest if it exceeds the capacity."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * (rest > 0)


def pack(items: DataFrame, profiles: list[tuple[str, int]], key: str, size: str, n_shards: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Assign every item to a container of each profile.

    Columns: profile_name, container_id, ``key``, piece_no, first_unit, n_units.
    An item larger than the capacity is cut into full pieces and a rest; other
    items are never cut. A null size counts as 0; an item of size 0 takes no
    space and goes to the fullest open container. Repeated rows are items of
    their own. Items go to ``n_shards`` shards by the hash of key and size and are packed in the order of key and size, so
    the result does not depend on how the input is partitioned; equal rows share a shard.
    """
    key_type = items.schema[key].dataType
    schema = T.StructType([
        T.StructField("profile_name", T.StringType()), T.StructField("container_id", T.LongType()),
        T.StructField(key, key_type), T.StructField("piece_no", T.IntegerType()),
        T.StructField("first_unit", T.LongType()), T.StructField("n_units", T.LongType()),
    ])
    caps = dict(profiles)

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        profile, shard = group
        capacity = caps[profile]
        bins = BestFit(capacity, open_bins)
        pdf = pdf.sort_values(["item_key", "item_size"], kind="stable", na_position="first")
        rows, nos, firsts, counts, where = [], [], [], [], []
        for i, n in enumerate(pdf["item_size"].tolist()):
            first = 0
            for no, part in enumerate(pieces(n, capacity)):
                rows.append(i)
                nos.append(no)
                firsts.append(first)
                counts.append(part)
                where.append(bins.put(part))
                first += part
        out = pd.DataFrame({"profile_name": profile, "container_id": where, key: pdf["item_key"].iloc[rows].array, "piece_no": nos, "first_unit": firsts, "n_units": counts})
        out["container_id"] += int(shard) << 32
        return out

    shard = F.pmod(F.xxhash64(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0))), F.lit(n_shards)).cast("int")
    names = F.array(*[F.lit(n) for n, _ in profiles])
    return (
        items.select(F.col(key).alias("item_key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("item_size"), shard.alias("shard"))
        .withColumn("profile", F.explode(names))
        .groupBy("profile", "shard")
        .applyInPandas(run, schema)
    )


def pack_texts(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K, prefix: str = "pack_") -> DataFrame:
    """``pack`` for texts sized in tokens, with the token profiles whose name starts with ``prefix``.

    An empty table, or no such profile, gives an empty result.
    """
    wanted = config_rows(profiles.filter(F.col("profile_name").startswith(prefix) & (F.col("unit_name") == "token")).select("profile_name", "capacity"))
    chosen = sorted({(r[0], int(r[1])) for r in wanted})
    n_shards = max(1, -(-docs.count() // SHARD_ITEMS))
    sizes = count_tokens(docs, key, text, path)
    if not chosen:
        chosen, sizes = [("none", 1)], sizes.limit(0)
    return pack(sizes, chosen, key, "n_tokens", n_shards)
