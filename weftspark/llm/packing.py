"""Items of varying length laid into containers of fixed capacity.

Hierarchical multi-length packing: items go to tiers by size; the longest tier opens containers, whose gaps are filled from
the shorter tiers, longest that fits first; what is left of each shorter tier opens containers of its own and is filled up the
same way. Containers are dealt to step groups so that each group's load is even.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftspark.llm.tokens import TOKENIZER, count_tokens
from weftspark.util import cut, maybe_broadcast, spread

CAPACITY = 2048
#: Upper bounds of the tiers.
TIERS = (256, 512, 1024, 2048)
#: Tokens per shard. A shard is packed in one task; its last containers may stay part empty, under a thousandth of it.
SHARD_TOKENS = 8_000_000
#: Containers per step group.
GROUP = 32


def pack(sizes: list[int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[list[int]]:
    """Containers as lists of item numbers, in order. No size exceeds the capacity; items of size 0 go into the last container."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by_size.setdefault(n, []).append(i)
    empty = by_size.pop(0, [])
    for v in by_size.values():
        v.reverse()  # taken from the end: in the order given
    bounds = [0, *[t for t in sorted(tiers) if t < capacity], capacity]
    tier_sizes = [sorted(n for n in by_size if lo < n <= hi) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    out: list[list[int]] = []

    def take(tier: list[int], room: int) -> int:
        """The largest size of the tier that fits."""
        k = bisect_right(tier, room) - 1
        return tier[k] if k >= 0 else 0

    def draw(tier: list[int], n: int) -> int:
        items = by_size[n]
        i = items.pop()
        if not items:
            del by_size[n]
            tier.remove(n)
        return i

    for t in range(len(tier_sizes) - 1, -1, -1):
        tier = tier_sizes[t]
        while tier:
            n = tier[-1]
            box, room = [draw(tier, n)], capacity - n
            while room:
                for s in range(t, -1, -1):
                    n = take(tier_sizes[s], room)
                    if n:
                        # two items that fill the gap to the token beat the one largest that leaves some
                        if n < room and (pair := _pair(tier_sizes[: s + 1], by_size, room)):
                            for p in pair:
                                at = next(x for x in tier_sizes if p in x)
                                box.append(draw(at, p))
                            room = 0
                            break
                        box.append(draw(tier_sizes[s], n))
                        room -= n
                        break
                else:
                    break
            out.append(box)
    if empty:
        if not out:
            out.append([])
        out[-1] += empty
    return out


def _pair(tiers: list[list[int]], by_size: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """Two sizes that add up to the room exactly; the larger first. Only tried for rooms of at most the two lowest tiers."""
    if room > 512:
        return None
    for tier in reversed(tiers):
        for n in reversed(tier[: bisect_right(tier, room - 1)]):
            if n * 2 < room:
                return None
            other = room - n
            if other in by_size and (other != n or len(by_size[n]) > 1):
                return n, other
    return None


def deal(loads: list[int], group: int = GROUP) -> list[int]:
    """Group number of each container: groups of equal size, loads dealt back and forth from the heaviest, so that group totals are even."""
    n = max(1, (len(loads) + group - 1) // group)
    order = sorted(range(len(loads)), key=lambda i: (-loads[i], i))
    out = [0] * len(loads)
    for k, i in enumerate(order):
        turn, at = divmod(k, n)
        out[i] = at if turn % 2 == 0 else n - 1 - at
    return out


_PLACED = "shard long, item_id long, part long, tokens int, box long, position int, step_group long"


def _pack_shard(capacity: int, tiers: tuple[int, ...], group: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "part", "tokens"], kind="stable", ignore_index=True)
        boxes = pack(pdf["tokens"].tolist(), capacity, tiers)
        n = pdf["tokens"].to_numpy()
        groups = deal([int(n[b].sum()) for b in boxes], group)
        at = [(i, k, p, groups[k]) for k, b in enumerate(boxes) for p, i in enumerate(b)]
        order, box, position, step = zip(*at, strict=True)
        out = pdf.iloc[list(order)].copy()
        out["box"], out["position"], out["step_group"] = box, position, step
        return out[["shard", "item_id", "part", "tokens", "box", "position", "step_group"]]

    return run


def containers(sized: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, shard_tokens: int = SHARD_TOKENS, group: int = GROUP) -> DataFrame:
    """(id, part, first_token, tokens, container, position, step_group) from (id, tokens).

    Items above the capacity are split into full parts and a rest, no others. Items are hashed to shards of about
    shard_tokens, each packed in one task, so neither a task nor the driver holds more than a shard; container and
    group numbers run through all shards by the sums of the shards before. Items of 0 or null tokens take a place of 0 tokens.
    Repeated rows are items of their own. An empty table gives no container.
    """
    items = sized.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("int").alias("n"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)) - 1)
    items = items.select("item_id", "n", F.explode(parts).alias("part")).select("item_id", "part", F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    items = cut(items)
    total = items.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "part", F.lit(11)), F.lit(shards)))
    placed = cut(spread.groupBy("shard").applyInPandas(_pack_shard(capacity, tiers, group), _PLACED))
    # one row per shard: the window over all of them is over shards, not rows
    used = placed.groupBy("shard").agg((F.max("box") + 1).alias("boxes"), (F.max("step_group") + 1).alias("groups"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offset = used.select("shard", F.coalesce(F.sum("boxes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("groups").over(before), F.lit(0)).alias("g0"))
    out = placed.join(maybe_broadcast(offset), "shard")
    return out.select(F.col("item_id").alias(id_col), F.col("part").cast("int").alias("part"), (F.col("part") * capacity).cast("int").alias("first_token"), "tokens", (F.col("box") + F.col("b0")).alias("container"), "position", (F.col("step_group") + F.col("g0")).alias("step_group"))


def pack_documents(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Documents, sized in tokens of the tokenizer, in containers."""
    return containers(spread(documents.select("doc_id", "text")).select("doc_id", count_tokens(F.col("text"), path).alias("tokens")), capacity=capacity)
