"""Filling fixed-capacity containers with items of varying length.

Variable-capacity best-fit over the histogram of the sizes. Sizes are whole numbers up to the capacity, so the whole
packing problem, of any number of items, is a table of at most `capacity` counts; it is planned once, in bulk: going
down the sizes, all items of a size go into the open containers with the least sufficient room; where none has room,
containers of the least-cost length are opened, that is the length whose cost, over the tokens that the remaining
sizes would fill it with, is least. At the end each container shrinks to the shortest permitted length that holds its
contents.

A container of length L costs CONTAINER_COST + L + L^2 / ATTENTION: a fixed part, a part for each token and one that
grows with the square, as attention does, so that shorter containers pay unless they are many or badly filled. The
lengths are optimised jointly: the histogram is packed with every set of permitted lengths that can hold all items,
and the plan of least total cost, after shrinking, is taken. `costs` compares it with the longest length alone.

The plan says which containers the items of each size take, by their rank within the size. Ranks come from counts per
size and salt and a row number within each; a size has a salt for each ROWS_PER_TASK of its items, so a size that a
third of all items share is ranked by many tasks. The driver sees counts per size and salt only, and the plan.

An item larger than the capacity is cut: full containers of its own, which need no rank, and the rest as an item.
Items of size 0 (null and empty texts) take no room and go to container 0. Repeated items are packed each. No items,
no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.tokens import counted
from gridloom.runtime import cut

#: Permitted container lengths; the longest is the capacity.
LENGTHS = (256, 512, 1024, 2048)
#: Cost of a container besides its length, in tokens, and the length at which attention costs as much as the rest.
CONTAINER_COST, ATTENTION = 16, 8192
#: Least salts of a size, and items of a size for each salt.
SALTS, ROWS_PER_TASK = 16, 1_000_000


def cost_of(length: int, cost: float = CONTAINER_COST) -> float:
    """What a container of that length costs, in tokens."""
    return cost + length + length**2 / ATTENTION


@dataclass
class Plan:
    """segments: (size, first rank, first container, containers, items of each container, offset); spans: (first
    container, containers, length)."""

    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)

    def cost(self, each: float = CONTAINER_COST) -> float:
        return sum(n * cost_of(length, each) for _, n, length in self.spans)


def _filled(length: int, size: int, sizes: list[int], left: dict[int, int]) -> int:
    """Tokens in a container of that length, filled greedily with an item of that size and the remaining ones."""
    room, i = length - size, bisect_left(sizes, size)
    first = True
    while room > 0 and i >= 0:
        if i < len(sizes) and sizes[i] <= room:
            s = sizes[i]
            room -= s * min(room // s, left[s] - (first and s == size))
        first = False if i < len(sizes) and sizes[i] < size else first
        i = min(i - 1, bisect_left(sizes, room + 1) - 1)
    return length - room


def plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: float = CONTAINER_COST) -> Plan:
    """The packing of counts[size] items of each size; sizes are 1 to max(lengths). Of all sets of lengths the one
    that gives the least cost."""
    return min((p for _, p in plans(counts, lengths, cost)), key=lambda p: p.cost(cost))


def plans(counts: dict[int, int], lengths: tuple[int, ...], cost: float) -> Iterator[tuple[tuple[int, ...], Plan]]:
    """The packing with each set of lengths, the largest of which holds the largest item."""
    lengths, most = tuple(sorted(lengths)), max((s for s, c in counts.items() if c), default=0)
    for n in range(1, len(lengths) + 1):
        for opened in combinations(lengths, n):
            if opened[-1] >= most:
                yield opened, _plan(counts, lengths, opened, cost)


def _plan(counts: dict[int, int], lengths: tuple[int, ...], opened: tuple[int, ...], cost: float) -> Plan:
    out, sizes = Plan(), sorted(s for s, c in counts.items() if c)
    left = {s: counts[s] for s in sizes}
    rooms: list[int] = []  # the rooms that open containers have, ascending
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first container, containers, length)
    containers = 0

    def put(room: int, first: int, n: int, length: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n, length))

    for size in reversed(list(sizes)):
        rank = 0
        while left[size]:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                length = min((x for x in opened if x >= size), key=lambda x: (cost_of(x, cost) / _filled(x, size, sizes, left), -x))
                n = -(-left[size] // (length // size))
                put(length, containers, n, length)
                containers += n
                continue
            room = rooms[at]
            first, n, length = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // size
            full = min(n, left[size] // each)
            for start, bins, items in ((first, full, each), (first + full, int(full < n and left[size] > full * each), left[size] - full * each)):
                if bins:
                    out.segments.append((size, rank, start, bins, items, length - room))
                    put(room - items * size, start, bins, length)
                    rank += bins * items
                    left[size] -= bins * items
                    first, n = start + bins, n - bins
            put(room, first, n, length)
        sizes.pop()
    for room, groups in open_.items():
        out.spans += [(first, n, min(x for x in lengths if x >= length - room)) for first, n, length in groups]
    out.spans.sort()
    return out


def _pieces(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece_no, first, size): each item, those over the capacity in pieces of it."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int") - 1)
    return items.select(F.col(item), n.alias("__n"), F.explode(cuts).alias("piece_no")).select(
        item, "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first"), F.least(F.col("__n") - F.col("piece_no").cast("long") * capacity, F.lit(capacity)).cast("int").alias("size")
    )


def _counted(pieces: DataFrame, capacity: int, salts: int) -> tuple[np.ndarray, DataFrame, np.ndarray, np.ndarray]:
    """(items of each size, pieces with salt, where the salts of each size begin, items of each size before each
    salt). Full pieces aren't counted."""
    open_ = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    rows = open_.groupBy("size").count().toPandas()  # less than capacity rows
    total = np.zeros(capacity + 1, np.int64)
    total[rows["size"]] = rows["count"]
    each = np.maximum(salts, -(-total // ROWS_PER_TASK))
    start = np.concatenate([[0], np.cumsum(each)])
    many = pieces.sparkSession.createDataFrame([(int(s), int(n)) for s, n in enumerate(each) if n > salts], "size int, __salts int")
    salted = pieces.join(F.broadcast(many), "size", "left") if many.count() else pieces.withColumn("__salts", F.lit(None).cast("int"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(F.concat_ws(":", "item", "piece_no")), F.coalesce("__salts", F.lit(salts))).cast("int")).drop("__salts")
    held = np.zeros(start[-1], np.int64)
    for r in salted.where((F.col("size") > 0) & (F.col("size") < capacity)).groupBy("size", "salt").count().toLocalIterator():
        held[start[r["size"]] + r["salt"]] = r["count"]
    upto = np.cumsum(held)
    return total, salted, start, upto - held - np.repeat((upto - held)[start[:-1]], each)


def pack(items: DataFrame, item: str, size: str, lengths: tuple[int, ...] = LENGTHS, cost: float = CONTAINER_COST, salts: int = SALTS) -> DataFrame:
    """(item, piece_no, first, size, container_id, container_offset, container_length): where each item goes. An item
    up to the capacity is one piece; `first` is the piece's first token within its item."""
    capacity = max(lengths)
    kind = dict(items.dtypes)[item]
    pieces = cut(_pieces(items.select(F.col(item).alias("item"), F.col(size).alias("size")), "item", "size", capacity).withColumn("__at", F.monotonically_increasing_id()))
    total, salted, starts, before = _counted(pieces, capacity, salts)
    planned = plan({int(s): int(n) for s, n in enumerate(total) if n}, lengths, cost)
    segments = np.array(sorted(planned.segments), np.int64).reshape(-1, 6)
    spans = np.array(planned.spans or [(0, 1, min(lengths))], np.int64)
    reach = int(total.sum()) + 1  # more than any rank
    keys = segments[:, 0] * reach + segments[:, 1]
    columns = f"item {kind}, piece_no int, first long, size int, container_id long, container_offset long, container_length long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = pdf["size"].to_numpy(np.int64)
            rank = before[starts[s] + pdf["salt"]] + pdf.pop("row_no").to_numpy(np.int64) - 1
            if len(segments):
                _, start, first, _, each, offset = segments[np.maximum(np.searchsorted(keys, s * reach + rank, side="right") - 1, 0)].T
                container = np.where(s > 0, first + (rank - start) // each, 0)
                offset = np.where(s > 0, offset + (rank - start) % each * s, 0)
            else:
                container = offset = np.zeros(len(pdf), np.int64)
            span = spans[np.searchsorted(spans[:, 0], container, side="right") - 1]
            yield pdf.drop(columns="salt").assign(container_id=container, container_offset=offset, container_length=span[:, 2])

    numbered = salted.where((F.col("size") > 0) & (F.col("size") < capacity)).withColumn("row_no", F.row_number().over(W.partitionBy("size", "salt").orderBy("item", "piece_no")))
    empty = salted.where("size = 0").withColumn("row_no", F.lit(1))
    placed = numbered.unionByName(empty).drop("__at").select("item", "piece_no", "first", "size", "salt", "row_no").mapInPandas(place, columns)
    own = F.col("__at") + int(max(first + n for first, n, _ in spans.tolist()))  # behind all planned containers
    full = pieces.where(F.col("size") == capacity).select("item", "piece_no", "first", "size", own.alias("container_id"), F.lit(0).cast("long").alias("container_offset"), F.lit(capacity).cast("long").alias("container_length"))
    return placed.unionByName(full).withColumnRenamed("item", item)


def costs(items: DataFrame, size: str, lengths: tuple[int, ...] = LENGTHS, cost: float = CONTAINER_COST) -> DataFrame:
    """(lengths, containers, tokens, room, cost, chosen): what every set of lengths would come to, full pieces of
    items over the capacity included."""
    capacity = max(lengths)
    counts = {r["size"]: r["count"] for r in _pieces(items.select(F.lit(0).alias("item"), F.col(size).alias("size")), "item", "size", capacity).groupBy("size").count().collect() if r["size"]}
    full = counts.pop(capacity, 0)
    tokens = sum(s * n for s, n in counts.items()) + capacity * full
    rows = []
    for opened, p in plans(counts, lengths, cost):
        room = sum(n * length for _, n, length in p.spans) + capacity * full
        rows.append((list(opened), sum(n for _, n, _ in p.spans) + full, tokens, room, p.cost(cost) + full * cost_of(capacity, cost)))
    least = min((r[-1] for r in rows), default=0)
    first = next((i for i, r in enumerate(rows) if r[-1] == least), None)
    return items.sparkSession.createDataFrame([(*r, i == first) for i, r in enumerate(rows)], "lengths array<int>, containers long, tokens long, room long, cost double, chosen boolean")


def packed_documents(documents: DataFrame, **how: int) -> DataFrame:
    """The packing of documents sized in tokens of the default vocabulary."""
    return pack(counted(documents), "doc_id", "n_tokens", **how)


def summary(packed: DataFrame) -> DataFrame:
    """(container_length, containers, pieces, tokens, fill, cost): how well the containers of each length are filled."""
    each = packed.groupBy("container_length", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    return each.groupBy("container_length").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.col("container_length"))).alias("fill"),
        (F.count("*") * (CONTAINER_COST + F.col("container_length") + F.col("container_length") ** 2 / ATTENTION)).alias("cost"),
    )
