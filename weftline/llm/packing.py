"""Problem 6: texts put whole into containers of fixed capacity.

Method: bounded-space online best fit.  At most ``OPEN`` containers are open;
a bitset has a bit for each amount of free space that an open container has,
so the tightest container that takes an item is the lowest bit from the item's
size on.  Where none takes it and all are open, the fullest is closed.

An item above the capacity is divided: whole pieces fill containers of their
own, and the rest is packed like any other item.

Plan: sizes are counted in one pass.  Items are dealt by the hash of their id
to groups of about ``GROUP_TOKENS`` tokens, and each group is packed in one
task, for every capacity in turn; the number of groups grows with the data, so a
group never does, and an item is moved once, whatever the number of capacities.  A
group leaves at most ``OPEN`` containers partly filled: with groups of this
size well under two per cent of the space.

Defined results: texts of no token take no space and are left out; repeated
rows are items of their own; null ids are items with a null id; capacities that
are null or not positive are left out, and doubled specs count once.  Pieces
are given by token offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import token_sizes
from weftline.session import materialize, ship

OPEN = 128
GROUP_TOKENS = 40_000_000
MAX_SPECS = 1000


class BestFit:
    """Open containers of one capacity, by free space."""

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.bits = 0  #: bit f is set if an open container has f tokens free
        self.by_free: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def _put(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.count += 1

    def add(self, size: int, item: object) -> list | None:
        """Place an item; the container that this closes, if any, as (free, items)."""
        fits = self.bits >> size
        closed = None
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.count >= self.limit:
                low = (self.bits & -self.bits).bit_length() - 1
                closed = (low, self._take(low))
            free, items = self.capacity, []
        items.append(item)
        if free == size:
            if closed is None:
                return (0, items)
            # both at once: the closed one is handed out first, the full one stays as a container without room
            self.by_free.setdefault(0, []).append(items)
            self.bits |= 1
            self.count += 1
        else:
            self._put(free - size, items)
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        for free in sorted(self.by_free):
            for items in self.by_free[free]:
                yield free, items
        self.by_free, self.bits, self.count = {}, 0, 0


def pack(sizes: Iterator[tuple[int, int]], capacity: int, limit: int = OPEN) -> Iterator[tuple[int, list[tuple]]]:
    """Containers (tokens used, items) of a stream of (id, size); an item is (id, piece, start, tokens)."""
    fit = BestFit(capacity, limit)
    for key, size in sizes:
        piece, start = 0, 0
        while size - start > capacity:
            yield capacity, [(key, piece, start, capacity)]
            piece, start = piece + 1, start + capacity
        closed = fit.add(size - start, (key, piece, start, size - start))
        if closed is not None:
            yield capacity - closed[0], closed[1]
    for free, items in fit.rest():
        yield capacity - free, items


CONTAINERS = "spec_id int, capacity_tokens int, container_id string, used_tokens long, fill double, items array<struct<doc_id:long,piece:int,start_token:long,tokens:long>>"


def containers(documents: DataFrame, specs: DataFrame, path: str | None = None, group_tokens: int = GROUP_TOKENS, limit: int = OPEN) -> DataFrame:
    """One row a container of each spec, with its items and its fill."""
    ship(documents.sparkSession)
    sizes = materialize(token_sizes(documents, path=path).where("tokens > 0"), "sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    wanted = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()
    known = sorted(((r[0], r[1]) for r in wanted.limit(MAX_SPECS + 1).collect()), key=str)
    if len(known) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities: not a reference table")
    if not known:
        return documents.sparkSession.createDataFrame([], CONTAINERS)
    dealt = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        ids, tokens = table["doc_id"].to_pylist(), table["tokens"].to_pylist()
        return pa.concat_tables([packed(key[0].as_py(), spec, capacity, ids, tokens) for spec, capacity in known])

    def packed(part: int, spec: int | None, capacity: int, ids: list, tokens: list) -> pa.Table:
        rows = list(pack(zip(ids, tokens), capacity, limit))
        flat = [x for _, items in rows for x in items]
        ends = [0]
        for _, items in rows:
            ends.append(ends[-1] + len(items))
        cols = list(zip(*flat)) if flat else [[]] * 4
        item = pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "piece", "start_token", "tokens"])
        n = len(rows)
        return pa.table(
            {
                "spec_id": pa.array([spec] * n, pa.int32()),
                "capacity_tokens": pa.array([capacity] * n, pa.int32()),
                "container_id": pa.array([f"{spec}-{part}-{i}" for i in range(n)], pa.string()),
                "used_tokens": pa.array([u for u, _ in rows], pa.int64()),
                "fill": pa.array([u / capacity for u, _ in rows], pa.float64()),
                "items": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item),
            }
        )

    return dealt.groupBy("part").applyInArrow(run, CONTAINERS)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each spec: containers, items, the least number of containers that could do, and the mean fill."""
    return packed.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum(F.size("items")).alias("n_items"),
        F.ceil(F.sum("used_tokens") / F.first("capacity_tokens")).alias("least_containers"),
        (F.sum("used_tokens") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("mean_fill"),
    )
