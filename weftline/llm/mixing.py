"""Problem 7: sources mixed to target shares of the total size.

Every text of a source is used equally often in expectation: the largest total
is taken at which no source needs more than its ``max_repeats``.  The whole part
of that number is certain; the fraction is drawn by the cube method: the vector
of inclusion probabilities moves in the null space of the balancing
constraints (tokens and number of texts) to a face of the unit cube, step by
step, until at most two probabilities of a source are left; these and the
``LANDING`` texts of all sizes, which are left out of the flight, are rounded
together so that its tokens come closest to its target (landing).

Plan: one pass for the sizes, one aggregation to a row a source.  The flight
runs in blocks of about ``BLOCK`` texts of one source, dealt by hash, so a large
source is spread over many tasks; a block leaves at most two undecided texts,
the first one also ``LANDING`` texts of all sizes, and these are gathered and flown
again, block by block, until one block of the source is left, which lands.  Each
source goes by its own size.  The result is the same on every run.

The landing chooses the rounding that comes closest to the target: inclusion
probabilities hold exactly for the texts of the flight, not for the ``LANDING``
texts of a source.

Defined results: texts of null or unknown source, and without tokens, take no
part; a target without texts, with null or non-positive weight, or with
``max_repeats`` below 1 gets nothing, and its weight is spread over the others in
proportion (the report shows target and actual share); doubled targets count
once; repeated rows of a text are texts of their own; no usable target gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import token_sizes
from weftline.session import materialize, ship

BLOCK = 50_000
LANDING = 12
MAX_SOURCES = 100_000
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities of equal start to 0 or 1, keeping sum(p) and sum(p * size); at most two stay between."""
    p = p.copy()
    live: list[int] = []
    coin = rng.random(2 * len(p) + 8)
    c = 0
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
        while len(live) == 3:
            a, b, d = live
            u = (size[b] - size[d], size[d] - size[a], size[a] - size[b])  # null space of (1, 1, 1) and the sizes
            if u[0] == u[1] == u[2] == 0:
                u = (1.0, -1.0, 0.0)
            up, down = math.inf, math.inf
            for j, x in zip(live, u):
                if x > 0:
                    up, down = min(up, (1 - p[j]) / x), min(down, p[j] / x)
                elif x < 0:
                    up, down = min(up, -p[j] / x), min(down, -(1 - p[j]) / x)
            step = up if coin[c % len(coin)] * (up + down) < down else -down
            c += 1
            for j, x in zip(live, u):
                p[j] = min(1.0, max(0.0, p[j] + step * x))
            live = [j for j in live if EPS < p[j] < 1 - EPS]
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few probabilities between 0 and 1 so that tokens, and then the number of texts, stay closest; the first of equals."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    gap = np.abs(bits @ size[open_] - (p[open_] * size[open_]).sum())
    number = np.abs(bits.sum(axis=1) - p[open_].sum())
    out = p.copy()
    out[open_] = bits[np.lexsort((number, np.round(gap + 0.5 * size.mean() * np.maximum(number - 1, 0), 6)))[0]] if len(open_) else 0
    return out


def plan(targets: list[tuple[str, float, int]], totals: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Uses of each text by source, from (source, weight, max_repeats) and {source: (texts, tokens)}."""
    usable = {s: (w, r) for s, w, r in targets if s in totals and totals[s][1] > 0 and w and w > 0 and r and r >= 1}
    if not usable:
        return {}
    weight = sum(w for w, _ in usable.values())
    total = min(r * totals[s][1] / (w / weight) for s, (w, r) in usable.items())
    return {s: min(float(r), w / weight * total / totals[s][1]) for s, (w, r) in usable.items()}


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(doc_id, source_id, tokens, repeats): the chosen texts, each with the number of its uses."""
    spark = ship(documents.sparkSession)
    rows = targets.select("source_id", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source_id IS NOT NULL").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets: not a reference table")
    goal = {r["source_id"]: (r["source_id"], r["weight"], r["max_repeats"]) for r in sorted(rows, key=str)}
    schema = "doc_id long, source_id string, tokens long, repeats long"
    if not goal:
        return spark.createDataFrame([], schema)
    asked = spark.createDataFrame([(s,) for s in goal], "source_id string")
    sizes = token_sizes(documents.select("doc_id", "source_id", "text").where("source_id IS NOT NULL"), "source_id", path=path)
    sizes = materialize(sizes.where("tokens > 0").join(asked, "source_id", "left_semi"), "sizes")
    # one row a target at most
    totals = {r["source_id"]: (r["n"], r["t"]) for r in sizes.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    uses = plan(list(goal.values()), totals)
    if not uses:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([(s, math.floor(u + EPS), max(0.0, u - math.floor(u + EPS)), max(1, -(-totals[s][0] // block))) for s, u in uses.items()], "source_id string, whole long, p double, blocks long")
    items = sizes.join(F.broadcast(known), "source_id")
    fixed = items.where(F.col("p") <= EPS).select("doc_id", "source_id", "tokens", F.col("whole").alias("repeats"))
    blocks = max((-(-totals[s][0] // block) for s, u in uses.items() if u - math.floor(u + EPS) > EPS), default=0)
    if not blocks:
        return fixed.where("repeats > 0")
    flying = items.where(F.col("p") > EPS).withColumn("h", F.xxhash64("doc_id", "tokens", F.lit(seed)))
    flying = flying.select("doc_id", "source_id", "tokens", "whole", "p", "h", "blocks", F.pmod("h", "blocks").alias("part"))
    done = None
    while True:
        flown = materialize(flying.groupBy("source_id", "part", "blocks").applyInArrow(_flown(seed), flying.schema), "flight")
        sure = flown.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)).select("doc_id", "source_id", "tokens", (F.col("whole") + F.round("p").cast("long")).alias("repeats"))
        done = sure if done is None else done.unionByName(sure)
        if blocks == 1:
            return fixed.unionByName(done).where("repeats > 0")
        blocks = _next(blocks, block)  # of the largest source
        left = flown.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).withColumn("blocks", F.greatest(F.lit(1), F.least(F.col("blocks") - 1, F.ceil((2 * F.col("blocks") + LANDING) / block))).cast("long"))
        flying = left.withColumn("part", F.pmod("h", "blocks"))


def _next(blocks: int, block: int) -> int:
    """Blocks that hold what ``blocks`` of them leave."""
    return max(1, min(blocks - 1, -(-(2 * blocks + LANDING) // block)))


def _flown(seed: int):
    """The flight of one block, and its landing if it is the last of its source."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("h", "ascending"), ("doc_id", "ascending")])  # small texts last: little is left to round
        size = t["tokens"].to_numpy().astype(float)
        part, last = key[1].as_py(), key[2].as_py() == 1
        rng = np.random.default_rng(hash_key(key[0].as_py(), part, seed))
        p = t["p"].to_numpy()
        wait = np.unique(np.linspace(0, len(p) - 1, LANDING).astype(int)) if last or part == 0 else np.zeros(0, dtype=int)
        fly = np.setdiff1d(np.arange(len(p)), wait)
        q = p.copy()
        q[fly] = flight(p[fly], size[fly], rng)
        if last:
            q = land(q, size)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(q))

    return run


def hash_key(source: str, part: int, seed: int) -> int:
    """The same number for a block on every run and machine."""
    h = seed + 1
    for b in f"{source}\x00{part}".encode():
        h = (h * 1000003 ^ b) & 0x7FFFFFFFFFFFFFFF
    return h


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: texts, tokens with repeats, most repeats, target share and actual share."""
    by = chosen.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    total = by.agg(F.sum("n_tokens").alias("all_tokens"))
    goal = targets.select("source_id", F.col("weight").alias("target_share"), "max_repeats").distinct()
    return (
        goal.join(by, "source_id", "left")
        .crossJoin(total)  # a single row
        .select(
            "source_id",
            "target_share",
            "max_repeats",
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
