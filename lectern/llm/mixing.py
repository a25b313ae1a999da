"""Problem 7: mixing sources to target weights.

The size of the mix is the largest at which every source with documents can give its share within its
cap of repeats, unless a size is asked for. Each source's documents stand in a hashed order, repeated
pass after pass; a running sum of tokens (in buckets, see ``running_sum``) gives each its place, and
those within the source's quota are taken. The order of the whole mix follows Pfair scheduling: a
source's k-th block of tokens is released at floor(k / rate) and due at ceil((k + 1) / rate), and the
earliest deadline among the released blocks goes next, so that at every block boundary each source is
less than one block from its target. Blocks have a fixed size and a mix of any size has one schedule of
all its blocks: one task writes it slot by slot, holding one block of each source, and it's joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.running import running_sum

#: Slots of the schedule that are held at a time while it's written; the result doesn't depend on it.
SLOTS = 20_000
#: Tokens of a block; a block ought to hold a document.
BLOCK_TOKENS = 2048
#: Slots whose documents one task sorts.
_SORTED = 4096


def pfair_slots(blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, k) slot by slot, for so many blocks of each source.

    With rate n / total, block k of a source lives in [floor(k / rate), ceil((k + 1) / rate)); ties of
    deadlines go to the source with more blocks, then to the smaller name. The rates add up to 1, for
    which earliest deadline first keeps every source within one block of its ideal share.
    """
    total = sum(blocks.values())
    due = lambda s, k: -(-(k + 1) * total // blocks[s])
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), -blocks[s], s, k))
        if not ready:  # never with rates that add up to 1; kept so that no block can be lost
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), -blocks[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))


def pfair_order(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """All of ``pfair_slots``."""
    return list(pfair_slots(blocks))


def period(blocks: dict[str, int], slots: int) -> dict[str, int]:
    """Slots of each source among ``slots``: all its blocks where they fit, else its share of them by largest
    remainders, one at least. An outline of a mix for readers: ``mix`` doesn't use it, as a repeated period drifts
    from the targets by what was rounded, further with each round."""
    total = sum(blocks.values())
    if total <= slots:
        return dict(blocks)
    exact = {s: Fraction(n * slots, total) for s, n in blocks.items()}
    out = {s: max(1, x.__floor__()) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    return out


def quotas(supply: list[dict], total: int | None = None) -> tuple[int, dict[str, int]]:
    """(size of the mix, tokens asked of each source) for rows with source, target_weight, max_repeats, tokens.

    Without ``total`` no cap binds. With one, a source that can't give its share gives all it has, and
    the others share what is missing in proportion to their weights, until their own caps bind.
    """
    able = {r["source"]: (float(r["target_weight"]), int(r["tokens"]) * int(r["max_repeats"])) for r in supply if r["target_weight"] and r["target_weight"] > 0 and r["tokens"] and r["max_repeats"] and r["max_repeats"] > 0}
    if not able:
        return 0, {}
    if total is None:
        weights = sum(w for w, _ in able.values())
        size = min(most * weights / w for w, most in able.values())
        return int(size), {s: int(size * w / weights) for s, (w, _) in able.items()}
    out, left, rest = {}, float(total), dict(able)
    while rest:
        weights = sum(w for w, _ in rest.values())
        full = [s for s, (w, most) in rest.items() if most <= left * w / weights]
        if not full:
            out |= {s: int(left * w / weights) for s, (w, _) in rest.items()}
            break
        for s in full:
            out[s] = rest.pop(s)[1]
        left -= sum(out[s] for s in full)
    return sum(out.values()), out


def _supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source with the tokens of its documents; a source listed twice counts its weights together."""
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    return listed.join(held, "source", "left")


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, slots: int = SLOTS, block: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The mix: (position, source, doc_id, repeat, tokens), one row for each use of a document.

    ``sized`` has (doc_id, source, tokens). Documents without tokens, of null or unlisted sources, or of
    sources of weight 0 (or null), aren't used; max_repeats of null or below 1 allows no use.
    ``position`` counts from 0 without gaps. A source overshoots its quota by less than half a document.
    ``slots`` bounds the rows of the schedule in a batch, not the mix.
    ``targets`` is a list of sources made by hand; one row of it and of the totals goes to the driver.
    """
    spark = sized.sparkSession
    supply = [r.asDict() for r in _supply(sized, targets).collect()]
    size, asked = quotas(supply, total)
    asked = {s: q for s, q in asked.items() if q > 0}
    schema = "source string, quota long, held long, passes int"
    held = {r["source"]: int(r["tokens"]) for r in supply if r["tokens"]}
    cap = {r["source"]: int(r["max_repeats"] or 0) for r in supply}
    rows = [(s, q, held[s], min(cap[s], -(-q // held[s]))) for s, q in sorted(asked.items())]
    plan = F.broadcast(spark.createDataFrame(rows, schema))

    order = _schedule(spark, {s: -(-q // block) for s, q in asked.items()}, slots)

    used = sized.where(F.col("source").isNotNull() & (F.col("tokens") > 0)).select("doc_id", "source", "tokens")
    used = used.withColumn("hashed", F.xxhash64(F.lit(seed), "source", "doc_id"))
    # 4096 buckets of the hash in each source: a source of a billion documents sorts a quarter million at a time
    placed = running_sum(used.join(plan, "source"), ["source"], F.shiftright("hashed", 52), ["hashed", "doc_id"], F.col("tokens"), "before")
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat")).withColumn("start", F.col("before") + F.col("repeat") * F.col("held"))
    taken = each.where(F.col("start") + F.col("tokens") / 2 < F.col("quota"))
    blocks = taken.withColumn("block", F.least(F.floor(F.col("start") / block), F.floor((F.col("quota") - 1) / block)).cast("long"))
    slotted = blocks.join(order.hint("merge"), ["source", "block"])  # Spark takes the schedule for a table of one row
    ranked = running_sum(slotted, [], F.floor(F.col("slot") / _SORTED), ["slot", "start", "doc_id", "repeat"], F.lit(1), "position")
    return ranked.select("position", "source", "doc_id", "repeat", "tokens")


def _schedule(spark: SparkSession, blocks: dict[str, int], slots: int) -> DataFrame:
    """(source, block, slot): where the k-th block of a source stands. Made by one task, as each slot depends on those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            first, order = 0, pfair_slots(blocks)
            while part := list(islice(order, slots)):
                sources, numbers = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(numbers, pa.int64()), pa.array(range(first, first + len(part)), pa.int64())], names=["source", "block", "slot"])
                first += len(part)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "source string, block long, slot long")


def shares(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per listed source: target_share (of the sum of all weights), reachable_share (of the
    weights of the sources that have usable documents), actual_share of all tokens, tokens, documents
    and uses, the most repeats of one document, and a note on sources that give nothing.
    """
    supply = _supply(sized, targets)
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("used_documents"), (F.max("repeat") + 1).alias("most_repeats"))
    rows = supply.join(got, "source", "left")
    usable = (F.col("target_weight") > 0) & (F.coalesce("tokens", F.lit(0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0)
    total = rows.agg(
        F.sum("target_weight").alias("all_weight"),
        F.sum(F.when(usable, F.col("target_weight"))).alias("usable_weight"),
        F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("all_tokens"),
    ).first()
    weight, reach, tokens = (float(x or 0) or None for x in total)
    share = lambda c, of: F.round(c / F.lit(of), 6) if of else F.lit(None).cast("double")
    return rows.select(
        "source",
        share(F.col("target_weight"), weight).alias("target_share"),
        F.when(usable, share(F.col("target_weight"), reach)).otherwise(F.lit(0.0)).alias("reachable_share"),
        F.coalesce(share(F.col("mixed_tokens"), tokens), F.lit(0.0)).alias("actual_share"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.when(F.col("target_weight") <= 0, "weight 0").when(~usable, "no usable documents").otherwise("mixed").alias("note"),
    )
