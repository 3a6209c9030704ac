"""Mixing sources to target weights by Pfair scheduling (problem 9).

Each source with documents is a task; its stream is cut into units of half a block, and
unit k of a source with n of N units may start at slot floor(k N / n) and must end by slot
ceil((k + 1) N / n). Taking the released unit with the earliest deadline in every slot
keeps each source within one unit of its share at any point.

The slots are cut into frames of `FRAME`, scheduled independently and in parallel: how
many units of a source lie before a frame follows by arithmetic from the sources' shares
and is itself less than one unit off, and inside a frame the earliest deadline goes first
over the frame's own counts. Together a source is always less than two units, one block,
from its share, however long the mixture is; the block does not grow with the data.
(Sources with fewer than one unit in 2^20 slots are rounded down inside the mixture.)

Total: `total_tokens` is a number, or `ALL` for the tokens of all documents given, those
of unlisted sources included; a source that cannot fill its share is used up to its cap
and its shortfall reported. Without it the total is the largest at which no source with
documents falls short with its documents repeated at most max_repeats times.

Documents inside a source are ordered by a hash of their id. Their token positions come
from a two-level prefix sum over hash buckets whose number follows the documents, so a
source that holds a third of all rows is spread over many windows.

Defined results: targets without documents are reported with their whole share as
shortfall; documents of other or null sources are left out; null and empty texts have
no tokens and are not scheduled; repeated target rows of one source count once (the
largest share and cap).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.tokens import VOCABULARY, token_counts
from auditlake.session import ensure_checkpoint_dir, ship_package

ALL = "all"
FRAME, LONGEST = 1 << 16, 1 << 20
PER_BUCKET, BUCKETS = 20_000, (16, 4096)
BROADCAST_SLOTS = 100_000


def edf(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(source, unit) of every slot: earliest deadline first over released units, all in whole numbers."""
    slots = sum(counts)
    source, unit = np.empty(slots, np.int64), np.empty(slots, np.int64)
    waiting = [(0, -(-slots // n), s, 0) for s, n in enumerate(counts) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        _, s, k = heapq.heappop(ready)
        source[slot], unit[slot] = s, k
        if k + 1 < (n := counts[s]):
            heapq.heappush(waiting, ((k + 1) * slots // n, -(-(k + 2) * slots // n), s, k + 1))
    return source, unit


def before(slot: int, counts: list[int]) -> list[int]:
    """Units of every source in the slots before `slot`: whole, adding up to `slot`, each less than one off its share."""
    slots = sum(counts)
    small = [n * LONGEST < slots for n in counts]
    out = [n * slot // slots if s else 0 for n, s in zip(counts, small)]
    rest, of = slot - sum(out), sum(n for n, s in zip(counts, small) if not s)
    reach = 0
    for i, (n, s) in enumerate(zip(counts, small)):
        if not s:
            out[i] = (reach + n) * rest // of - reach * rest // of
            reach += n
    return out


def frame_length(counts: list[int]) -> int:
    """Slots of a frame: long enough that every source has a unit in it, at most `LONGEST`."""
    used = [n for n in counts if n]
    return min(LONGEST, max(FRAME, -(-sum(used) // min(used)))) if used else FRAME


def _framed(names: list[str], counts: list[int], length: int):
    slots = sum(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b["id"]:
                a, z = int(j) * length, min((int(j) + 1) * length, slots)
                start, end = before(a, counts), before(z, counts)
                s, k = edf([y - x for x, y in zip(start, end)])
                yield pd.DataFrame({"source": np.array(names, object)[s], "block_no": k + np.array(start)[s], "slot": np.arange(a, z)})

    return run


def schedule(spark: SparkSession, quota: dict[str, int], unit: int, length: int | None = None) -> tuple[DataFrame, int]:
    """(source, block_no, slot) of every unit, and how many there are; frames are scheduled on the executors."""
    ship_package(spark)
    counts = {s: -(-q // unit) for s, q in sorted(quota.items()) if q > 0}
    slots = sum(counts.values())
    length = length or frame_length(list(counts.values()))
    frames = -(-slots // length)
    out = spark.range(0, frames, 1, max(1, min(frames, 1000))).mapInPandas(_framed(list(counts), list(counts.values()), length), "source string, block_no bigint, slot bigint")
    return out, slots


class Mixture:
    """A mixture plan over documents: sizes, quotas, schedule, and the frames made from them."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, block: int = 4096, vocabulary: str = VOCABULARY) -> None:
        spark = docs.sparkSession
        ensure_checkpoint_dir(spark)
        t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("cap"))
        self.targets = {r.source: (float(r.share), int(r.cap)) for r in t.collect()}  # the target list is a small fixed table
        listed = F.col("source").isin(list(self.targets))
        sized = token_counts(docs if total_tokens == ALL else docs.where(listed), vocabulary).where("n_tokens > 0")
        counted = sized.select("doc_id", "source", "n_tokens", F.xxhash64(F.col("doc_id"), F.lit("order")).alias("o")).checkpoint()
        buckets = min(BUCKETS[1], max(BUCKETS[0], counted.count() // PER_BUCKET))
        self.sized = counted.where(listed).withColumn("bucket", F.pmod(F.shiftright("o", 40), F.lit(buckets)).cast("int"))
        per_bucket = self.sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
        self.sizes: dict[str, int] = {s: 0 for s in self.targets}
        offsets = []
        for r in per_bucket.orderBy("source", "bucket").collect():  # at most targets x buckets rows
            offsets.append((r.source, r.bucket, self.sizes[r.source]))
            self.sizes[r.source] += int(r.n)
        self.offsets = spark.createDataFrame(offsets, "source string, bucket int, before bigint")
        room = {s: self.sizes[s] * cap for s, (_, cap) in self.targets.items()}
        if total_tokens == ALL:
            total_tokens = int(counted.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0)
        elif total_tokens is None:
            total_tokens = min((int(room[s] / share) for s, (share, _) in self.targets.items() if room[s]), default=0)
        self.total = total_tokens
        self.quota = {s: min(room[s], int(share * total_tokens)) for s, (share, _) in self.targets.items()}
        self.unit = max(1, block // 2)
        self.spark = spark

    def rows(self) -> DataFrame:
        """(doc_id, source, repeat_no, slot, slot_offset, n_tokens) of the mixture in schedule order of (slot, slot_offset)."""
        plan = self.spark.createDataFrame([(s, q, self.sizes[s]) for s, q in self.quota.items() if q > 0], "source string, quota bigint, size bigint")
        slots, n = schedule(self.spark, self.quota, self.unit)
        w = Window.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        at = self.sized.join(F.broadcast(self.offsets), ["source", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        passes = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / F.col("size")))
        used = at.join(F.broadcast(plan), "source").withColumn("repeat", F.explode(passes)).withColumn("start", F.col("start") + F.col("repeat") * F.col("size")).where("start < quota")
        used = used.withColumn("block_no", F.floor(F.col("start") / self.unit))
        return used.join(F.broadcast(slots) if n <= BROADCAST_SLOTS else slots, ["source", "block_no"]).select(
            "doc_id", "source", (F.col("repeat") + 1).cast("int").alias("repeat_no"), "slot", (F.col("start") - F.col("block_no") * self.unit).alias("slot_offset"), "n_tokens"
        )

    def shares(self) -> DataFrame:
        """Per source: target and actual share, tokens, documents, passes and shortfall."""
        used = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeat_no").alias("repeats"))
        plan = self.spark.createDataFrame([(s, share, cap, int(share * self.total), self.sizes[s]) for s, (share, cap) in self.targets.items()], "source string, target_share double, max_repeats int, target_tokens bigint, source_tokens bigint")
        j = plan.join(F.broadcast(used), "source", "left").na.fill(0, ["tokens", "documents", "repeats"])
        total = j.agg(F.sum("tokens").alias("all_tokens")).first()["all_tokens"] or 0
        return j.select(
            "source", "target_share", (F.col("tokens") / F.lit(float(max(1, total)))).alias("actual_share"), "target_tokens", F.col("tokens").alias("actual_tokens"),
            F.greatest(F.col("target_tokens") - F.col("tokens"), F.lit(0)).alias("shortfall_tokens"), "source_tokens", "documents", "repeats", "max_repeats",
        )
