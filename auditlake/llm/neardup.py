"""Notes that are the same but for small edits: SetSketch candidates, likelihood estimate, exact check (problem 1).

A note is the set of its distinct words. Notes with equal sets collapse to one class
before anything else (map-side combined), so copies cost one row however many there are.

Sketch. Register i of a class holds K_i = clamp(floor(1 - log_b min_w h_i(w)), 0, q + 1)
with h_i(w) exponential of rate `weight(w)`: exponentially spaced, truncated minima that
merge by taking the larger value. Band registers take 16 bits (b = 1.001). Words that
occur in more than 1/`COMMON` of all notes (and in more than `COMMON_LEAST`) weigh less
the more notes they are in, down to 1/256, so that the phrases all notes share do not
decide where a note lands; how common words are is read from a count-min sketch of all
words of all notes, of fixed size.

Bands. `BANDS` bands of `ROWS` registers; classes that agree in a whole band are
candidates (an equi-join on the band key; buckets are never collected). Bands that hold
many classes are found on a sample of the classes (which only decides how work is split,
never what is compared) and joined in salted blocks of about `HOT` classes.

Estimate. Every class has a second, unweighted sketch of `ESTIMATE_REGISTERS` registers
of one byte (b = 1.2), made once. Candidates first meet as sketches: the counts of larger,
smaller and equal registers give the joint likelihood, which is maximised for the Jaccard
similarity, and pairs clearly below the threshold are dropped (`ESTIMATE_SIGMAS`). Only the
survivors meet as word sets, where the exact check is made on the JVM.

Recall is that of the bands: at `BANDS` = 24 and `ROWS` = 3 a pair whose weighted
similarity is s is missed with probability (1 - s^3)^24, 4e-5 at 0.7 and 4 % at 0.5.
Edits that hit the rare words of a note put s far below the plain similarity, down to
almost 0 where nearly all words are common (a large family, stock phrases). Classes with
at most `MOSTLY` of their words at full weight therefore take a second, unweighted pass
of the same bands against all classes a pair with them can have (at most `PARTNER`),
where s is the plain similarity. Pairs of classes above `MOSTLY` rest on the weighted
bands alone.

Defined results: null notes and notes with fewer than `least` words belong to nothing;
notes with equal word sets are pairs and one class; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import graph
from auditlake.session import ensure_checkpoint_dir, ship_package

BANDS, ROWS = 24, 3
BASE, Q, RATE = 1.001, 2**16 - 2, 2.0**30  # 16 bits, e^65 wide, up to the smallest weights
SMALL_BASE, SMALL_Q, SMALL_RATE = 1.2, 2**8 - 2, 20.0  # 8 bits
COMMON, COMMON_LEAST = 1000, 200
LEVELS = 5  # weights 1, 1/4, 1/16, 1/64, 1/256
# Shares of full-weight words: of a class in the second pass, and of any class that has a plain similarity of 0.7 to one.
MOSTLY, PARTNER = 0.2, 0.45
COUNTERS, COUNTER_ROWS = 1 << 16, 2
ESTIMATE_REGISTERS, ESTIMATE_SIGMAS = 48, 4.75
HOT, SAMPLED = 2000, 64  # classes in one block of a band, rows of a class in one block of a pair; one class in SAMPLED shows which bands are hot


def _odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BAND_MULTIPLIERS = _odd_multipliers(BANDS * ROWS, 7)
ESTIMATE_MULTIPLIERS = _odd_multipliers(ESTIMATE_REGISTERS, 11)
KEY_MULTIPLIERS = _odd_multipliers(ROWS + 1, 13)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def largest_uniform(words: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(sets, registers): per set and register the largest 32-bit uniform over its words.

    The smallest exponential of a set belongs to its largest uniform, so the logarithm
    is taken once per register instead of once per word. Sets must not be empty.
    """
    mixed = _mix(words)
    out = np.empty((len(starts), len(multipliers)), np.uint32)
    for i, a in enumerate(multipliers):
        u = (mixed * a >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.maximum.reduceat(u, starts) if len(starts) else 0
    return out


def exponential(u: np.ndarray) -> np.ndarray:
    """-ln of a 32-bit uniform."""
    return -np.log((u.astype(np.float64) + 0.5) / 2.0**32)


def registers(smallest: np.ndarray, base: float = BASE, q: int = Q, rate: float = RATE) -> np.ndarray:
    """Register values of smallest exponentials (per unit rate)."""
    k = np.floor(1.0 - np.log(smallest / rate) / np.log(base))
    return np.clip(k, 0, q + 1).astype(np.int64)


def word_hashes(c):
    """Sorted distinct 32-bit hashes of a text's words (runs of a-z and 0-9 after lower-casing).

    Two words of one pair of notes fall together with a chance of about 1e-7 a pair; half
    the width of what a note takes in the shuffle.
    """
    w = F.transform(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.hash(x))
    return F.sort_array(F.array_distinct(w))


def notes_of(tables: dict[str, tuple[DataFrame, str]], least: int, row_id: str = "row_id") -> DataFrame:
    """(row_id, cls, tbl, ws): notes with at least `least` words; `cls` identifies table and word set, `tbl` is the table's position."""
    out = None
    for i, (df, column) in enumerate(tables.values()):
        t = df.where(F.col(column).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("row_id"), F.lit(i).cast("bigint").alias("tbl"), word_hashes(F.col(column)).alias("ws"))
        out = t if out is None else out.unionByName(t)
    return out.where(F.size("ws") >= least).select("row_id", F.xxhash64("tbl", "ws").alias("cls"), "tbl", "ws")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row starts of a list<int32> column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]].view(np.uint32).astype(np.uint64), at - at[0]


def _counter(words: np.ndarray, row: int) -> np.ndarray:
    return (words >> np.uint64(16 * row) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every note's ids (words only of the sampled classes), and at the end of a task one row with its word counters and number of notes."""
    total = np.zeros(COUNTER_ROWS * COUNTERS + 1, np.int64)
    names = ["row_id", "cls", "tbl", "ws", "counts"]
    for b in batches:
        words, at = _flat(b.column(3))
        total[-1] += len(at) - 1
        for r in range(COUNTER_ROWS):
            total[r * COUNTERS : (r + 1) * COUNTERS] += np.bincount(_counter(words, r), minlength=COUNTERS)
        picked = np.flatnonzero(b.column(1).to_numpy() % SAMPLED == 0)
        place = np.full(b.num_rows, -1)
        place[picked] = np.arange(len(picked))
        some = b.column(3).take(pa.array(picked)).take(pa.array(place, mask=place < 0)).cast(pa.list_(pa.int32())) if len(picked) else pa.nulls(b.num_rows, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), some, pa.nulls(b.num_rows, pa.list_(pa.int32()))], names)
    one = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([one, one, one, pa.nulls(1, pa.list_(pa.int32())), pa.array([total.astype(np.int32)], pa.list_(pa.int32()))], names)


def common_levels(survey: DataFrame) -> np.ndarray:
    """Level of every counter: 0 up to 1/COMMON of all notes, one more for each factor of four beyond.

    A count-min sketch of every word of every note: counters add up over tasks and never
    count a word too low. Counters above level 0 come to the driver; there are at most
    COUNTER_ROWS x COUNTERS. A word in COMMON_LEAST notes or fewer is at level 0.
    """
    counts = survey.where("counts IS NOT NULL").select(F.posexplode("counts").alias("counter", "n")).where("n > 0").groupBy("counter").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    end = COUNTER_ROWS * COUNTERS
    sets = survey.where("counts IS NOT NULL").agg(F.sum(F.element_at("counts", -1).cast("bigint")).alias("n")).first()["n"] or 0
    limit = max(int(sets) // COMMON, COMMON_LEAST)
    levels = np.zeros(end, np.int8)
    for r in counts.where((F.col("counter") < end) & (F.col("n") > limit)).collect():
        levels[r.counter] = min(LEVELS - 1, 1 + int(np.log2(r.n / limit) / 2))
    return levels


def _levels_of(words: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([levels[r * COUNTERS + _counter(words, r)] for r in range(COUNTER_ROWS)])


def band_keys(words: np.ndarray, at: np.ndarray, levels: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 48-bit band keys of word sets; `salt` keeps tables apart."""
    level = _levels_of(words, levels)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    smallest = np.full((len(at) - 1, BANDS * ROWS), np.inf)
    for one in range(LEVELS):
        part = level == one
        if part.any():
            own = owner[part]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows = own[starts]
            smallest[rows] = np.minimum(smallest[rows], exponential(largest_uniform(words[part], starts, BAND_MULTIPLIERS)) * 4.0**one)
    k = registers(smallest).astype(np.uint64).reshape(len(at) - 1, BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * KEY_MULTIPLIERS[ROWS] + salt[:, None]
    for i in range(ROWS):
        key = _mix(key + k[:, :, i] * KEY_MULTIPLIERS[i])
    return (key & np.uint64(2**48 - 1)).view(np.int64)


def _band_mapper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            words, at = _flat(b.column(2))
            keys = band_keys(words, at, levels, b.column(1).to_numpy().astype(np.uint64) * KEY_MULTIPLIERS[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["cls", "band"])

    return run


def _plain_band_mapper(shared, most: float):
    """Unweighted band keys of the classes with at most `most` of their words at full weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        plain = np.zeros_like(levels)
        for b in batches:
            if not b.num_rows:
                continue
            words, at = _flat(b.column(2))
            size = np.diff(at)
            keep = np.add.reduceat((_levels_of(words, levels) == 0).astype(np.int64), at[:-1]) <= most * size
            if not keep.any():
                continue
            keys = band_keys(words[np.repeat(keep, size)], np.r_[0, np.cumsum(size[keep])], plain, b.column(1).to_numpy()[keep].astype(np.uint64) * KEY_MULTIPLIERS[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy()[keep], BANDS)), pa.array(keys.ravel())], ["cls", "band"])

    return run


def sketches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, ESTIMATE_REGISTERS) bytes: the unweighted sketch of every set."""
    return registers(exponential(largest_uniform(words, at[:-1], ESTIMATE_MULTIPLIERS)), SMALL_BASE, SMALL_Q, SMALL_RATE).astype(np.uint8)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, tbl, n, sk): size and sketch of every class."""
    for b in batches:
        if not b.num_rows:
            continue
        words, at = _flat(b.column(2))
        raw = np.ascontiguousarray(sketches(words, at))
        offsets = np.arange(0, raw.size + 1, ESTIMATE_REGISTERS, dtype=np.int32)
        sk = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int32)), sk], ["cls", "tbl", "n", "sk"])


def estimate_jaccard(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = SMALL_BASE) -> np.ndarray:
    """Joint maximum-likelihood Jaccard of register pairs with known set sizes.

    With u, v the sizes' shares, a register is larger on one side with probability
    p(u - vJ), on the other with p(v - uJ), p(x) = -log_b(1 - x (b - 1) / b). The
    log-likelihood is concave; its maximum is found by ternary search.
    """
    plus, minus = (ka > kb).sum(1), (ka < kb).sum(1)
    equal = ka.shape[1] - plus - minus
    u = na / (na + nb)
    v = 1.0 - u
    p = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base), 1e-12, 1 - 1e-12)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return plus * np.log(a) + minus * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))

    for _ in range(20):  # to 3e-4 of the range
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = likelihood(x) < likelihood(y)
        lo, hi = np.where(better, x, lo), np.where(better, hi, y)
    return (lo + hi) / 2


def least_estimate(threshold: float) -> float:
    """Estimates below this are far from the threshold: so many standard errors of the sketch."""
    return threshold - ESTIMATE_SIGMAS * (threshold * (1 - threshold) / ESTIMATE_REGISTERS) ** 0.5


def _estimator(threshold: float):
    limit = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ka, kb = (np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] :][: len(c) * ESTIMATE_REGISTERS].reshape(len(c), ESTIMATE_REGISTERS) for c in (b.column(4), b.column(5)))
            est = estimate_jaccard(ka, kb, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
            keep = np.flatnonzero(est >= limit)
            idx = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(est[keep])], ["cls_a", "cls_b", "estimate"])

    return run


def _blocks(n):
    """Blocks that so many rows are cut into."""
    return F.ceil(n / HOT).cast("int")


class NearDuplicates:
    """Similar classes of notes and what follows from them."""

    def __init__(self, tables: dict[str, tuple[DataFrame, str]], threshold: float = 0.7, least: int = 8) -> None:
        some = next(iter(tables.values()))[0]
        self.spark, self.threshold = some.sparkSession, threshold
        ensure_checkpoint_dir(self.spark)
        ship_package(self.spark)
        self.names = list(tables)
        self.notes = notes_of(tables, least)
        self._links: DataFrame | None = None
        # One pass for ids and word counters; what is written is a few bytes per note.
        self.survey = self.notes.mapInArrow(_survey, "row_id bigint, cls bigint, tbl bigint, ws array<int>, counts array<int>").checkpoint()

    def members(self) -> DataFrame:
        """(tbl, row_id, cls) of every note."""
        return self.survey.where("counts IS NULL").select("tbl", "row_id", "cls")

    def _candidates(self, left: DataFrame, right: DataFrame, sample: DataFrame | None) -> DataFrame:
        """(cls_a, cls_b), a < b: classes of `left` and `right` (cls, band) that agree in a band.

        `sample` (band of sampled classes) tells the hot bands. Their left side is cut into
        blocks and the right side is repeated for each, so no task holds a whole band.
        """
        hot = None
        if sample is not None:
            hot = sample.groupBy("band").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") > 2 * HOT).select("band", _blocks(F.col("n")).alias("blocks")).checkpoint()
            hot = None if hot.isEmpty() else hot
        pair = lambda a, b, on: a.select(F.col("cls").alias("x"), *on).join(b.select(F.col("cls").alias("y"), *on), on).where("x <> y").select("x", "y")
        if hot is None:
            out = pair(left, right, ["band"])
        else:
            out = pair(left.join(hot, "band", "left_anti"), right.join(hot, "band", "left_anti"), ["band"])
            cut = left.join(hot, "band").withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
            many = right.join(hot, "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            out = out.unionByName(pair(cut, many, ["band", "block"]))
        return out.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"))

    def links(self) -> DataFrame:
        """(cls_a, cls_b, jaccard, estimate): every pair of similar classes once, written to the checkpoint folder."""
        if self._links is not None:
            return self._links
        shared = self.spark.sparkContext.broadcast(common_levels(self.survey))
        # One row per word set; all uses below read the same shuffle, partitioned by cls.
        classes = self.notes.groupBy("cls").agg(F.max("tbl").alias("tbl"), F.max("ws").alias("ws"))
        sampled = self.survey.where("ws IS NOT NULL").select("cls", "tbl", "ws").dropDuplicates(["cls"])
        keys = lambda df: df.mapInArrow(_band_mapper(shared), "cls bigint, band bigint")
        bands = keys(classes)
        cand = self._candidates(bands, bands, keys(sampled)).distinct()
        # Read from the notes without a shuffle, since most tables have no such class and the second pass is then empty.
        mostly = self.notes.select("cls", "tbl", "ws").mapInArrow(_plain_band_mapper(shared, MOSTLY), "cls bigint, band bigint").distinct().checkpoint()
        if not mostly.isEmpty():
            plain = lambda df: df.mapInArrow(_plain_band_mapper(shared, PARTNER), "cls bigint, band bigint")
            cand = cand.unionByName(self._candidates(mostly, plain(classes), plain(sampled))).distinct()
        sk = classes.select("cls", "tbl", "ws").mapInArrow(_sketcher, "cls bigint, tbl bigint, n int, sk binary")
        side = lambda x: sk.select(F.col("cls").alias(f"cls_{x}"), F.col("tbl").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}"))
        # Written so that the table is no join key: both sides then read one shuffle, partitioned by cls.
        one_table = F.col("ta").bitwiseXOR(F.col("tb")) == 0
        met = cand.join(side("a"), "cls_a").join(side("b"), "cls_b").where(one_table).select("cls_a", "cls_b", "na", "nb", "sa", "sb")
        near = met.mapInArrow(_estimator(self.threshold), "cls_a bigint, cls_b bigint, estimate double")
        words = lambda x: classes.select(F.col("cls").alias(f"cls_{x}"), F.col("tbl").alias(f"t{x}"), F.col("ws").alias(f"w{x}"))
        both = near.join(words("a"), "cls_a").join(words("b"), "cls_b").where(one_table).withColumn("shared", F.size(F.array_intersect("wa", "wb")))
        both = both.withColumn("every", F.size("wa") + F.size("wb") - F.col("shared")).where(F.col("shared") * 1000 >= F.col("every") * round(self.threshold * 1000))
        self._links = both.select("cls_a", "cls_b", (F.col("shared") / F.col("every")).alias("jaccard"), "estimate").checkpoint()
        return self._links

    def table_name(self):
        """Name of the table at position `tbl`."""
        return F.element_at(F.array(*map(F.lit, self.names)), (F.col("tbl") + 1).cast("int")).alias("table_name")

    def row_pairs(self) -> DataFrame:
        """(table_name, row_id_a, row_id_b): all pairs of similar rows, equal notes included.

        The rows of a class with many copies are cut into blocks of about `HOT`; the other
        side meets every block, so no task expands a whole class with itself.
        """
        members = self.members()
        size = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
        several = size.select("cls", F.col("cls").alias("other"))
        links = self.links()
        edges = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(several)
        large = size.where(F.col("n") > HOT).select(F.col("cls").alias("other"), _blocks(F.col("n")).alias("blocks")).checkpoint()
        left = edges.join(members.select("tbl", F.col("row_id").alias("x"), "cls"), "cls")
        right = members.select(F.col("row_id").alias("y"), F.col("cls").alias("other"))
        if large.isEmpty():
            both = left.join(right, "other")
        else:
            both = left.join(large, "other", "left_anti").join(right, "other")
            cut = right.join(large, "other").withColumn("block", F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int")).drop("blocks")
            both = both.unionByName(left.join(large, "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").join(cut, ["other", "block"]).select(*both.columns))
        pairs = both.where("cls <> other OR x < y")
        return pairs.select(self.table_name(), F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))

    def components(self) -> DataFrame:
        """(cls, comp): connected classes; singletons are not listed."""
        return graph.components(self.links(), "cls_a", "cls_b").select(F.col("id").alias("cls"), F.col("component").alias("comp"))

    def groups(self) -> DataFrame:
        """(table_name, row_id, group_id, links): one row per note that has a near duplicate or a copy.

        `group_id` is the smallest row_id of the group, `links` the number of other classes
        the note's class is similar to.
        """
        comp = self.components()
        members = self.members()
        g = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        heads = g.groupBy("tbl", "comp").agg(F.min("row_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
        degree = self.links_count()
        return g.join(heads, ["tbl", "comp"]).join(degree, "cls", "left").select(self.table_name(), "row_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))

    def links_count(self) -> DataFrame:
        e = self.links()
        both = e.select(F.col("cls_a").alias("cls")).unionByName(e.select(F.col("cls_b").alias("cls")))
        return both.groupBy("cls").agg(F.count("*").alias("links"))
