"""Set similarity inside groups: exact prefix-filter join, best match, repetition; MinHash signatures and their index.

Identical token sets collapse first. For a threshold t, two sets of sizes a and b can
only reach it if they share one of their size - ceil(t * size) + 1 rarest tokens and if
t * a <= b <= a / t; candidates come from an equi-join on (group, token) of those
prefixes and are verified on the whole sets.

Set ids are row ids, so they are unique over all groups. Defined results: rows without
tokens are in no set; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from auditlake.columns import all_tokens, jaccard, tokens
from auditlake.operators import graph
from auditlake.session import ensure_checkpoint_dir

PERMUTATIONS, BAND_ROWS = 256, 4
# Best matches: sets in a block, sets compared at a time, additions at a time. A token is frequent if it meets in more than
# this share of the pairs (there a column of a matrix costs less than its postings); so many at most.
BLOCK, ROWS, PIECE = 32_768, 256, 1 << 20
PACK = 64 << 20  # bytes that a task holds before it packs them
FREQUENT, COLUMNS = 0.006, 1024


def token_rows(df: DataFrame, group: list[str], row_id: str, text: str) -> DataFrame:
    """(group..., id, toks, copies, _text): one row per row with tokens; best matches are taken of these as of token sets."""
    return df.where(F.lower(text).rlike("[a-z0-9]")).select(*group, F.col(row_id).alias("id"), all_tokens(text).alias("toks"), F.lit(1).cast("bigint").alias("copies"), F.col(text).alias("_text"))


def token_sets(df: DataFrame, group: list[str], row_id: str, text: str) -> DataFrame:
    """(group..., id, toks, copies): one row per distinct token set of a group; id is its smallest row."""
    t = df.where(F.lower(text).rlike("[a-z0-9]")).select(*group, F.col(row_id).alias("id"), tokens(text).alias("toks"))
    return t.groupBy(*group, "toks").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _keyed(sets: DataFrame, group: list[str]) -> DataFrame:
    """(id, size, keys): a set's tokens as 64-bit hashes of group and token, so that one number is joined on."""
    return sets.select("id", F.size("toks").alias("size"), F.transform("toks", lambda t: F.xxhash64(*group, t)).alias("keys"))


def _prefixes(sets: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(id, size, key): the rarest tokens of every set, one of which every similar set of its group shares."""
    k = _keyed(sets, group).select("id", "size", F.explode("keys").alias("key"))
    spread = k.groupBy("key").agg(F.count("*").alias("df"))
    ranked = k.join(spread, "key").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("o"))
    return ranked.select("id", "size", F.explode(F.slice("o", 1, F.col("size") - F.ceil(F.lit(threshold) * F.col("size")).cast("int") + 1)).alias("p")).select("id", "size", F.col("p.key").alias("key"))


def _exact_pairs(sets: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(group..., a, b, similarity) unrounded; candidates are verified on the tokens themselves."""
    prefix = _prefixes(sets, group, threshold)
    a = prefix.select("key", F.col("id").alias("a"), F.col("size").alias("sa"))
    b = prefix.select("key", F.col("id").alias("b"), F.col("size").alias("sb"))
    cand = a.join(b, "key").where("a < b").where((F.col("sb") >= F.lit(threshold) * F.col("sa")) & (F.col("sa") >= F.lit(threshold) * F.col("sb"))).select("a", "b").distinct()
    s = sets.select(*group, "id", "toks")
    both = cand.join(s.select(*group, F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(s.select(F.col("id").alias("b"), F.col("toks").alias("tb"), F.struct(*group).alias("gb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similarity = shared / (F.size("ta") + F.size("tb") - shared)
    return both.where(F.struct(*group) == F.col("gb")).withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select(*group, "a", "b", "similarity")


def similar_pairs(sets: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(group..., a, b, similarity) of distinct sets with a < b."""
    return _exact_pairs(sets, group, threshold).withColumn("similarity", F.round("similarity", 6))


def max_similarity(sets: DataFrame, group: list[str], bound: float | None = None) -> DataFrame:
    """(group..., id, copies, max_similarity): each set's greatest similarity to another record of its group.

    A set held by several records has 1.0. Every other set is compared with every set of its
    group: the sets travel once, in compressed chunks, and no pair leaves the worker it is
    compared in. Time is quadratic in the sets of a group, memory is not, disk only beyond `BLOCK` sets. `bound`
    once chose another way to the same result; it is taken and changes nothing.
    """
    return _best_match(sets, group).withColumn("max_similarity", F.round("max_similarity", 6))


def _best_match(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group..., id, copies, max_similarity) unrounded, of `token_sets` or `token_rows`.

    Each task packs its sets by group, equal ones as one. Groups of more than about `BLOCK`
    sets are cut into blocks, equal sets into the same, and each pair of blocks is a unit of
    work of its own, so no worker holds more than two blocks.
    """
    n = F.approx_count_distinct("_text") if "_text" in sets.columns else F.count("id")
    large = sets.groupBy(*group).agg(n.alias("n"), F.max("copies").alias("c")).where((F.col("n") > BLOCK) & (F.col("c") > 0))  # reads copies so that both uses share one shuffle
    large = F.broadcast(large.select(*[F.col(g).alias(f"_{g}") for g in group], F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # at most one row per BLOCK sets
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    k = sets.join(large, same, "left").select(*group, F.coalesce("blocks", F.lit(1)).alias("blocks"), "id", "copies", F.array_join("toks", " ").alias("words"))
    k = k.select(*group, "blocks", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int").alias("block"), "id", "copies", "words")
    of = [sets.schema[c] for c in group]
    packed = [StructField("blocks", IntegerType()), StructField("block", IntegerType()), StructField("ids", ArrayType(sets.schema["id"].dataType)), StructField("copies", ArrayType(LongType())), StructField("size", LongType()), StructField("words", BinaryType())]
    k = k.mapInArrow(_pack([*group, "blocks", "block"]), StructType(of + packed))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("block", i).alias("a"), F.greatest("block", i).alias("b")))
    k = k.withColumn("unit", F.explode(units)).select(*group, "unit.a", "unit.b", "block", "ids", "copies", "size", "words")
    schema = StructType(of + [sets.schema["id"], StructField("copies", LongType()), StructField("m", DoubleType())])
    found = k.groupBy(*group, "a", "b").applyInArrow(_unit(group), schema)
    return found.groupBy(*group, "id").agg(F.max("copies").alias("copies"), F.max("m").alias("m")).select(*group, "id", "copies", F.when(F.col("copies") > 1, 1.0).otherwise(F.col("m")).alias("max_similarity"))


def _merged(t: pa.Table, by: list[str]) -> pa.Table:
    """Rows equal in `by` as one, with the smallest id and the sum of copies."""
    t = t.take(pc.sort_indices(t, [("id", "ascending")]))
    first, which = np.unique(_codes(t, by), return_index=True, return_inverse=True)[1:]
    copies = np.zeros(len(first), np.int64)
    np.add.at(copies, which, t.column("copies").to_numpy())
    return t.take(pa.array(first)).set_column(t.column_names.index("copies"), "copies", pa.array(copies))


def _codes(t: pa.Table, by: list[str]) -> np.ndarray:
    """A number for each row, the same where all of `by` are, NULLs included."""
    code = np.zeros(len(t), np.int64)
    for c in by:
        d = t.column(c).combine_chunks().dictionary_encode("encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
    return code


def _pack(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of the sets that a task has of a block: their words, one set a line, as compressed bytes."""

    def chunks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _merged(pa.Table.from_batches(held), [*by, "words"])
        code = _codes(t, by)
        order = np.argsort(code, kind="stable")
        ends = np.r_[0, np.flatnonzero(np.diff(code[order])) + 1, len(order)]
        t = t.take(pa.array(order)).combine_chunks()
        words = ["\n".join(t.column("words").slice(i, j - i).to_pylist()).encode() for i, j in pairwise(ends)]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t.column(c).combine_chunks()) for c in ("id", "copies")]
        zstd = pa.Codec("zstd", 3)
        columns = [*[c.combine_chunks() for c in t.select(by).take(pa.array(ends[:-1])).columns], *lists, pa.array([len(w) for w in words], pa.int64()), pa.array([zstd.compress(w, asbytes=True) for w in words], pa.binary())]
        yield from pa.table(columns, [*by, "ids", "copies", "size", "words"]).to_batches(1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += b.nbytes
            if size > PACK:
                yield from chunks(held)
                held, size = [], 0
        if held:
            yield from chunks(held)

    return run


def _unit(group: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Best matches of a unit: of the sets of one block among themselves, or of two blocks with each other."""

    def run(t: pa.Table) -> pa.Table:
        zstd = pa.Codec("zstd")
        lines = b"\n".join(zstd.decompress(w.as_buffer(), n.as_py(), asbytes=True) for w, n in zip(t.column("words"), t.column("size"), strict=True))
        words = pc.split_pattern(pa.array([lines.decode()], pa.large_string()), "\n").flatten()
        ids = t.column("ids").combine_chunks()
        first = np.repeat(t.column("block").to_numpy() == t.column("a")[0].as_py(), ids.value_lengths().to_numpy())
        s = _merged(pa.table([ids.flatten(), t.column("copies").combine_chunks().flatten(), words, pa.array(first)], ["id", "copies", "words", "first"]), ["words"])
        toks = pc.split_pattern(s.column("words").combine_chunks(), " ")
        second = None if t.column("a")[0] == t.column("b")[0] else ~s.column("first").to_numpy()
        m = best_matches(toks.flatten().dictionary_encode().indices.to_numpy(), toks.value_lengths().to_numpy(), second)
        return t.select(group).take(pa.array(np.zeros(len(s), np.int64))).append_column("id", s.column("id")).append_column("copies", s.column("copies")).append_column("m", pa.array(m))

    return run


def best_matches(keys: np.ndarray, sizes: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Each set's greatest similarity to another set, or, where `second` tells two blocks apart, to a set of the other block.

    `keys` holds the tokens of all sets, one set after the other. Overlaps are counted for
    `ROWS` sets at a time against all that follow: frequent tokens as a product of 0/1
    matrices (sums in single precision, exact below 2^24), the others through their postings.
    Sets lie in order of size, so the largest overlap with each size is enough.
    """
    n = len(sizes)
    part = np.zeros(n, bool) if second is None else second
    order = np.lexsort((sizes, part))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    row, size = np.repeat(rank, sizes), sizes[order].astype(np.int64)
    rows_end = n if second is None else int(n - part.sum())
    code = np.unique(keys, return_inverse=True)[1]
    own = np.bincount(code[row < rows_end], minlength=code.max(initial=0) + 1)
    if second is None:
        other, useful = own, own > 1
    else:
        other = np.bincount(code[row >= rows_end], minlength=len(own))
        useful = (own > 0) & (other > 0)
    meets = own.astype(float) * other
    cols = n if second is None else n - rows_end
    frequent = np.flatnonzero(useful & (meets > FREQUENT * rows_end * cols))
    frequent = frequent[np.argsort(-meets[frequent], kind="stable")[:COLUMNS]]
    place = np.full(len(own), -1)
    place[frequent] = np.arange(len(frequent))
    matrix = np.zeros((n, len(frequent)), np.float32)
    at = place[code] >= 0
    matrix[row[at], place[code[at]]] = 1

    rare = useful[code] & ~at
    r, c = row[rare], code[rare]
    by_code = np.lexsort((r, c))
    if second is not None:
        by_code = by_code[r[by_code] >= rows_end]
    posting, held = r[by_code], np.bincount(c[by_code], minlength=len(own))
    end = np.cumsum(held)
    start = end - held
    by_row = np.argsort(r, kind="stable")
    r, c = r[by_row], c[by_row]

    best = np.zeros(n)
    for p in range(0, rows_end, ROWS):
        q = min(p + ROWS, rows_end)
        lo = p if second is None else rows_end
        overlap = matrix[p:q] @ matrix[lo:].T
        flat, width = overlap.reshape(-1), n - lo
        x, y = np.searchsorted(r, (p, q))
        total = np.cumsum(end[c[x:y]] - start[c[x:y]])
        i = 0
        while i < y - x:  # whole entries, about `PIECE` additions at a time
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, "right")))
            e = c[x + i : x + j]
            many = end[e] - start[e]
            to = np.arange(many.sum()) + np.repeat(start[e] - (np.cumsum(many) - many), many)
            np.add.at(flat, np.repeat((r[x + i : x + j] - p) * width - lo, many) + posting[to], np.float32(1))
            i = j
        if second is None:
            np.add.at(start, c[x:y], 1)  # these rows are done and lead their postings
            overlap[np.arange(q - p), np.arange(q - p)] = 0
        s = np.r_[0, np.flatnonzero(np.diff(size[lo:])) + 1]
        o = np.maximum.reduceat(overlap, s, axis=1).astype(float)
        best[p:q] = np.maximum(best[p:q], (o / (size[p:q, None] + size[lo:][s] - o)).max(axis=1))
        s = np.r_[0, np.flatnonzero(np.diff(size[p:q])) + 1, q - p]
        for i, j in pairwise(s):
            o = overlap[i:j].max(axis=0).astype(float)
            best[lo:] = np.maximum(best[lo:], o / (size[p + i] + size[lo:] - o))
    return best[rank]


def mean_max_similarity(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group..., mean_max_similarity): mean over the records of their best match; 0 with fewer than two records. Of `token_sets` or `token_rows`."""
    m = _best_match(sets, group).groupBy(*group).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("max_similarity")).alias("s"))
    return m.select(*group, F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("s") / F.col("n"), 6)).alias("mean_max_similarity"))


def components(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(id, component): smallest id reachable over pairs."""
    return graph.components(pairs, "a", "b")


def repetition(sets: DataFrame, group: list[str], threshold: float, least_records: int, least_similar: int, records: DataFrame | None = None, asset: str | None = None) -> DataFrame:
    """Per group: records, largest set of linked records, similarity range over its pairs, distinct assets, status.

    Pairs are those of records at or above the threshold, equal records included, so a set
    held by c records has c (c - 1) / 2 pairs of similarity 1. `records` (group..., toks,
    `asset`) gives the distinct assets; without it they are NULL.
    """
    ensure_checkpoint_dir(sets.sparkSession)
    sets = sets.checkpoint()
    pairs = _exact_pairs(sets, group, threshold).checkpoint()
    sized = sets.join(components(pairs, group), "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = sized.groupBy(*group, "component").agg(F.sum("copies").alias("n_similar"), F.sum(F.col("copies") * (F.col("copies") - 1) / 2).alias("n_equal"))
    top = per.groupBy(*group).agg(F.max_by(F.struct("n_similar", "component", "n_equal"), F.struct(F.col("n_similar"), -F.col("component"))).alias("t"), F.sum("n_similar").alias("records"))
    top = top.select(*group, "records", "t.n_similar", "t.component", "t.n_equal")
    member = sized.join(top.select(*group, "component"), [*group, "component"]).select(*group, "id", "toks", "copies", "component")
    c = member.select("id", "copies", "component")
    own = pairs.select("a", "b", "similarity").join(c.select(F.col("id").alias("a"), F.col("copies").alias("ca"), "component"), "a").join(c.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
    stats = own.groupBy("component").agg(F.sum(F.col("ca") * F.col("cb")).alias("n"), F.min("similarity").alias("lo"), F.max("similarity").alias("hi"), F.sum(F.col("ca") * F.col("cb") * F.col("similarity")).alias("s"))
    top = top.join(stats, "component", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})
    some = F.col("n") + F.col("n_equal")
    if records is not None:
        assets = records.join(member.select(*group, "toks", "component"), [*group, "toks"]).groupBy(*group).agg(F.countDistinct(asset).alias("assets"))
        top = top.join(assets, group, "left")
    else:
        top = top.withColumn("assets", F.lit(None).cast("bigint"))
    status = F.when((F.col("records") < least_records) | (F.col("n_similar") < least_similar), "NOT_EVALUABLE").otherwise("REPETITION")
    return top.select(
        *group, "records", "n_similar", "component", F.round(F.when(F.col("n_equal") > 0, F.coalesce("lo", F.lit(1.0))).otherwise(F.col("lo")), 4).alias("min_similarity"),
        F.round(F.when(some > 0, (F.col("s") + F.col("n_equal")) / some), 4).alias("mean_similarity"), F.round(F.when(F.col("n_equal") > 0, 1.0).otherwise(F.col("hi")), 4).alias("max_similarity"), "assets", status.alias("status"),
    )


def signature(toks: Column | str, permutations: int = PERMUTATIONS, seed: int = 42) -> Column:
    """MinHash of a token array: per permutation the smallest 64-bit hash of its tokens, the same in every run."""
    t = F.col(toks) if isinstance(toks, str) else toks
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda i: F.array_min(F.transform(t, lambda x: F.xxhash64(x, i, F.lit(seed)))))


def estimated_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal places of two signatures."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(same)


def band_index(sets: DataFrame, group: list[str], permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(group..., id, band, key): the index table; sets that meet in a (band, key) are candidates. Write it to keep it."""
    s = sets.select(*group, "id", signature("toks", permutations).alias("sig"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(permutations // rows - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", i * rows + 1, rows)).alias("key")))
    return s.select(*group, "id", F.explode(keys).alias("k")).select(*group, "id", "k.band", "k.key")


def indexed_pairs(sets: DataFrame, index: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(group..., a, b, similarity) of candidates from a band index, verified on the sets.

    A pair of similarity s is missed with probability (1 - s^rows)^bands: at 0.8 with the
    defaults 4e-15. `similar_pairs` has no such error.
    """
    a, b = index.select(*group, "band", "key", F.col("id").alias("a")), index.select(*group, "band", "key", F.col("id").alias("b"))
    cand = a.join(b, [*group, "band", "key"]).where("a < b").select(*group, "a", "b").distinct()
    s = sets.select("id", "toks")
    both = cand.join(s.select(F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(s.select(F.col("id").alias("b"), F.col("toks").alias("tb")), "b")
    return both.withColumn("similarity", F.round(jaccard("ta", "tb"), 6)).where(F.col("similarity") >= threshold).select(*group, "a", "b", "similarity")
