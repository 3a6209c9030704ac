"""Column profiles: counts, distinct values, ranges, samples, duplicates.

Everything but exact distinct counts is one pass of partial aggregates; distinct
(column, value) pairs are counted once per value type. Results are one row per column,
small whatever the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.columns import is_scan_null

SPREAD = 0.8  # fixed value: share of distinct values above which a text column may be an identifier
DOUBT = 0.15  # three standard errors of the sketched counts
IDENTIFIER_HINTS = ("id", "host", "hostname", "asset", "device", "server", "system", "machine")  # fixed values
COMMON_LABELS = {"critical", "high", "medium", "low", "open", "closed", "pending", "yes", "no", "true", "false"}  # fixed values


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def _kind(t: T.DataType) -> str:
    """Type in which values of a column are told apart: none of them folds two values into one."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint"
    return "double" if isinstance(t, (T.FloatType, T.DoubleType)) else t.simpleString() if isinstance(t, T.DecimalType) else "string"


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(place, unique_values): exact distinct values per column, by position in `columns`.

    (column, value) pairs are counted once with map-side combination, in the narrowest
    type that keeps values apart; the second step sees one row per pair.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    by_kind: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(columns):
        by_kind.setdefault(_kind(kinds[c]), []).append((i, c))
    parts = []
    for kind, cols in by_kind.items():
        cells = F.array(*[F.struct(F.lit(i).alias("place"), (F.when(~is_scan_null(c), F.col(c).cast("string")) if kind == "string" else F.col(c).cast(kind)).alias("v")) for i, c in cols])
        pairs = df.select(F.explode(cells).alias("c")).select("c.*").where("v IS NOT NULL").groupBy("place", "v").agg(F.count("*").alias("n"))
        parts.append(pairs.groupBy("place").agg(F.count("*").alias("unique_values")))
    return reduce(DataFrame.unionByName, parts)


def inventory(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, unique_values, null_values, total_rows, min, max, mean, std) per column.

    NA spellings of text columns count as null; a single value has std 0. Numeric
    figures are NULL for text columns. An empty table gives zero counts. Counts, ranges and
    means take one pass without a shuffle of values; distinct counts are exact, or sketches
    with a relative error of about 5 % where `approximate`.
    """
    cols = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs, cells = [F.count("*").alias("n")], []
    for j, c in enumerate(cols):
        num = is_numeric(kinds[c])
        v = F.col(c) if num else F.when(~is_scan_null(c), F.col(c).cast("string"))
        aggs.append(F.count(v).alias(f"p{j}"))
        if approximate:
            aggs.append(F.approx_count_distinct(v).alias(f"d{j}"))
        figures = {k: F.lit(None).cast("double") for k in ("min", "max", "mean", "std")}
        if num:
            x = F.col(c).cast("int").cast("double") if isinstance(kinds[c], T.BooleanType) else F.col(c).cast("double")
            aggs += [F.min(x).alias(f"a{j}"), F.max(x).alias(f"z{j}"), F.avg(x).alias(f"m{j}"), F.stddev_samp(x).alias(f"s{j}")]
            std = F.when(F.col(f"m{j}").isNotNull(), F.coalesce(F.col(f"s{j}"), F.lit(0.0)))
            figures = {"min": F.col(f"a{j}"), "max": F.col(f"z{j}"), "mean": F.round(F.col(f"m{j}"), 4), "std": F.round(std, 4)}
        unique = F.col(f"d{j}") if approximate else F.lit(None).cast("bigint")
        cells.append(F.struct(F.lit(j).alias("place"), F.lit(c).alias("column_name"), F.lit("numeric" if num else "text").alias("kind"), unique.alias("unique_values"), (F.col("n") - F.col(f"p{j}")).alias("null_values"), F.col("n").alias("total_rows"), *[v.alias(k) for k, v in figures.items()]))
    out = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if not approximate:
        out = out.drop("unique_values").join(distinct_counts(df, cols), "place", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    return out.select("column_name", "kind", "unique_values", "null_values", "total_rows", "min", "max", "mean", "std")


def appearance_samples(df: DataFrame, column: str, order: str, limit: int = 10) -> DataFrame:
    """First `limit` distinct values in order of first appearance (a sample is the feature)."""
    v = df.where(~is_scan_null(column)).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first_row"))
    return v.orderBy("first_row", "value").limit(limit)


def all_samples(df: DataFrame, columns: list[str], order: str, limit: int = 10, salts: int = 64) -> DataFrame:
    """(column_name, samples): first `limit` distinct values of every column, in order of appearance, in one pass.

    Distinct values meet per (column, value); the smallest positions are picked per salt
    first, so no task holds a whole column and the last step sees salts x limit rows a column.
    """
    cells = df.select(F.col(order).alias("_o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~is_scan_null(c), F.col(c).cast("string")).alias("value")) for c in columns])).alias("c"))
    first = cells.select("_o", "c.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.min("_o").alias("o")).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
    near = first.withColumn("r", F.row_number().over(Window.partitionBy("column_name", "salt").orderBy("o", "value"))).where(F.col("r") <= limit)
    last = near.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("o", "value"))).where(F.col("r") <= limit)
    return last.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x.value).alias("samples"))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of values that occur more than once."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def top_with_truncation(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """One row: most frequent repeated values, count then value, with a flag that more exist (a top-k report)."""
    return _listed(duplicate_values(df, column).orderBy(F.desc("n"), "value").limit(limit + 1), [F.desc("n"), F.col("value")], limit)


def distinct_with_truncation(df: DataFrame, column: str, limit: int = 1000) -> DataFrame:
    """One row: the first distinct values in order, with a flag that more exist (a top-k report)."""
    return _listed(distinct_values(df, column).orderBy("value").limit(limit + 1), [F.col("value")], limit)


def _listed(top: DataFrame, order: list, limit: int) -> DataFrame:
    """The values of a few ordered rows as one list."""
    r = top.withColumn("r", F.row_number().over(Window.orderBy(*order)))  # at most limit + 1 rows
    return r.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= limit, F.struct("r", "value")))), lambda x: x.value.cast("string")).alias("values"), (F.count("*") > limit).alias("truncated"))


def case_conflicts(df: DataFrame, column: str) -> DataFrame:
    """(key, kept, other): identifiers equal but for letter case; the first in sort order against each later one."""
    ids = df.where(F.col(column).isNotNull()).select(F.trim(F.col(column)).alias("id")).withColumn("key", F.lower("id"))
    # One number per key tells whether it has several spellings; only those few keys are looked at as text.
    h = F.xxhash64("id")
    several = ids.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("key")
    few = ids.join(several, "key", "left_semi").distinct()
    return few.join(few.groupBy("key").agg(F.min("id").alias("kept")), "key").where("id <> kept").select("key", "kept", F.col("id").alias("other"))


def dataset_profile(inv: DataFrame) -> DataFrame:
    """One row: rows, columns, mean null share in percent."""
    return inv.agg(F.max("total_rows").alias("records"), F.count("*").alias("columns"), F.round(F.avg(F.when(F.col("total_rows") > 0, F.col("null_values") / F.col("total_rows"))) * 100, 2).alias("missing_percent"))


def category(name: str, numeric: bool, unique: int, rows: int, samples: list[str]) -> str:
    """numeric, identifier or categorical."""
    if numeric:
        return "numeric"
    if any(h in name.lower() for h in IDENTIFIER_HINTS):
        return "identifier"
    spread = rows > 0 and unique / rows > SPREAD
    size = sum(map(len, samples)) / len(samples) if samples else 0
    return "identifier" if spread and size >= 6 and not any(s.lower() in COMMON_LABELS for s in samples) else "categorical"


def first_samples(df: DataFrame, order: str, limit: int = 10, head: int = 1000) -> dict[str, list[str]]:
    """First distinct values of every column: from the first records where they suffice, else from one full pass.

    A column that shows `limit` values among the first `head` records needs no more; only
    the others, which repeat few values, are counted over all records.
    """
    cols = list(df.columns)
    start = df.orderBy(order).limit(head)
    found = {r.column_name: r.samples for r in all_samples(start, cols, order, limit).collect()}
    rest = [c for c in cols if len(found.get(c, [])) < limit]
    if rest and df.limit(head + 1).count() > head:
        found |= {r.column_name: r.samples for r in all_samples(df, rest, order, limit).collect()}
    return found


def profile_rows(df: DataFrame, order: str, sample_size: int = 10, approximate: bool = True) -> list[dict]:
    """Profile as driver-side rows (one per column) for mapping decisions: inventory, samples, category.

    Mapping compares distinct counts only with a share of the records (0.8), so they are
    sketches by default; columns whose sketched share is within three standard errors
    (`DOUBT`) of it are counted exactly, so the category is that of the exact counts.
    """
    samples = first_samples(df, order, sample_size)
    out = []
    rows = inventory(df, approximate=approximate).collect()
    near = [r.column_name for r in rows if approximate and r.kind == "text" and r.total_rows and abs(r.unique_values / r.total_rows - SPREAD) <= DOUBT]
    exact = {near[r.place]: r.unique_values for r in distinct_counts(df, near).collect()} if near else {}
    for r in rows:
        own = samples.get(r.column_name, [])
        unique = exact.get(r.column_name, r.unique_values)
        out.append({**r.asDict(), "unique_values": unique, "samples": own, "category": category(r.column_name, r.kind == "numeric", unique, r.total_rows, own)})
    return out
