"""Digests and manifests of source files: register, verify, refuse what changed."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256) of a text column; NULL for null texts."""
    return df.select(key, F.sha2(F.col(text), 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file below a path, read in parallel."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def large_file_digest(path: str, chunk: int = 1 << 20) -> str:
    """Chunked digest on the driver, for files too large for one row."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def verify(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, status): VERIFIED, INTEGRITY_FAILED, MISSING or UNREGISTERED."""
    j = manifest.select("name", F.col("sha256").alias("want")).join(observed.select("name", F.col("sha256").alias("have")), "name", "full_outer")
    s = F.when(F.col("want").isNull(), "UNREGISTERED").when(F.col("have").isNull(), "MISSING").when(F.col("want") == F.col("have"), "VERIFIED").otherwise("INTEGRITY_FAILED")
    return j.select("name", s.alias("status"))


def gate(manifest: DataFrame, observed: DataFrame) -> None:
    """Raises unless every registered file is present and unchanged."""
    bad = [f"{r.name}: {r.status}" for r in verify(manifest, observed).where("status IN ('MISSING', 'INTEGRITY_FAILED')").collect()]
    if bad:
        raise ValueError("evidence check failed: " + "; ".join(sorted(bad)))


def evidence_id(prefix: str, sha256: str, at: datetime | None = None) -> str:
    return f"{prefix}-{(at or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}-{sha256[:12]}"


def safe_name(name: str) -> str:
    """Base name with unusual characters replaced, and a hash suffix if anything changed."""
    base = re.split(r"[\\/]", name)[-1] or "file"
    clean = re.sub(r"[^A-Za-z0-9._-]", "_", base)
    return clean if clean == name else f"{clean}-{hashlib.sha256(name.encode()).hexdigest()[:8]}"


def within(root: str, name: str) -> Path:
    """Path below a root, or an error if it would lead outside."""
    base = Path(root).resolve()
    p = (base / name).resolve()
    if not p.is_relative_to(base):
        raise ValueError(f"{name!r} leads outside {root!r}")
    return p
