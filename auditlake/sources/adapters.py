"""Local API adapters and packed submissions."""

from __future__ import annotations

import stat
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from auditlake.operators.integrity import within

MAX_MEMBERS, MAX_TOTAL, MAX_MEMBER = 10_000, 4 << 30, 1 << 30
_ADAPTERS: dict[str, Callable[[], Iterable[dict]]] = {}


def register_adapter(name: str, fetch: Callable[[], Iterable[dict]]) -> None:
    """Register a local producer of records; addresses are refused."""
    if "://" in name:
        raise ValueError("only local adapters can be registered")
    _ADAPTERS[name] = fetch


def read_adapter(spark: SparkSession, name: str) -> DataFrame:
    if name not in _ADAPTERS:
        raise ValueError(f"no adapter {name!r}")
    records = [{str(k): v for k, v in r.items()} for r in _ADAPTERS[name]()]
    columns = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(None if (v := r.get(c)) is None else str(v) for c in columns) for r in records], ", ".join(f"`{c}` string" for c in columns))


def check_package(path: str) -> list[str]:
    """Problems of a ZIP package; an empty list means it may be unpacked."""
    out = []
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        if len(infos) > MAX_MEMBERS:
            out.append("too many members")
        if sum(i.file_size for i in infos) > MAX_TOTAL:
            out.append("too large unpacked")
        for i in infos:
            if i.file_size > MAX_MEMBER:
                out.append(f"{i.filename}: too large")
            if i.flag_bits & 1:
                out.append(f"{i.filename}: encrypted")
            if stat.S_ISLNK(i.external_attr >> 16):
                out.append(f"{i.filename}: a link")
            if i.filename.startswith(("/", "\\")) or ".." in Path(i.filename.replace("\\", "/")).parts:
                out.append(f"{i.filename}: leads outside")
    return out


def unpack(path: str, to: str) -> list[Path]:
    """Unpack a checked package below a folder."""
    if bad := check_package(path):
        raise ValueError("; ".join(bad))
    out = []
    with zipfile.ZipFile(path) as z:
        for i in z.infolist():
            if not i.is_dir():
                p = within(to, i.filename)
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(z.read(i))
                out.append(p)
    return out
