"""Files for people: guarded CSV, JSON with sorted keys, a manifest of hashes, a deterministic archive."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = frozenset("con prn aux nul".split()) | {f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)}
MAX_UNPACKED, MAX_FILES = 4 << 30, 100_000


def guarded(value: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe; numbers are left alone."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_line(df: DataFrame, sep: str = ";") -> DataFrame:
    """One column ``line``: every field quoted, strings guarded."""
    cells = [F.concat(F.lit('"'), F.regexp_replace(F.coalesce((guarded(F.col(c)) if t == "string" else F.col(c)).cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c, t in df.dtypes]
    return df.select(F.concat_ws(sep, *cells).alias("line"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """For spreadsheets: byte-order mark, semicolons, CRLF.  Rows stream to the driver one partition at a time."""
    head = ";".join(f'"{c}"' for c in df.columns)
    rows = csv_line(df.orderBy(*order)).toLocalIterator()
    write_atomic(path, (("﻿" + head + "\r\n").encode(), *((r.line + "\r\n").encode() for r in rows)))


def write_atomic(path: str, parts) -> None:
    """Written beside its place and moved there whole."""
    beside = f"{path}.part"
    with open(beside, "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(beside, path)


def write_json(value: object, path: str) -> None:
    write_atomic(path, [json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2).encode()])


def safe_name(name: str) -> bool:
    """A relative path that means the same on every system."""
    p = PurePosixPath(name)
    return bool(name) and "\\" not in name and ":" not in name and not p.is_absolute() and ".." not in p.parts and all(x.split(".")[0].lower() not in RESERVED and not x.endswith((".", " ")) for x in p.parts)


def pack(folder: str) -> bytes:
    """ZIP of a folder with a manifest of sizes and hashes; equal folders give equal bytes."""
    names = sorted(str(p.relative_to(folder).as_posix()) for p in Path(folder).rglob("*") if p.is_file())
    data = {n: Path(folder, n).read_bytes() for n in names}
    manifest = {"version": 1, "files": {n: {"size": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in data.items()}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in [("manifest.json", json.dumps(manifest, sort_keys=True).encode()), *((f"library/{n}", b) for n, b in data.items())]:
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), b)
    return out.getvalue()


def unpack(archive: bytes) -> dict[str, bytes]:
    """Files of a packed folder after checking names, sizes and hashes."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        infos = z.infolist()
        if len(infos) > MAX_FILES or sum(i.file_size for i in infos) > MAX_UNPACKED or len({i.filename for i in infos}) < len(infos):
            raise ValueError("too many files, too large, or a name twice")
        if not all(safe_name(i.filename) and i.external_attr >> 28 != 0xA for i in infos):
            raise ValueError("unsafe name")
        want = json.loads(z.read("manifest.json"))["files"]
        got = {i.filename.removeprefix("library/"): z.read(i) for i in infos if i.filename.startswith("library/")}
    if set(want) != set(got) or any(len(b) != want[n]["size"] or hashlib.sha256(b).hexdigest() != want[n]["sha256"] for n, b in got.items()):
        raise ValueError("files and manifest differ")
    return got


def write_plain_csv(df: DataFrame, path: str) -> None:
    """Plain comma-separated files with a header, for programs."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_config(path: str) -> dict:
    """A YAML mapping of settings; anything else is an error.  Needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got
