"""Archives, small exports and caches on the driver's side."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = {"revenue", "returned_value", "gross_sales", "net_sales"}


def unpack(archive: str | Path, folder: str | Path, md5: str | None = None) -> list[Path]:
    """Check a downloaded archive against its MD5 sum and unzip it. (Downloading itself is the caller's.)"""
    data = Path(archive).read_bytes()
    if md5 and hashlib.md5(data).hexdigest() != md5:
        raise ValueError(f"{archive} doesn't have the MD5 sum {md5}")
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
        return [Path(folder, name) for name in z.namelist()]


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded (money to pence), NaN as null, dates as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType | T.FloatType):
            c = F.round(F.when(~F.isnan(c), c), 2 if field.name in MONEY else digits)
        elif isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(field.name))
    return df.select(*out)


def records(df: DataFrame, digits: int = 2) -> list[dict]:
    """A small result as dicts."""
    return [r.asDict(recursive=True) for r in rounded(df, digits).collect()]


def export(value: dict, path: str | Path) -> None:
    """Compact JSON with sorted keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, separators=(",", ":"), sort_keys=True, default=str))


class LineCache:
    """A cache of texts by key in a file of JSON lines: read at the start, appended to."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.known = {}
        if self.path.exists():
            self.known = {r["key"]: r["reply"] for r in map(json.loads, self.path.read_text().splitlines())}

    def get(self, parts, make) -> str:
        key = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
        if key not in self.known:
            self.known[key] = make()
            with self.path.open("a") as f:
                f.write(json.dumps({"key": key, "reply": self.known[key]}) + "\n")
        return self.known[key]
