"""Deterministic, content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix_`` plus the head of the SHA-256 of the parts joined by ``::``."""
    joined = F.concat_ws("::", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, length))


def positional_id(owner: Column, kind: str, index: Column, width: int = 4) -> Column:
    """``<owner>_<kind><zero-padded index>``."""
    return F.concat(
        owner.cast("string"), F.lit(f"_{kind}"), F.lpad(index.cast("string"), width, "0")
    )


def short_md5(c: Column, length: int = 12) -> Column:
    return F.substring(F.md5(c), 1, length)
