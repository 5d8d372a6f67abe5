"""Contents by hash for SQL: functions over the Parquet folders of stores, read by the workers where rows need them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import functions as F

EMPTY = hashlib.sha256(b"").digest()


def parse(value) -> bytes | None:
    """A hash given as 32 bytes or as hex text with blanks around; None for anything else."""
    if isinstance(value, str) and len(value := value.strip()) == 64:
        try:
            return bytes.fromhex(value)
        except ValueError:
            return None
    return value if isinstance(value, bytes) and len(value) == 32 else None


@lru_cache(16)
def _folder(path: str):
    return ds.dataset(path, format="parquet")


@lru_cache(16)
def _groups(path: str) -> list[tuple]:
    """The row groups of a folder, each with its least and greatest hash (``None``: not told)."""
    out = []
    for file in _folder(path).get_fragments():
        for group in file.split_by_row_group():
            told = (group.row_groups[0].statistics or {}).get("sha")
            out.append((told["min"], told["max"], group) if told else (b"", None, group))
    return out


def contents(folders: list[list[str]], wanted: set[bytes]) -> dict[bytes, bytes]:
    """Contents of some hashes, each from the first store that has it. A row group is read once, and only if its range of hashes holds one of them."""
    out, left = ({EMPTY: b""} if EMPTY in wanted else {}), set(wanted) - {EMPTY}
    for store in folders:
        parts: dict[bytes, dict[int, tuple[int, bytes]]] = {}
        keys = sorted(left)
        for path in store if left else ():
            for least, greatest, group in _groups(path):
                some = keys[bisect_left(keys, least) : len(keys) if greatest is None else bisect_right(keys, greatest)]
                test = ds.field("sha").isin(pa.array(some, pa.binary()))
                if not some or not group.count_rows(filter=test):
                    continue
                for batch in group.to_batches(columns=["sha", "part", "n_parts", "content"], filter=test, batch_size=64):
                    for sha, part, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                        parts.setdefault(sha, {})[part] = (n, data)
        for sha, found in parts.items():
            data = b"".join(found[k][1] for k in sorted(found))
            if len(found) != max(n for n, _ in found.values()) or hashlib.sha256(data).digest() != sha:
                raise ValueError(f"damaged content {sha.hex()}")
            out[sha] = data
        left -= set(parts)
    return out


def lookup_udf(folders: list[list[str]], as_text: bool):
    """An Arrow function from hashes to contents, or to their texts (what is no UTF-8 becomes U+FFFD)."""

    @F.arrow_udf("string" if as_text else "binary")
    def look(sha: pa.Array) -> pa.Array:
        keys = [parse(x) for x in sha.to_pylist()]
        found = contents(folders, {k for k in keys if k is not None})
        out = [found.get(k) for k in keys]
        return pa.array([x.decode(errors="replace") if x is not None else None for x in out], pa.string()) if as_text else pa.array(out, pa.binary())

    return look
