"""Text and byte helpers as columns: URLs, headers, hints, entropy, addresses, JA3."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What hints at SQL injection or at path traversal in a URL (lower case).
SQLI_HINTS = ("union select", "union+select", "' or ", "'or'", "or 1=1", "--", "/*", "xp_", "information_schema", "sleep(", "benchmark(")
TRAVERSAL_HINTS = ("../", "..\\", "%2e%2e", "..%2f", "%252e")


def url_parts(url: Column) -> list[Column]:
    """scheme, host, port, path, query and the number of parameters."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    return [
        F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"), F.regexp_extract(authority, r"^([^:]*)", 1).alias("host"), F.regexp_extract(authority, r":([0-9]+)$", 1).alias("port"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), query.alias("query"), F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).alias("n_params"),
    ]


def header(text: Column, name: str) -> Column:
    """The value of the first header of that name, in any case; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))


def hints(url: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(url)
    found = F.lit(False)
    for mark in marks:
        found = found | low.contains(mark)
    return found


def entropy_of(raw: bytes | None) -> float:
    """Shannon entropy in bits a byte; 0 for nothing."""
    if not raw:
        return 0.0
    counts = np.bincount(np.frombuffer(raw, np.uint8))
    share = counts[counts > 0] / len(raw)
    return float(-(share * np.log2(share)).sum()) + 0.0


@F.pandas_udf(DoubleType())
def byte_entropy(raw: pd.Series) -> pd.Series:
    """Entropy of binary values, in Arrow batches: counting bytes has no built-in function. Null counts as empty."""
    return raw.map(entropy_of, na_action=None)


def ip_number(ip: Column | str) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).cast("bigint") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def ip_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, 8 * (3 - k)).bitwiseAND(255).cast("string") for k in range(4)])


def grease(x: Column) -> Column:
    """Whether a TLS value is one of the reserved ones: both bytes alike, ending in A."""
    return (x.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(255))


def ja3(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> tuple[Column, Column]:
    """(text, MD5) of a ClientHello's fingerprint; reserved values are left out."""

    def joined(values: Column, drop: bool = True) -> Column:
        kept = F.filter(F.coalesce(values, F.array().cast("array<bigint>")), lambda x: ~grease(x)) if drop else F.coalesce(values, F.array().cast("array<bigint>"))
        return F.array_join(F.transform(kept, lambda x: x.cast("string")), "-")

    text = F.concat(version.cast("string"), F.lit(","), joined(ciphers), F.lit(","), joined(extensions), F.lit(","), joined(groups), F.lit(","), joined(formats, False))
    return text, F.md5(text.cast("binary"))


def ja3s(version: Column, cipher: Column, extensions: Column) -> tuple[Column, Column]:
    text = F.concat(version.cast("string"), F.lit(","), cipher.cast("string"), F.lit(","), F.array_join(F.transform(F.filter(F.coalesce(extensions, F.array().cast("array<bigint>")), lambda x: ~grease(x)), lambda x: x.cast("string")), "-"))
    return text, F.md5(text.cast("binary"))
