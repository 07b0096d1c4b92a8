"""Columns that look for instructions in untrusted text, redact it, and sign reports."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.catalog import INJECTION, REDACTIONS
from quernstone.functions import canonical as canonical_json

ALGORITHM = "HMAC-SHA256"
KEY_VARIABLE = "QUERNSTONE_SIGNING_KEY"
_own_key: bytes | None = None


def signing_key() -> bytes:
    """The key of the environment; else one of this process, whose signatures nobody can
    verify after it has ended."""
    global _own_key
    if key := os.environ.get(KEY_VARIABLE):
        return key.encode()
    if _own_key is None:
        _own_key = secrets.token_hex(32).encode()
    return _own_key


def injections(text: Column) -> Column:
    """The first match of each pattern, in the patterns' order."""
    hits = [F.regexp_extract(text, "(?idu)(" + p + ")", 1) for p in INJECTION]
    return F.filter(F.array(*hits), lambda x: x != "")


def suspicious(text: Column) -> Column:
    out = F.lit(False)
    for p in INJECTION:
        out = out | text.rlike("(?idu)" + p)
    return out


def redacted(text: Column) -> Column:
    """(text, counts): each pattern works on what the ones before left; counts only has the
    patterns that matched."""
    counts = []
    for name, pattern, exact in REDACTIONS:
        pattern = pattern if exact else "(?i)" + pattern
        counts.append(F.struct(F.lit(name).alias("key"), F.regexp_count(text, F.lit(pattern)).alias("value")))
        text = F.regexp_replace(text, pattern, f"[REDACTED_{name.upper()}]")
    found = F.filter(F.array(*counts), lambda c: c["value"] > 0)
    return F.struct(text.alias("text"), F.map_from_entries(found).alias("counts"))


def cache_key(model: Column, field: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, field, text), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC over built-in hashes: no Python runs. message: string or binary."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def canonical(entries: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys, of values that are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), entries[k]) for k in sorted(entries)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string, with escapes for all that is not ASCII."""
    return F.when(text.isNull(), F.lit("null")).otherwise(canonical_json.string(text))


def signed(key: bytes, entries: dict[str, Column], generated_at: Column) -> Column:
    """(hmac, generated_at, algorithm) over the payload and the time, which is hashed as text."""
    payload = canonical({**entries, "_generated_at": F.concat(F.lit('"'), generated_at, F.lit('"'))})
    return F.struct(hmac_sha256(key, payload).alias("hmac"), generated_at.alias("generated_at"), F.lit(ALGORITHM).alias("algorithm"))


def verified(key: bytes, entries: dict[str, Column], integrity: Column) -> Column:
    """Whether the block fits the payload; a missing block does not."""
    again = signed(key, entries, integrity["generated_at"])["hmac"]
    return F.coalesce(again == integrity["hmac"], F.lit(False))
