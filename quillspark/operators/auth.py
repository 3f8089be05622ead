"""API keys as a table: hash, name, scopes, limits and validity."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
import secrets
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key_hash string, name string, prefix string, scopes array<string>, rate_limit int, enabled boolean, created_at timestamp_ntz, expires_at timestamp_ntz"


def digest(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def generate(spark: SparkSession, name: str, scopes: tuple[str, ...] = ("search", "index"), rate_limit: int = 100, expires_days: int | None = None, now: datetime | None = None) -> tuple[str, DataFrame]:
    """A new key, shown once, and its row."""
    key, now = secrets.token_urlsafe(32), now or datetime.now()
    return key, spark.createDataFrame([(digest(key), name, key[:8], list(scopes), rate_limit, True, now, now + timedelta(days=expires_days) if expires_days else None)], SCHEMA)


def validate(keys: DataFrame, key: str, scope: str | None = None, now: F.Column | None = None) -> DataFrame:
    """The key's row if it exists, is enabled, has not expired and has the scope."""
    at = now if now is not None else F.localtimestamp()
    ok = (F.col("key_hash") == digest(key)) & F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > at))
    return keys.where(ok if scope is None else ok & F.array_contains("scopes", scope))


def revoke(keys: DataFrame, key: str) -> DataFrame:
    return keys.withColumn("enabled", F.col("enabled") & (F.col("key_hash") != digest(key)))


def masked(keys: DataFrame) -> DataFrame:
    return keys.select(F.concat("prefix", F.lit("...")).alias("key"), "name", "scopes", "rate_limit", "enabled", "created_at", "expires_at")


class Denied(Exception):
    """A refused request: HTTP status, reason and response headers."""

    def __init__(self, status: int, reason: str, headers: dict[str, str] | None = None):
        super().__init__(reason)
        self.status, self.headers = status, headers or {}


def presented(headers: Mapping[str, str], params: Mapping[str, str] | None = None) -> str | None:
    """The key a request carries: the header X-API-Key (in any case), else the parameter api_key."""
    lower = {k.lower(): v for k, v in headers.items()}
    return lower.get("x-api-key") or (params or {}).get("api_key")


def limit_headers(info: Mapping[str, int]) -> dict[str, str]:
    """Response headers of a limiter's answer."""
    names = {"limit": "X-RateLimit-Limit", "remaining": "X-RateLimit-Remaining", "reset": "X-RateLimit-Reset", "retry_after": "Retry-After"}
    return {h: str(info[k]) for k, h in names.items() if k in info}


def authorise(keys: DataFrame, key: str | None, limiter: object, scope: str | None = None, address: str | None = None) -> tuple[Row | None, dict[str, str]]:
    """(key's row, response headers) of a request that may pass, else Denied: 401 without a valid key, 429 over the key's limit, 403 without the scope.

    With an address a request without a key is let in, under the lower limit of its address.
    """
    from ..streaming.stateful import IP_LIMIT

    if key is None and address is None:
        raise Denied(401, "API key required", {"WWW-Authenticate": "ApiKey"})
    found = validate(keys, key).collect() if key is not None else [None]
    if not found:
        raise Denied(401, "invalid or expired API key")
    ok, info = limiter.check(key, found[0]["rate_limit"]) if found[0] else limiter.check(f"ip:{address}", IP_LIMIT)
    if not ok:
        raise Denied(429, "rate limit exceeded", limit_headers(info))
    if scope is not None and (found[0] is None or scope not in found[0]["scopes"]):
        raise Denied(403, f"scope {scope!r} required", limit_headers(info))
    return found[0], limit_headers(info)
