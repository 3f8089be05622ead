"""Result caches: on the driver, as tables replayed from an access log, and by similarity of the query."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .nearest import nearest
from .vector_search import lsh_index, lsh_query


class Backend:
    """What a cache store offers; an external store (say a network cache) is one more subclass."""

    def get(self, key: str) -> object | None: ...
    def set(self, key: str, value: object) -> None: ...
    def delete(self, key: str) -> bool: ...
    def clear(self) -> int: ...
    def size(self) -> int: ...


class MemoryCache(Backend):
    """Least recently used entries within a time to live; a size of 0 keeps nothing."""

    def __init__(self, max_size: int = 1000, ttl: float = 3600.0, now: Callable[[], float] = time.monotonic):
        self.max_size, self.ttl, self.now = max_size, ttl, now
        self._rows: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(query: str, **params: object) -> str:
        return hashlib.md5(f"{query}:{json.dumps(params, sort_keys=True)}".encode()).hexdigest()

    def get(self, key: str) -> object | None:
        found = self._rows.get(key)
        if found is None or self.now() - found[0] > self.ttl:
            self._rows.pop(key, None)
            self.misses += 1
            return None
        self._rows.move_to_end(key)
        self.hits += 1
        return found[1]

    def set(self, key: str, value: object) -> None:
        if self.max_size <= 0:
            return
        self._rows.pop(key, None)
        while len(self._rows) >= self.max_size:
            self._rows.popitem(last=False)
        self._rows[key] = (self.now(), value)

    def delete(self, key: str) -> bool:
        return self._rows.pop(key, None) is not None

    def clear(self) -> int:
        n = len(self._rows)
        self._rows.clear()
        return n

    def size(self) -> int:
        return len(self._rows)

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"size": self.size(), "max_size": self.max_size, "ttl": self.ttl, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}


class PrefixCache(Backend):
    """Keys under a prefix of a client with get, setex, delete and scan_iter (an external store)."""

    def __init__(self, client: object, prefix: str = "search:", ttl: int = 3600):
        self.client, self.prefix, self.ttl = client, prefix, ttl
        self.hits = self.misses = 0

    def get(self, key: str) -> object | None:
        raw = self.client.get(self.prefix + key)
        self.hits, self.misses = self.hits + bool(raw), self.misses + (not raw)
        return json.loads(raw) if raw else None

    def set(self, key: str, value: object) -> None:
        self.client.setex(self.prefix + key, self.ttl, json.dumps(value))

    def delete(self, key: str) -> bool:
        return bool(self.client.delete(self.prefix + key))

    def clear(self) -> int:
        return sum(bool(self.client.delete(k)) for k in list(self.client.scan_iter(self.prefix + "*")))

    def size(self) -> int:
        return sum(1 for _ in self.client.scan_iter(self.prefix + "*"))

    def stats(self) -> dict:
        """Entries of the store under the prefix, and the lookups made here."""
        total = self.hits + self.misses
        return {"size": self.size(), "prefix": self.prefix, "ttl": self.ttl, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}


def cached(cache: MemoryCache, version: Callable[[], object] = lambda: 0):
    """Decorator of search(query, **options): results by query, options and the index's version."""

    def wrap(f):
        @wraps(f)
        def run(query: str, **options: object):
            key = cache.key(query, version=str(version()), **{k: str(v) for k, v in options.items()})
            got = cache.get(key)
            if got is None:
                got = f(query, **options)
                cache.set(key, got)
            return got

        return run

    return wrap


def surviving_keys(log: DataFrame, max_size: int, ttl_seconds: int, now: F.Column) -> DataFrame:
    """(key, last_access, age_rank): keys of an access log (key, ts) within the time to live, the max_size most recent."""
    last = log.groupBy("key").agg(F.max("ts").alias("last_access")).where(F.col("last_access") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    top = last.orderBy(F.desc("last_access"), "key").limit(max_size)
    return top.withColumn("age_rank", F.row_number().over(W.orderBy(F.desc("last_access"), "key")))


def semantic_lookup(entries: DataFrame, queries: DataFrame, dim: int, threshold: float = 0.95, now: F.Column | None = None) -> DataFrame:
    """(query_id, key, score, results): the best live entry (key, embedding, results, expires_at) of each query (query_id, embedding) at or over threshold; no row is a miss."""
    live = entries.where(F.col("expires_at") > (now if now is not None else F.current_timestamp()))
    keyed = live.withColumn("doc_id", F.col("key"))
    hits = lsh_query(lsh_index(keyed, dim), queries, dim, threshold)
    return _best(hits, live)


def semantic_lookup_linear(entries: DataFrame, queries: DataFrame, threshold: float = 0.95, now: F.Column | None = None) -> DataFrame:
    """The same by comparing with every live entry: matrix products where the entries lie, a row a query and task goes on. Equal scores (to 9 digits) go to the greater key."""
    live = entries.where(F.col("expires_at") > (now if now is not None else F.current_timestamp()))
    # nearest prefers the lesser id of equal scores.
    hits = nearest(live.select((-F.col("key")).alias("doc_id"), "embedding"), queries, 1).where(F.col("score") >= threshold)
    return _best(hits.select("query_id", (-F.col("doc_id")).alias("doc_id"), "score"), live)


def _best(hits: DataFrame, live: DataFrame) -> DataFrame:
    top = hits.groupBy("query_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct(F.round("score", 12), F.col("doc_id"))).alias("x"))
    return top.select("query_id", F.col("x.doc_id").alias("key"), F.col("x.score").alias("score")).join(live.select("key", "results"), "key")


def semantic_store(entries: DataFrame, new: DataFrame, max_size: int = 10_000) -> DataFrame:
    """Entries after new ones (a key again replaces its entry), the max_size latest."""
    both = entries.join(new.select("key"), "key", "left_anti").unionByName(new)
    return both.orderBy(F.desc("cached_at"), "key").limit(max_size)


def hit_stats(lookups: DataFrame) -> DataFrame:
    """hits, misses and their rate over lookups (hit boolean)."""
    return lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))
