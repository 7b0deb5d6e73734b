"""URL filters by Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe. Level 0 is a Bloom filter of the listed keys;
the universe's other keys that it lets through make level 1; the listed keys that level 1 lets through make level 2, and
so on until nothing is let through wrongly. The universe is the whole corpus' distinct keys, so a page's keys are tested
against the cascade alone, without a join. Level 0 has so many bits a key that about as many keys of the universe as are
listed pass it wrongly; only what passes it is compared with the list, so building joins no more than that either. Levels
are built by distributed bitmap aggregation and only their bits go to the executors: some 1.4 log2(universe / listed) + 10
for each listed key. A list whose cascade would have more than `max_bits` is not put into one: its keys are then told
apart by a join of the distinct keys with the list, and the pages by a join with those found.

Rules (host, path, verdict) fit a host and its subdomains where the page's path starts with the rule's; the longest
fitting rule wins. A page's possible rules are its host's last labels joined with its path's first characters, in the
numbers of labels and characters that rules have. Pages that no rule fits are blocked if one of their host's labels (the
parts between its dots) is among the listed ones, whatever domain it stands under, and else allowed.

Edge cases: a null url or one without :// has empty host and path, which no rule fits: allowed; very long urls are read
whole; an empty rule list, label list or table works; repeated rows are judged each; other columns, whatever their names,
are ignored by `judge`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP = 32_768


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    data: bytes = b""

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places (keys x hashes) of keys given by two 64-bit hashes; each level spreads them anew."""
        salt = np.uint64((2 * self.number + 1) * 0x9E3779B97F4A7C15 % 2**64)
        first, step = _mix(a ^ salt), _mix(b + salt) | np.uint64(1)
        return (first[:, None] + np.arange(self.hashes, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b).astype(np.int64)
        return (np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7) & 1).all(axis=1)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed: a key first missing at an odd level is."""
        listed, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for level in self.levels:
            inside = level.holds(a[open_], b[open_])
            listed[open_[~inside]] = level.number % 2 == 1
            open_ = open_[inside]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _words(batch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _level(keys: DataFrame, number: int, n: int, bits_per_key: float, max_bits: int) -> Level | None:
    """The filter of n keys (a, b); None if it would be too large."""
    level = Level(number, max(64, math.ceil(n * bits_per_key)), max(1, round(bits_per_key * math.log(2))))
    if level.bits > max_bits:
        return None

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"at": pa.array(level.positions(_words(batch, "a"), _words(batch, "b")).ravel().astype(np.int64))})

    at = keys.select("a", "b").mapInArrow(places, "at long").select((F.col("at") + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    data = bytearray(-(-level.bits // BITMAP) * BITMAP // 8)
    for r in maps:
        data[(r.bucket - 1) * BITMAP // 8 : r.bucket * BITMAP // 8] = r.bits
    return Level(number, level.bits, level.hashes, bytes(data))


def _passing(keys: DataFrame, level: Level, name: str) -> DataFrame:
    def held(batches):
        for batch in batches:
            yield batch.filter(pa.array(level.holds(_words(batch, "a"), _words(batch, "b"))))

    return staged(keys.select("a", "b").mapInArrow(held, "a long, b long"), name)


def _pairs(keys: DataFrame) -> DataFrame:
    a, b = hashed(F.col("key"))
    return keys.select(a.alias("a"), b.alias("b"))


def build(universe: DataFrame, listed: DataFrame, max_bits: int = 2**28, later_bits: float = 4.0) -> Cascade | None:
    """The cascade of a universe of distinct keys and a list of distinct keys (key each); None if it would be too large."""
    listed = staged(_pairs(listed), "cascade-listed")
    n, every = listed.count(), universe.count()
    if not n:
        return Cascade(())
    level = _level(listed, 0, n, min(30.0, max(8.0, 1.44 * math.log2(max(2.0, every / n)))), max_bits)
    if level is None:
        return None
    passed = _passing(_pairs(universe), level, "cascade-0")
    # What passes level 0 is told apart once, by the list; listed keys that no page has need no level.
    inside, outside, levels = staged(passed.join(listed, ["a", "b"], "left_semi"), "cascade-in"), staged(passed.join(listed, ["a", "b"], "left_anti"), "cascade-out"), [level]
    while n := outside.count():
        level = _level(outside, len(levels), n, later_bits, max_bits)
        if level is None:
            return None
        levels.append(level)
        inside, outside = outside, _passing(inside, level, f"cascade-{len(levels)}")
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, cut, 1), UPPER, LOWER), F.regexp_extract(url, cut, 2)


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Possible rules of a page, longest first; shapes: numbers of labels and of path characters that rules have."""
    parts = F.split(host, "\\.")
    each = [F.when((F.size(parts) >= n) & (host != "") & (F.length(path) >= m), F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, m))) for n, m in shapes]
    found = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
    by_length = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.transform(by_length, lambda s: s["x"])


def _judge(cascades: dict[str, Cascade]):
    def flat(batch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch[name]
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        items = lists.flatten()
        a, b = (items.field(x).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in ("a", "b"))
        return ends, a, b

    def run(batches):
        for batch in batches:
            ends, a, b = flat(batch, "keys")
            block, allow = cascades["block"].holds(a, b), cascades["allow"].holds(a, b)
            h_ends, ha, hb = flat(batch, "labels")
            bad = cascades["labels"].holds(ha, hb)
            place, verdict = [], []
            for i in range(batch.num_rows):
                hit = np.flatnonzero(block[ends[i] : ends[i + 1]] | allow[ends[i] : ends[i + 1]])
                if len(hit):
                    place.append(int(hit[0]))
                    verdict.append("block" if block[ends[i] + hit[0]] else "allow")
                else:
                    place.append(None)
                    verdict.append("block" if bad[h_ends[i] : h_ends[i + 1]].any() else "allow")
            rest = [batch[c] for c in ("page_id", "host", "path", "candidates")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(place, pa.int32()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "candidates", "place", "verdict"])

    return run


def _found(keys: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """(key) of the keys (key) that are listed: the exact way for a list that is too large for a cascade."""
    return staged(keys.join(listed, "key", "left_semi").distinct(), name)


def judge(pages: DataFrame, rules: DataFrame, listed_labels: DataFrame, max_bits: int = 2**28) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. rules: host, path, verdict (allow or block); listed_labels: label."""
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.concat("host", "path").alias("r_key"), F.col("verdict").alias("r_verdict"))
    shapes = sorted((r.n, r.m) for r in rules.select(F.size(F.split("r_host", "\\.")).alias("n"), F.length("r_path").alias("m")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    cut = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    labels = F.array_distinct(F.filter(F.split("host", "\\."), lambda x: x != ""))
    cut = staged(cut.withColumns({"candidates": _candidates(F.col("host"), F.col("path"), shapes), "labels": labels}), "url-cut")
    seen = staged(cut.select(F.explode("candidates").alias("key")).distinct(), "url-keys")
    words = staged(cut.select(F.explode("labels").alias("key")).distinct(), "url-labels")
    lists = {v: (seen, rules.where(F.col("r_verdict") == v).select(F.col("r_key").alias("key")).distinct()) for v in ("allow", "block")}
    lists["labels"] = (words, listed_labels.select(F.col("label").alias("key")).distinct())
    cascades = {name: build(universe, listed, max_bits) for name, (universe, listed) in lists.items()}
    if None in cascades.values():
        return _judged_by_joins(cut, {name: _found(universe, listed, f"url-{name}") for name, (universe, listed) in lists.items()})
    pair = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))
    ready = cut.select("page_id", "host", "path", "candidates", F.transform("candidates", pair).alias("keys"), F.transform("labels", pair).alias("labels"))
    kind = dict(pages.dtypes)["page_id"]
    out = ready.mapInArrow(_judge(cascades), f"page_id {kind}, host string, path string, candidates array<string>, place int, verdict string")
    return out.select("page_id", "host", "path", F.get("candidates", F.col("place")).alias("rule"), "verdict")


def _judged_by_joins(cut: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """The verdicts of pages by joins of their keys with the keys found on each list."""
    rows = staged(cut.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    both = found["allow"].withColumn("verdict", F.lit("allow")).unionByName(found["block"].withColumn("verdict", F.lit("block")))
    rule = rows.select("row", F.posexplode("candidates").alias("at", "key")).join(both, "key")
    # Candidates stand longest first; a rule that is on both lists blocks.
    rule = rule.groupBy("row").agg(F.min(F.struct("at", F.when(F.col("verdict") == "block", 0).otherwise(1).alias("order"), "key", "verdict")).alias("r"))
    bad = rows.select("row", F.explode("labels").alias("key")).join(found["labels"], "key", "left_semi").select("row").distinct().withColumn("bad", F.lit(True))
    out = rows.join(rule, "row", "left").join(bad, "row", "left")
    return out.select("page_id", "host", "path", F.col("r.key").alias("rule"), F.coalesce("r.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
