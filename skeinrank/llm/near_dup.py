"""Near-duplicate documents by banded MinHash, with odd sketches to estimate candidates and full sets to confirm them.

A document's set holds its distinct shingles of `shingle` words (A-Z lower-cased); with fewer words, the whole sequence
is the one shingle. Documents with equal sets form a class and only classes are compared, each by the text of its least
row; of a component's rows the least is kept, by doc_id and then by a hash of the text. The classes' MinHash samples
are cut into bands; classes that agree on a band share a bucket. The samples are also folded into an odd sketch: a
bitmap of parities, so that the ones in the XOR of two sketches tell the number of samples in which they differ, most
precisely for high similarities. Candidates whose estimate is far too low are dropped, and the rest are confirmed on
the full sets.

Buckets may be of any size, so their pairs are not written out. First the least member of each bucket of a few bands is compared with
the others, and components of the confirmed links are found; then, in all bands, with one member of each other component in its
bucket, and components are found again. Only members of buckets that still hold several components can have further links. They get an exact index in place of the bands: in an order of shingles by rising (sketched)
frequency, two sets that are similar enough must share one of their first n - ceil(t n) + 1, and enough must follow it. What sets a document apart
from its group stands first there, so that documents far from all others of a large group of near copies meet hardly
any. In each round a bucket of this index compares a few hubs, members of its smallest components so far, with its
members of other components; a hub has then met the whole bucket and leaves it. Buckets of up to `small` members compare
what is open at once. A pair is written out only if the parity bitmaps of the two full sets allow it: the ones in their XOR are never more
than the elements that only one of the sets holds, so that no link is lost, and few pairs are written that aren't links. A bucket is done when its remaining members are in one component: what it has not compared could
only link what is linked already. So no link between components is lost but by the bands themselves, whose number makes
that less likely than `miss` for a pair at the threshold.

Edge cases: a null or empty text has an empty set, is linked with nothing and kept; a null doc_id sorts after all
others and comes out as null; rows that share a doc_id, or have none, are judged each by its own text, and go only as near
copies of a row that is kept; of equal rows one is kept; an empty table gives no rows; texts of any length are shingled whole;
other columns, whatever their names, are ignored by `groups` and kept by `keep`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import among, attach, drop, fan, heavy, meet, staged, without

NO_ID = 2**63 - 1
#: Pairs of a node from which on they are dealt by their other node, and edges of a graph up to which one task takes a round without shuffling.
HOT_PAIRS, SMALL_GRAPH = 65_536, 100_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class NearDup:
    """shingle words make a shingle; pairs at percent or more of the union are linked; rows samples make a band."""

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-8
    sketch_bits: int = 512
    parity_bits: int = 2048
    first_bands: int = 4
    small: int = 24
    hubs: int = 8

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def samples(self) -> int:
        return max(128, self.rows * self.bands)

    @property
    def least_estimate(self) -> float:
        """Six standard deviations of the sample below the threshold."""
        t = self.percent / 100
        return t - 6 * math.sqrt(t * (1 - t) / self.samples) - 0.02


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x + _MIX[0]) * np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mix(acc ^ h[j : j + n])
    return np.unique(acc)


def min_samples(s: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        best = np.minimum(best, (s[at : at + 2048, None] * factors + offsets).min(axis=0))
    return best


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the samples, each with its index, dealt over bits; as signed 64-bit words."""
    place = mix(samples ^ mix(np.arange(len(samples), dtype=np.uint64))) % np.uint64(bits)
    parity = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


SIGNED = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _signer(p: NearDup):
    def sign(batches):
        rng = np.random.Generator(np.random.PCG64(20240229))
        factors = rng.integers(0, 2**64, p.samples, np.uint64) | np.uint64(1)
        offsets = rng.integers(0, 2**64, p.samples, np.uint64)
        band_no = mix(np.arange(p.bands, dtype=np.uint64))
        for batch in batches:
            rows: list[dict] = []
            for doc, text_hash, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"], strict=True):
                s = shingles(text.as_py(), p.shingle)
                row = {"doc_id": doc, "text_hash": text_hash, "n_shingles": len(s), "fp1": 0, "fp2": 0, "bands": [], "sketch": []}
                if len(s):
                    m = min_samples(s, factors, offsets)
                    key = band_no.copy()
                    for j in range(p.rows):
                        key = mix(key ^ m[j * p.bands : (j + 1) * p.bands])
                    row |= {"fp1": int(mix(s).sum(dtype=np.uint64).astype(np.int64)), "fp2": int(mix(s ^ _MIX[1]).sum(dtype=np.uint64).astype(np.int64))}
                    row |= {"bands": key.astype(np.int64).tolist(), "sketch": odd_sketch(m, p.sketch_bits).tolist()}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return sign


def _shingler(k: int):
    def split(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), k).astype(np.int64) for t in batch["text"]]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["node"], pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "set"])

    return split


def _folder(bits: int):
    """The parity bitmap of each set: place i tells whether an odd number of its shingles falls there."""

    def fold(batches):
        for batch in batches:
            rows = []
            for one in batch["set"]:
                parity = np.bincount(_slots(one.values, bits).astype(np.int64), minlength=bits) & 1
                rows.append(np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8"))
            ends = np.arange(0, len(rows) * (bits // 64) + 1, bits // 64, dtype=np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["node"], pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "parity"])

    return fold


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component of each node of edges (a, b).

    Large and small stars in turn until the edges stop changing; every round is a pair of aggregations and joins, and
    only a count and a checksum reach the driver. A graph of at most SMALL_GRAPH edges (counted) stays in one partition, so that its rounds need
    no exchange.
    """
    now, before = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc"), None
    edges_left = now.count()
    while True:
        if edges_left <= SMALL_GRAPH:
            now = now.coalesce(1)
        both = F.array(F.struct(F.col("b").alias("u"), F.col("a").alias("v")), F.struct(F.col("a").alias("u"), F.col("b").alias("v")))
        sym = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # Small star: every node's smaller neighbours are tied to the smallest of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = staged(small, "cc")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or state[0] == 0:
            break
        before, edges_left = state, state[0]
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label), staged, with the components that links (a, b) join put together; only links between components are followed."""
    at = lambda end: labels.select(F.col("node").alias(f"__{end}"), F.col("label").alias(f"l{end}"))
    named = attach(attach(links, at("a"), {"a": "__a"}, ["b"]), at("b"), {"b": "__b"}, ["a"])
    between = named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    top = staged(components(between).select(F.col("node").alias("of"), F.col("label").alias("to")), "merges")
    every = labels.union(top.select(F.col("of").alias("node"), F.col("of").alias("label"))).distinct()
    # A node that was in no component has become one; what was a component's label is a node of it.
    return staged(attach(every, top, {"label": "of"}, ["node"]).select("node", F.coalesce("to", "label").alias("label")), "labels")


def _differing(a: Column, b: Column) -> Column:
    """The number of places in which two bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _estimate(p: NearDup, a: Column, b: Column) -> Column:
    """The similarity that two odd sketches tell."""
    ones = _differing(a, b)
    free = F.greatest(1 - 2 * ones / F.lit(float(p.sketch_bits)), F.lit(1e-9))
    return 1 + F.log(free) * p.sketch_bits / (4.0 * p.samples)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, p: NearDup, name: str) -> DataFrame:
    """(node, set) of nodes (node), by the text of the least row of each class."""
    rows = staged(classes.join(nodes, "node", "left_semi").select("node", "least.doc_id", "least.text_hash"), f"{name}-rows")
    key = ["doc_id", "text_hash"]
    found = staged(among(docs, rows.select(*key), key).join(rows, key).select("node", "text").mapInArrow(_shingler(p.shingle), "node long, set array<long>"), name)
    # Equal rows give a set each.
    once = found if found.count() == rows.count() else staged(found.dropDuplicates(["node"]), name)
    drop(rows)
    return once


def _beside(pairs: DataFrame, dim: DataFrame, at: str, other: str, counted: DataFrame) -> DataFrame:
    """pairs with the columns of dim (node, ...) for the node at `at`: nodes of very many pairs are dealt by the `other` one.

    counted: the staged table with the same pairs, which is cheap to count.
    """
    total, own = counted.count(), dim.withColumnRenamed("node", at)
    most = heavy(total, HOT_PAIRS)
    if total <= most:  # no node can have more
        return pairs.join(own, at)
    sizes = staged(counted.groupBy(at).agg(F.count("*").alias("__pairs")), "pair-sizes")
    hot = sizes.where(F.col("__pairs") > most)
    if hot.isEmpty():
        return pairs.join(own, at)
    tagged = pairs.join(F.broadcast(hot), at, "left").withColumn("__pairs", F.coalesce("__pairs", F.lit(0)))  # at most total / most nodes
    return fan(tagged, own.join(F.broadcast(hot), at, "left").withColumn("__pairs", F.coalesce("__pairs", F.lit(0))), at, "__pairs", most, other)


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, p: NearDup) -> DataFrame:
    """Those of pairs (a, b), a staged table, that the sketches don't rule out and whose full sets are similar enough."""
    sk = classes.select("node", "sketch")
    near = _beside(_beside(pairs, sk.withColumnRenamed("sketch", "sa"), "a", "b", pairs), sk.withColumnRenamed("sketch", "sb"), "b", "a", pairs)
    near = staged(near.where(_estimate(p, F.col("sa"), F.col("sb")) >= p.least_estimate).select("a", "b"), "near")
    ids = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "node")
    sets = _sets(docs, classes, ids, p, "sets")
    both = _beside(_beside(near, sets.withColumnRenamed("set", "s"), "a", "b", near), sets.withColumnRenamed("set", "t"), "b", "a", near)
    both = both.withColumn("inter", F.size(F.array_intersect("s", "t")))
    linked = staged(both.where(F.col("inter") * 100 >= (F.size("s") + F.size("t") - F.col("inter")) * p.percent).select("a", "b").distinct(), "links")
    drop(near, sets)
    return linked


def _counter(slots: int):
    def count(batches):
        for batch in batches:
            at, n = np.unique(_slots(batch["set"].flatten(), slots), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return count


def _slots(hashes: pa.Array, slots: int) -> np.ndarray:
    return mix(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(slots)


def _prefixer(frequency: np.ndarray, percent: int):
    def cut(batches):
        for batch in batches:
            nodes, keys, sizes, places = [], [], [], []
            for node, one in zip(batch["node"].to_pylist(), batch["set"], strict=True):
                s = one.values.to_numpy(zero_copy_only=False).astype(np.int64)
                first = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, frequency[_slots(one.values, len(frequency)).astype(np.int64)]))[:first]
                keys.append(s[order])
                nodes.append(np.full(len(order), node))
                sizes.append(np.full(len(order), len(s)))
                places.append(np.arange(len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, nodes, sizes, places)], names=["key", "node", "size", "pos"])

    return cut


def prefixes(sets: DataFrame, percent: int, slots: int = 2**20) -> DataFrame:
    """(key, node, size, pos) of the first shingles of sets (node, set) by rising frequency; it is counted in `slots` counters."""
    counts = sets.mapInArrow(_counter(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(slots, np.int64)
    frequency[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    found = staged(sets.mapInArrow(_prefixer(frequency, percent), "key long, node long, size long, pos long"), "all-prefixes")
    # A row counts only if what stands from it on could be enough with the smallest set of its bucket.
    low = staged(found.groupBy("key").agg(F.min("size").alias("low"), F.count("*").alias("n")).where("n > 1"), "prefix-keys")
    other = F.greatest(F.col("low"), F.col("size") * percent / 100)
    return meet(found, low, ["key"], found.count()).where((F.col("size") - F.col("pos")) * (100 + percent) >= (F.col("size") + other) * percent - 1e-6).select("key", "node", "size", "pos")


def _undone(member: DataFrame, labels: DataFrame) -> DataFrame:
    """member (key, node, ...) of the buckets that hold several components, with label and n, the bucket's members."""
    tagged = staged(member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "tagged")
    state = tagged.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return meet(tagged, staged(state.select("key", "n"), "undone"), ["key"], tagged.count())


def links(docs: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """(node, label) of the classes that are linked with another; docs: doc_id, text_hash, text; classes: node, least, bands, sketch."""
    every = staged(classes.select(F.posexplode("bands").alias("band", "key"), "node"), "bands")
    buckets = staged(every.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "hubs")
    member = staged(meet(every, buckets, ["key"], every.count()), "buckets")
    drop(every, buckets)
    # A few bands link most of a group of near copies.
    tested = staged(member.where((F.col("band") < p.first_bands) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    labels = staged(components(_confirm(docs, classes, tested, p)), "labels")
    # In all bands one member of each component stands for the others; the hub is the least of its own.
    several = _undone(member.select("key", "node", "hub"), labels)
    pairs = several.groupBy("key", "hub", "label").agg(F.min("node").alias("node")).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    labels, tested = merged(labels, _confirm(docs, classes, pairs, p)), tested.union(pairs)
    # A bucket of two is done by its one pair.
    rest = _undone(member.where("n > 2").select("key", "node"), labels).select("node").distinct()
    sets = _sets(docs, classes, staged(rest, "open"), p, "open-sets")
    open_ = staged(prefixes(sets, p.percent), "prefixes")
    parity = staged(sets.mapInArrow(_folder(p.parity_bits), "node long, parity array<long>"), "parity")
    drop(sets)
    many = p.hubs

    def fits(a: Column, b: Column, at: Column, bt: Column) -> Column:
        """Whether sets of sizes a and b whose first common shingle has the places at and bt can be similar enough."""
        return (F.least(a - at, b - bt) * (100 + p.percent) >= (a + b) * p.percent) & (F.least(a, b) * 100 >= F.greatest(a, b) * p.percent)

    def may(a: Column, b: Column, ap: Column, bp: Column) -> Column:
        """Whether sets of sizes a and b with the parity bitmaps ap and bp can be similar enough: at least so many elements differ."""
        return (a + b - _differing(ap, bp)) * (100 + p.percent) >= 2 * (a + b) * p.percent

    while True:
        left = staged(_undone(open_, labels).select("key", "node", "size", "pos", "label", "n"), "open")
        if left.isEmpty():
            return labels
        left = staged(left.join(parity, "node"), "open")
        x, y = (left.where(F.col("n") <= p.small).alias(c) for c in "xy")
        each = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & fits(F.col("x.size"), F.col("y.size"), F.col("x.pos"), F.col("y.pos")) & may(F.col("x.size"), F.col("y.size"), F.col("x.parity"), F.col("y.parity"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        big = left.where(F.col("n") > p.small).withColumnRenamed("n", "of")
        counts = staged(big.groupBy("key", "label").agg(F.count("*").alias("n")), "counts")
        total = left.count()
        order = Window.partitionBy("key").orderBy("n", "node")
        least = meet(big, counts, ["key", "label"], total).withColumn("i", F.row_number().over(order)).where(F.col("i") <= many)
        hubs = staged(least.select("key", "of", F.col("node").alias("h"), F.col("label").alias("hl"), F.col("size").alias("hs"), F.col("pos").alias("hp"), F.col("parity").alias("hb")), "hubs")
        # A bucket's hubs come to its members as one array, and a member's hubs of all its buckets are made distinct before they are paired.
        several = staged(hubs.groupBy("key", "of").agg(F.collect_list(F.struct("h", "hl", "hs", "hp", "hb")).alias("hubs")), "hub-lists")
        met = fan(big, several, "key", "of", heavy(total), "node")
        open_hubs = F.filter("hubs", lambda x: (x["hl"] != F.col("label")) & fits(F.col("size"), x["hs"], F.col("pos"), x["hp"]) & may(F.col("size"), x["hs"], F.col("parity"), x["hb"]))
        met = met.select("node", F.transform(open_hubs, lambda x: x["h"]).alias("hubs")).where(F.size("hubs") > 0)
        met = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))
        star = met.select("node", F.explode("hubs").alias("h")).select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b"))
        pairs = staged(each.union(star).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        labels, tested = merged(labels, _confirm(docs, classes, pairs, p)), tested.union(pairs)
        open_ = big.join(hubs.select("key", F.col("h").alias("node")), ["key", "node"], "left_anti").select("key", "node", "size", "pos")
        many *= 4


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))


def _verdict(docs: DataFrame, p: NearDup) -> DataFrame:
    """Per row of docs: doc_id (NO_ID for null), text_hash, n_shingles, and the least row of its component (doc_id, text_hash, row).

    Rows without shingles have none; row tells equal rows apart.
    """
    core = _keyed(docs)
    signed = staged(core.mapInArrow(_signer(p), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    key = ["n_shingles", "fp1", "fp2"]
    mine = F.struct("doc_id", "text_hash", "row")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min(mine).alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("n"))
    # A class is a node by the place of its least row, which no other row has.
    classes = staged(classes.withColumn("node", F.col("least.row")), "classes")
    fat, signed = signed, staged(signed.select("doc_id", "text_hash", "row", *key), "rows")
    drop(fat)
    full = signed.where("n_shingles > 0")
    labels = links(core, classes, p)
    firsts = classes.join(labels, "node").groupBy(F.col("label").alias("of")).agg(F.min("least").alias("first"))
    named = classes.join(labels, "node", "left").select(*key, "n", "least", "node", F.coalesce("label", "node").alias("label"))
    named = staged(attach(named, staged(firsts, "firsts"), {"label": "of"}, ["node"]).select(*key, "n", F.coalesce("first", "least").alias("first")), "named")
    names = ["doc_id", "text_hash", "row", "n_shingles", "first"]
    out = meet(full.select("doc_id", "text_hash", "row", *key), named, key, signed.count()).select(*names)
    return out.unionByName(signed.where("n_shingles = 0").select(*names[:-1], F.lit(None).cast(out.schema["first"].dataType).alias("first")))


def groups(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id of its component), kept."""
    out = _verdict(docs, p)
    null = lambda c: F.when(c != NO_ID, c)
    kept = F.col("first").isNull() | (F.col("row") == F.col("first.row"))
    return out.select(null(F.col("doc_id")).alias("doc_id"), "n_shingles", null(F.coalesce("first.doc_id", "doc_id")).alias("component_id"), kept.alias("kept"))


def keep(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The rows of docs that are kept: one of each group, and all rows without shingles."""
    verdict = staged(_verdict(docs, p).where("first is not null").select("doc_id", "text_hash", "row", "first"), "verdict")
    # Rows of one key have the same text and stay or go together, but for the equals of a row that is kept.
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    key = ["doc_id", "text_hash"]
    rows = docs.select(F.struct("*").alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rest = without(rows, staged(verdict.where(~first).select(*key).distinct(), "gone"), key)
    equal = staged(verdict.where(first & (F.col("row") != F.col("first.row"))).select(*key).distinct(), "equal")
    if not equal.isEmpty():
        rest = without(rest, equal, key).unionByName(among(rest, equal, key).dropDuplicates(key))
    return rest.select("whole.*")
