"""Runs of periodically repeated words in whole texts, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and of at least
max(`least`, 2 q) words that no neighbouring word extends keeping period q. Periods below `shortest` are found by
comparing the words directly with those q places on. Each longer period belongs to the scale S with S <= q < 2 S. A scale looks at grams
of S / 4 words and, in every window of S / 2 of them, at those with the least hash. Windows q apart inside a run are identical,
and one whole window and its copy always fit into it: so the run holds two equal grams, both least in a window, at distance q.
Pairs of equal minimizers at a distance of the scale are the seeds, each extended to both sides as far as the period holds.

Equal minimizers that overlap by half or more stand in a stretch of a shorter period; they form a chain. Pairs within a chain
can only seed that shorter period, which a lower scale finds, and of two chains every distance occurs in a pair that holds
an anchor: a chain's first member, or one whose gap isn't the usual one. So only pairs with an anchor and of different chains
are extended, whose number grows with the length of a text, not with its square. Seeds are extended by comparing
prefix hashes of 62 bits; periods that are multiples of a shorter one end in the same stretch and go.

Texts are taken together, up to `words` words at a time, and are kept apart by marks that equal nothing: memory is bounded by
that or by the longest text.

Edge cases: a null or empty text, or one of white space, has no words and no runs, and its collapsed text is empty; texts of any
length are taken whole; repeated rows, and rows that share an id or have none, each give their own row; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .near_dup import mix

_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_245, 1_812_433_253)


def _slide(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of every `width` neighbours of x; width is a power of two."""
    step = 1
    while step < width:
        x = of(x[:-step], x[step:])
        step *= 2
    return x


class _Prefixes:
    """Prefix hashes of a sequence: tells whether stretches are equal, and how far two places agree."""

    def __init__(self, seq: np.ndarray):
        self.n, self.sums, self.powers = len(seq), [], []
        value = mix(seq.astype(np.uint64))
        for i, (p, b) in enumerate(zip(_PRIMES, _BASES, strict=True)):
            power, step = np.ones(1, np.int64), b
            while len(power) <= self.n:
                power, step = np.concatenate([power, power * step % p]), step * step % p
            power = power[: self.n + 1]
            term = ((value >> np.uint64(31 * i)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % p * power[:-1] % p
            self.sums.append(np.concatenate([[0], np.cumsum(term)]) % p)
            self.powers.append(power)

    def same(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words at a and at a + q are equal."""
        hit = np.ones(len(a), bool)
        for p, s, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            hit &= (s[a + size] - s[a]) % p * power[q] % p == (s[a + q + size] - s[a + q]) % p
        return hit

    def extend(self, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from x on, and how many before x, equal those q places on."""
        right, left = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = 1 << max(self.n, 1).bit_length()
        while step:
            fits = np.flatnonzero(x + q + right + step <= self.n)
            ok = fits[self.same(x[fits] + right[fits], q[fits], np.full(len(fits), step))]
            right[ok] += step
            fits = np.flatnonzero(x - left - step >= 0)
            ok = fits[self.same(x[fits] - left[fits] - step, q[fits], np.full(len(fits), step))]
            left[ok] += step
            step >>= 1
        return right, left


def _lag_runs(seq: np.ndarray, q: int, least: int) -> np.ndarray:
    """(start, end, q) of the stretches of period q, by comparing each word with that q places on."""
    at = np.flatnonzero(seq[:-q] == seq[q:])
    if not len(at):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1 + q
    ok = last - first >= max(least, 2 * q)
    return np.stack([first[ok], last[ok], np.full(ok.sum(), q)], axis=1)


def _seeds(h: np.ndarray, gram: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the pairs of equal minimizers to extend; h: hashes of all grams of `gram` words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = scale // 2
    if len(h) < window:
        return none
    low, edge = _slide(h, window, np.minimum), np.zeros(window - 1, np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), window, np.maximum) == h)
    order = np.argsort(h[place], kind="stable")
    place, name = place[order], h[place][order]
    same = name[1:] == name[:-1]
    several = np.append(same, False) | np.insert(same, 0, False)
    place, name = place[several], name[several]
    if not len(place):
        return none
    new = np.insert(name[1:] != name[:-1], 0, True)
    group, gap = np.cumsum(new) - 1, np.insert(np.diff(place), 0, 0)
    first = new | (gap > gram // 2)
    chain = np.cumsum(first)
    usual = np.full(group[-1] + 1, len(h))
    np.minimum.at(usual, group[~first], gap[~first])
    anchor = np.flatnonzero(first | (gap != usual[group]))
    key = group * (len(h) + 4 * scale) + place
    found = []
    for low_at, high_at in ((key[anchor] + scale, key[anchor] + 2 * scale), (key[anchor] - 2 * scale + 1, key[anchor] - scale + 1)):
        lo, hi = np.searchsorted(key, low_at), np.searchsorted(key, high_at)
        n = hi - lo
        mine, other = np.repeat(anchor, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        apart = chain[mine] != chain[other]
        a, b = place[mine[apart]], place[other[apart]]
        found.append(np.stack([np.minimum(a, b), np.abs(a - b)]))
    x, q = np.unique(np.concatenate(found, axis=1), axis=1)
    return x, q


def runs_of(seq: np.ndarray, starts: np.ndarray, least: int = 12, shortest: int = 32) -> np.ndarray:
    """(start, end, period) of all runs of seq, by start and then period.

    seq holds texts one behind the other, by rising length, as numbers of words, with a number that occurs nowhere else behind each;
    starts: where they start. shortest, a power of two from 4 on: the first period that is left to minimizers.
    """
    sizes = np.diff(np.append(starts, len(seq))) - 1
    longest = int(sizes.max(initial=0))
    found = [_lag_runs(seq, q, least) for q in range(1, min(shortest, longest // 2 + 1))]
    h, gram, scale, at = mix(seq.astype(np.uint64)), 1, shortest, 0
    prefixes = None
    while scale <= longest // 2:
        while gram < scale // 4:
            h, gram = mix(h[:-gram] * np.uint64(0xD6E8FEB86659FD93) + h[gram:]), 2 * gram
        # Shorter texts have no such period.
        skip = int(starts[np.searchsorted(sizes, 2 * scale)])
        h, at = h[skip - at :], skip
        x, q = _seeds(h, gram, scale)
        if len(x):
            prefixes = prefixes or _Prefixes(seq)
            right, left = prefixes.extend(x + at, q)
            s, e = x + at - left, x + at + q + right
            ok = e - s >= np.maximum(least, 2 * q)
            found.append(np.stack([s[ok], e[ok], q[ok]], axis=1))
        scale *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A multiple of a period ends in the same stretch.
    own = np.ones(len(rows), bool)
    own[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[own]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(ids: list, texts: list[list[bytes]], least: int, shortest: int) -> pa.RecordBatch:
    """The rows of some texts, given as words."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    seq = np.empty(int((sizes + 1).sum()), np.int64)
    marks = np.zeros(len(seq), bool)
    marks[starts + sizes] = True
    seq[~marks] = codes.indices.to_numpy()
    seq[marks] = len(codes.dictionary) + np.arange(len(texts))
    rows = runs_of(seq, starts, least, shortest)
    doc = np.searchsorted(starts, rows[:, 0], "right") - 1
    # A word goes if a run holds it behind its first period.
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 1], -1)
    stays = np.cumsum(cover) == 0
    changed = set(doc.tolist())
    collapsed = [b" ".join(compress(t, stays[starts[i] : starts[i] + len(t)].tolist()) if i in changed else t) for i, t in enumerate(texts)]
    parts = [pa.array(x, pa.int64()) for x in (rows[:, 0] - starts[doc], rows[:, 1] - rows[:, 0], rows[:, 2])]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, least: int = 12, shortest: int = 32, words: int = 250_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs (start, length, period; by start, then period), and the
    collapsed text: the words that no run holds behind its first period, joined by single blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            held = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                own = (text.as_py() or b"").split()  # of bytes: at the six white-space characters
                if ids and held + len(own) > words:
                    yield _found(ids, texts, least, shortest)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(own)
                held += len(own)
            if ids:
                yield _found(ids, texts, least, shortest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """docs with the rest of a text's words, from a word on, made periodic in one document of ten, chosen by the id's checksum.

    With h the checksum, g = h div 10 and n words: words i >= a become word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Null ids and texts without words stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size("__words").cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    rest = F.flatten(F.array_repeat(F.slice("__words", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice("__words", 1, a.cast("int")), F.slice(rest, 1, (n - a).cast("int"))), " ")
    one_of_ten = F.col("doc_id").isNotNull() & (h % 10 == 0)
    marked = docs.select("doc_id", "text", F.when(one_of_ten, words).alias("__words"))
    return marked.select("doc_id", F.when(F.size("__words") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document of `find`: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return out.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
