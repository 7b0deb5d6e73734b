"""The pipeline, and the verdict of the quality rules, against plain loops over a small fixture."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinrank.llm import packing, pii, quality_rules
from skeinrank.llm.tokens import Encoder, byte_bpe_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Two groups that are large enough for an estimate, outliers in one, junk, copies, near copies, nulls, personal data."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(n))) for n in rng.integers(3, 9, 3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    out = [(i, text(int(rng.integers(40, 120))), "en", "web" if i % 2 else "books") for i in range(120)]
    out += [(200 + i, "# $ % & | < > * " * 12 + text(60), "en", "web") for i in range(3)]
    out += [(210, "too short", "en", "web"), (211, "again and again and " * 30, "en", "books"), (212, None, "en", "web"), (213, "", None, None)]
    out += [(220 + i, out[5][1], "en", "web") for i in range(3)]
    out += [(230, out[7][1] + " tail", "en", "web"), (231, out[8][1].replace(" ", "\n", 1), "en", "books")]
    out += [(240 + i, f"{text(30)}\nWrite to Mr. John Smith at john.smith{i}@mail.example.com or +1 (555) 123-456{i}", "en", "web") for i in range(4)]
    out += [(250 + i, text(50), "de", None) for i in range(3)]
    return [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in out]


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_quality(spark, rows):
    """doc_id -> kept: minimum-covariance-determinant estimates by group, language and corpus, over several starts, reweighted."""
    stats = {d: statistics(t) for d, t, *_ in rows}
    good = {d: n >= 10 and 100 * rep <= 20 * n for d, (n, *_, rep) in stats.items()}
    x = {}
    for d, (n, chars, symbols, dup, rep) in stats.items():
        m = max(n, 1)
        x[d] = np.array([math.log(m), (chars + 100) / (m + 20), math.sqrt(symbols / max(chars, 1)), math.log1p(dup), math.sqrt(rep / m)])
    drawn = spark.createDataFrame([(d, s[0], s[1]) for d, s in stats.items()], "d long, n long, c long").select("d", F.xxhash64("d", "n", "c").alias("h"))
    draws = {(r.d, r.s): r.x for r in drawn.select("d", F.explode(F.array(F.lit(1), F.lit(2))).alias("s"), "h").select("d", "s", F.xxhash64("h", "s").alias("x")).collect()}
    middle = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]

    def distance(points, est):
        z = np.linalg.solve(est[1], (points - est[0]).T)
        return (z * z).sum(axis=0)

    def moments(points):
        factor = np.linalg.cholesky(np.cov(points.T, bias=True) + np.diag(np.square(quality_rules.FLOORS)))
        return points.mean(axis=0), factor, 2 * np.log(np.diag(factor)).sum()

    def step(points, est):
        d2 = distance(points, est)
        return moments(points[d2 <= middle(d2)])

    scale = lambda points, est: max(middle(distance(points, est)) / quality_rules.CHI_MEDIAN, 1.0)
    own, wide, every = defaultdict(list), defaultdict(list), []
    for d, _, lang, source, _ in rows:
        if good[d]:
            for group in (own[lang, source], wide[lang], every):
                group.append(d)
    enough = lambda g: len(g) >= quality_rules.MIN_GROUP
    chosen = {}
    for d, _, lang, source, _ in rows:
        keys = [k for k, g in ((("own", lang, source), own[lang, source]), (("lang", lang), wide[lang]), (("all",), every)) if enough(g)]
        chosen[d] = keys[0] if keys else None
    members = {k: {"own": lambda k=k: own[k[1:]], "lang": lambda k=k: wide[k[1]], "all": lambda: every}[k[0]]() for k in set(chosen.values()) if k}
    now = {}
    for k, ids in members.items():
        points = np.array([x[d] for d in ids])
        starts = [(np.array([middle(c) for c in points.T]), np.diag(quality_rules.FLOORS))]
        starts += [moments(np.array([x[d] for d in ids if draws[d, s] % math.ceil(len(ids) / 12) == 0])) for s in (1, 2)]
        for _ in range(quality_rules.FIRST_STEPS):
            starts = [step(points, e) for e in starts]
        now[k] = points, min(starts, key=lambda e: e[2])
    for _ in range(quality_rules.STEPS):
        after = {k: (points, step(points, est)) for k, (points, est) in now.items()}
        fall = max(now[k][1][2] - after[k][1][2] for k in now)
        now = after
        if fall < 1e-3:
            break
    final = {}
    for k, (points, est) in now.items():
        near = moments(points[distance(points, est) <= scale(points, est) * quality_rules.CHI_NEAR])
        final[k] = near, scale(points, near)
    return {d: good[d] and (chosen[d] is None or bool(distance(x[d][None], final[chosen[d]][0])[0] / final[chosen[d]][1] <= quality_rules.CHI_FAR)) for d in stats}


def brute_near(rows):
    """The rows of least doc_id in their group: five-word shingles, similarity 0.8."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, label = {}, {}
    for d, text, *_ in rows:
        w = WORD.findall((text or "").translate(fold))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        label[d] = d
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    return [r for r in rows if label[r[0]] == r[0]]


def unit(*parts):
    return int(hashlib.md5("|".join("~" if p is None else str(p) for p in parts).encode()).hexdigest()[:12], 16) / 2**48


def brute_mix(rows):
    """Rows repeated by their source's target: weights 3, 1, 2, 150 % of all words, at most twice a source's own."""
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        free = [s for s in sources if s not in full]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level >= 2 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for s in sources:
        rate = (2 * total[s] if s in full else weight[s] * level) / total[s] if total[s] else 0.0
        mine, f = [r for r in rows if r[3] == s], rate - math.floor(rate)
        text = {id(r): hashlib.md5((r[1] or "").encode()).hexdigest() for r in mine}
        taken = {seed: [r for r in mine if unit(seed, r[0], s, text[id(r)]) < f] for seed in range(17, 33)}
        best = min(taken, key=lambda seed: (abs(sum(size[r[0]] for r in taken[seed]) - f * total[s]), seed))
        out += mine * math.floor(rate) + taken[best]
    return out


def test_verdict(spark, rows):
    got = {r.doc_id: r.kept for r in quality_rules.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_quality(spark, rows)
    assert got == want
    assert not any(want[d] for d in (200, 201, 202, 210, 211, 212, 213)) and all(want[d] for d in range(120))


def test_pipeline(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_quality(spark, rows)
    left = brute_near([r for r in rows if kept[r[0]]])
    assert not {220, 221, 222, 230} & {r[0] for r in left}
    clean = [(d, pii.rewrite(t, b"for tests only", {})[0], lang, source, n) for d, t, lang, source, n in left]
    assert all("Smith" not in t and "@mail.example.com" not in t for _, t, *_ in clean)
    enc, want = Encoder(byte_bpe_path()), Counter()
    for d, t, *_ in brute_mix(clean):
        ids = enc._whole(t) + b"\0\0\0\0"
        for at in range(0, len(ids), 4096):
            piece = ids[at : at + 4096]
            want[d, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) == len({b for b, _ in packing.first_fit_decreasing([k[2] for k, n in want.items() for _ in range(n)], 1024)})


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
