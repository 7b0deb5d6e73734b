"""Quality rules: statistics of whole texts, fixed base rules, and robust multivariate outliers.

A minimum-covariance-determinant estimate is made for each language and source from transformed statistics. Every group
is started from its coordinate medians and from `STARTS` random subsets (by hash) of a dozen rows. Concentration steps
keep the half of a group's documents nearest to the present centre and estimate mean and covariance from them again; after
`FIRST_STEPS` the start whose half has the least determinant goes on, until no group's determinant falls any more. The
estimate is made consistent by its median distance, and reweighted: mean and covariance of the rows within the 0.975 point
of the chi-square distribution, scaled by the median distance anew. Groups under `MIN_GROUP` documents use the estimate of
their language, languages under it that of all documents, and a corpus under it has none. A document is rejected where its
squared Mahalanobis distance exceeds `cutoff`. All of it is DataFrame functions: moments are partial sums, halves are cut
at percentile sketches (relative rank error under 1 / `RANKS`), and the 5 x 5 inversion is a Cholesky factor written out as
columns.

Edge cases: a null or empty text has zero statistics and fails the base rules; null language and null source are
groups of their own; constant statistics are held by the variance floors `FLOORS`; repeated rows are rows; very long texts
are counted whole; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, attach, staged

SYMBOLS = "#*$%&|<>"
DIMS = ("log_words", "word_len", "symbols", "dup_lines", "repeats")
#: Least standard deviations of the transformed statistics: what is closer than this is never told apart.
FLOORS = (1.0, 0.5, 0.05, 0.25, 0.25)
MIN_GROUP = 40
STARTS, SUBSET = 2, 12
#: Concentration steps of every start, and at most of the best one.
FIRST_STEPS, STEPS = 2, 20
RANKS = 2000
#: Median, 0.975 and 0.99999 points of the chi-square distribution with five degrees of freedom (fixed values).
CHI_MEDIAN, CHI_NEAR, CHI_FAR = 4.351460191095526, 12.832501994030027, 30.856189940472984


def _window_hashes(words: Column, k: int) -> Column:
    """A hash of every k words in a row: each word is hashed once, then neighbours are folded together k - 1 times."""
    n = F.size(words)
    out = hashes = F.transform(words, lambda w: F.xxhash64(w))
    for j in range(1, k):
        out = F.zip_with(F.slice(out, 1, F.greatest(n - j, F.lit(0))), F.slice(hashes, j + 1, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= k, out).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, k: int) -> Column:
    """Positions inside windows whose hash occurs again: sort (hash, place), keep equal neighbours, add up the places' reach."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Every element carries its neighbours, so that the filter needs no access by position to the sorted array.
    n = F.size(ranked)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(ranked, 1, F.greatest(n - 1, F.lit(0))))
    after = F.slice(ranked, 2, n)
    trio = F.arrays_zip(ranked.alias("a"), before.alias("b"), after.alias("c"))
    again = F.filter(trio, lambda t: t["a"]["h"].eqNullSafe(t["b"]["h"]) | t["a"]["h"].eqNullSafe(t["c"]["h"]))
    places = F.array_sort(F.transform(again, lambda t: t["a"]["i"]))
    init = F.struct(F.lit(0).alias("n"), F.lit(-(2**30)).alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(k), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, init, step, lambda s: s["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), taken from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.withColumns({
        "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "__lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    second = first.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hashes": _window_hashes(F.col("__words"), 5),
    })
    plain = F.size(F.array_distinct("__hashes")) == F.size("__hashes")
    return second.withColumn("n_repeat_words", F.when(plain, F.lit(0)).otherwise(_covered(F.col("__hashes"), 5)).cast("long")).drop("__words", "__lines", "__hashes")


def vectors() -> list[Column]:
    """The transformed statistics, in the order of DIMS; the word length is drawn to 5 by 20 words, as short texts vary."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        (F.col("word_chars") + 100) / (n + 20),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        F.log1p(F.col("n_dup_lines")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _residuals(prefix: str) -> list[Column]:
    """z0..z4: x0..x4 less the means, with the Cholesky factor taken out (columns of the row's group)."""
    p, z = len(DIMS), []
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"{prefix}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}l{i}{j}") * F.col(f"z{j}")
        z.append(rest / F.col(f"{prefix}l{i}{i}"))
    return z


def _with_distance(df: DataFrame, prefix: str) -> DataFrame:
    for i, z in enumerate(_residuals(prefix)):
        df = df.withColumn(f"z{i}", z)
    total = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(DIMS))])
    return df.withColumn("d2", total).drop(*[f"z{i}" for i in range(len(DIMS))])


def _moments(df: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """Per key: means, Cholesky factor of the covariance (floored), its log determinant, and the number of rows."""
    p = len(DIMS)
    aggs = [F.avg(f"x{i}").alias(f"{prefix}m{i}") for i in range(p)]
    aggs += [(F.covar_pop(f"x{i}", f"x{j}")).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = df.groupBy(*by).agg(*aggs, F.count("*").alias(f"{prefix}n"))
    for i in range(p):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + F.lit(FLOORS[i] ** 2))
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"{prefix}l{i}{k}") * F.col(f"{prefix}l{j}{k}")
            out = out.withColumn(f"{prefix}l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"{prefix}l{j}{j}"))
    det = reduce(lambda a, b: a + b, [F.log(F.col(f"{prefix}l{i}{i}")) for i in range(p)])
    out = out.withColumn(f"{prefix}det", 2 * det)
    return out.select(*[F.col(c).alias(f"{prefix}{c.strip('_')}") for c in by], *[c for c in out.columns if c.startswith(prefix)])


def prepared(stats: DataFrame) -> DataFrame:
    """Adds base_failed, x0..x4 and the keys __own (language and source), __lang and __spread."""
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = stats.withColumns({f"x{i}": x for i, x in enumerate(vectors())} | {"base_failed": base, "__spread": F.xxhash64("doc_id", "n_words", "word_chars")})
    # Keys as text that keeps null apart from any string.
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in ("lang", "source"))
    return out.withColumns({"__own": F.to_json(F.struct(lang.alias("l"), source.alias("s"))), "__lang": F.to_json(F.struct(lang.alias("l")))})


def _scale(half: Column) -> Column:
    """A group's median distance is made that of a Gaussian, where it is larger."""
    return F.greatest(half / CHI_MEDIAN, F.lit(1.0))


def _halved(df: DataFrame, now: DataFrame, keys: dict[str, str], name: str) -> tuple[DataFrame, DataFrame]:
    """df with d2 by the estimates now, and (staged) now with h_half, the median of d2."""
    far = _with_distance(attach(df, now, keys, ["__spread"]), "g_").select(*keys, "__spread", "d2", *[f"x{i}" for i in range(len(DIMS))])
    half = far.groupBy(*keys).agg(F.percentile_approx("d2", 0.5, RANKS).alias("h_half")).withColumnsRenamed({a: f"h_{a}" for a in keys})
    joined = now.join(half, reduce(lambda a, b: a & b, [now[g] == half[f"h_{k}"] for k, g in keys.items()])).drop(*[f"h_{k}" for k in keys])
    return far, staged(joined, name)


def _step(df: DataFrame, now: DataFrame, keys: dict[str, str], name: str, reach: Column | None = None) -> DataFrame:
    """One concentration step: the moments of each key's nearer half (or of what is within reach, in terms of h_half)."""
    far, half = _halved(df, now, keys, f"{name}-half")
    bound = half.select(*keys.values(), "h_half")
    near = attach(far, bound, keys, ["__spread"]).where(F.col("d2") <= (F.col("h_half") if reach is None else reach))
    return staged(_moments(near, "g_", list(keys)), name)


def estimates(fit: DataFrame) -> DataFrame:
    """Per __group of fit (x0..x4, __group, __spread; read several times): centre, factor and scale in columns g_*."""
    p, every = len(DIMS), F.sequence(F.lit(0), F.lit(STARTS))
    xs = [f"x{i}" for i in range(p)]
    middle = fit.groupBy("__group").agg(*[F.percentile_approx(x, 0.5, RANKS).alias(f"g_m{i}") for i, x in enumerate(xs)], F.count("*").alias("g_n"))
    sizes = staged(middle, "mcd-middle")
    middle = sizes.select(F.col("__group").alias("g_group"), F.lit(0).alias("g_start"), "g_n", *[f"g_m{i}" for i in range(p)], F.lit(0.0).alias("g_det"), *[F.lit(FLOORS[i] if i == j else 0.0).alias(f"g_l{i}{j}") for i in range(p) for j in range(i + 1)])
    # A start's subset: every m-th row or so by a hash of its own.
    some = attach(fit, sizes.select(F.col("__group").alias("n_group"), F.ceil(F.col("g_n") / SUBSET).alias("n_every")), {"__group": "n_group"}, ["__spread"])
    some = some.withColumn("__start", F.explode(F.sequence(F.lit(1), F.lit(STARTS)))).where(F.pmod(F.xxhash64("__spread", "__start"), F.col("n_every")) == 0)
    names = ["g_group", "g_start", "g_n", "g_det", *[f"g_m{i}" for i in range(p)], *[f"g_l{i}{j}" for i in range(p) for j in range(i + 1)]]
    now = staged(middle.select(*names).unionByName(_moments(some, "g_", ["__group", "__start"]).select(*names)), "mcd-starts")
    wide, keys = fit.withColumn("__start", F.explode(every)), {"__group": "g_group", "__start": "g_start"}
    for step in range(FIRST_STEPS):
        now = _step(wide, now, keys, f"mcd-first-{step}")
    # The least determinant, and of equals the first start.
    best = now.groupBy("g_group").agg(F.min(F.struct("g_det", "g_start", *[c for c in names if c not in ("g_group", "g_det", "g_start")])).alias("b"))
    now, keys = staged(best.select("g_group", "b.*").drop("g_start"), "mcd-best"), {"__group": "g_group"}
    for step in range(STEPS):
        after = _step(fit, now, keys, f"mcd-{step}")
        fall = now.join(after.select(F.col("g_group").alias("a_group"), F.col("g_det").alias("a_det")), F.col("g_group") == F.col("a_group")).agg(F.max(F.col("g_det") - F.col("a_det"))).first()[0]
        now = after
        if fall is None or fall < 1e-3:
            break
    near = _step(fit, now, keys, "mcd-near", reach=_scale(F.col("h_half")) * CHI_NEAR)
    return _halved(fit, near, keys, "mcd-scaled")[1].withColumn("g_scale", _scale(F.col("h_half"))).drop("h_half", "g_det", "g_n")


def fitted(stats: DataFrame) -> DataFrame:
    """Per key __own of stats (prepared; read several times, so staged): the estimate that judges its documents."""
    xs = [f"x{i}" for i in range(len(DIMS))]
    own = stats.groupBy("__own", "__lang").agg(F.count_if(~F.col("base_failed")).alias("k_n")).withColumnsRenamed({"__own": "k_own", "__lang": "k_lang"})
    own = staged(own, "mcd-own")
    # A wider group's estimate is made, from all its documents, only where a narrower one in it is too small for one.
    wide = own.groupBy("k_lang").agg(F.sum("k_n").alias("w_n"), (F.min("k_n") < MIN_GROUP).alias("w_need")).withColumnRenamed("k_lang", "w_lang")
    whole = wide.agg(F.coalesce(F.max((F.col("w_n") < MIN_GROUP) & F.col("w_need")), F.lit(False)).alias("v_need"))
    need = staged(own.join(wide, F.col("k_lang") == F.col("w_lang")).drop("w_lang").join(F.broadcast(whole), F.lit(True)), "mcd-need")  # one row
    fit = attach(stats.where(~F.col("base_failed")).select("__own", "__lang", "__spread", *xs), need, {"__own": "k_own"}, ["__spread"])
    every = F.lit("{}")
    groups = F.array_compact(F.array(F.when(F.col("k_n") >= MIN_GROUP, F.col("__own")), F.when(F.col("w_need") & (F.col("w_n") >= MIN_GROUP), F.col("__lang")), F.when(F.col("v_need"), every)))
    est = estimates(staged(fit.select(F.explode(groups).alias("__group"), "__spread", *xs), "mcd-rows"))
    sizes = need.select("k_own", F.when(F.col("k_n") >= MIN_GROUP, F.col("k_own")).when(F.col("w_n") >= MIN_GROUP, F.col("k_lang")).otherwise(every).alias("k_group"))
    total = own.agg(F.coalesce(F.sum("k_n"), F.lit(0))).first()[0]
    if total < MIN_GROUP:
        est = est.where("false")
    return staged(sizes.join(est, F.col("k_group") == F.col("g_group"), "left").drop("k_group", "g_group"), "mcd-last")


def judged(stats: DataFrame, est: DataFrame, cutoff: float) -> DataFrame:
    """stats (prepared) with d2 (null where no estimate could be made) and kept."""
    far = _with_distance(attach(stats, est, {"__own": "k_own"}, ["__spread"]), "g_").withColumn("d2", F.col("d2") / F.col("g_scale"))
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))


def rules(docs: DataFrame, cutoff: float = CHI_FAR) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed, d2 and kept."""
    stats = staged(prepared(statistics(docs.select("doc_id", "lang", "source", "text"))).drop("text"), "quality-stats")
    return judged(stats, fitted(stats), cutoff).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")


def keep(docs: DataFrame, cutoff: float = CHI_FAR) -> DataFrame:
    """The rows of docs that are kept; every row is staged once beside its statistics, so that none is looked up again."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "source", "text")
    stats = staged(prepared(statistics(rows)).drop("text"), "quality-rows")
    return judged(stats, fitted(stats), cutoff).where("kept").select("row.*")
