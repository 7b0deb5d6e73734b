import random

import numpy as np

from skeinrank.config import Config
from skeinrank.operators import replay

PUTS = "put_id long, seq long, lang string, text string, v array<double>, answer string, refused boolean"
ASKS = "query_id long, seq long, lang string, text string, v array<double>"


def plain(requests, puts, items, threshold):
    """One after the other, as a cache in memory would."""
    first = lambda lang: (lang or "auto").split("-")[0].split("_")[0].lower().strip()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) + 1e-9)
    exact, held, out = {}, [], []
    for seq, kind, row in sorted([(r[1], 0, r) for r in requests] + [(p[1], 1, p) for p in puts], key=lambda x: x[:2]):
        if kind:
            put, _, lang, text, v, answer, refused = row
            if answer and not refused:
                exact[f"{first(lang)}:{text.strip().lower()}"] = put
                if v is not None:
                    held = [*held, (put, first(lang), unit(v))][-items:]
            continue
        query, _, lang, text, v = row
        keys = [f"{x}:{text.strip().lower()}" for x in (first(lang), *replay.FALLBACK)]
        if found := [exact[k] for k in keys if k in exact]:
            out.append((query, "exact", found[0], None))
        elif held and v is not None:
            score = np.round([unit(v) @ h[2] for h in held], 9)
            best = int(score.argmax())
            if score[best] >= threshold and first(lang) in ("auto", held[best][1]):
                out.append((query, "semantic", held[best][0], float(score[best])))
    return sorted(out)


def test_replay_equals_a_cache_in_memory(spark):
    rng, centres = random.Random(3), np.random.default_rng(3).standard_normal((12, 6))
    vector = lambda: [float(x) for x in centres[rng.randrange(12)] + 0.15 * np.array([rng.gauss(0, 1) for _ in range(6)])]
    lang = lambda: rng.choice(("en", "hi-IN", "ta", None, "EN_us", "auto"))
    puts = [(1000 + i, 2 * rng.randrange(4) + 7 * i, lang(), f"Text {rng.randrange(60)} ", vector() if rng.random() < 0.9 else None, rng.choice(("yes", "yes", "", None)), rng.choice((False, None, True, False))) for i in range(400)]
    requests = [(i, rng.randrange(-5, 2900), lang(), f"text {rng.randrange(400)}", vector() if rng.random() < 0.95 else None) for i in range(500)]
    requests += [(9000 + i, 1500, "auto", "nothing like it", vector()) for i in range(60)]
    config = Config(cache_items=40, cache_threshold=0.97)
    got = replay.replayed(spark.createDataFrame(requests, ASKS), spark.createDataFrame(puts, PUTS), config, block=16)
    want = plain(requests, puts, 40, 0.97)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] == "semantic" for r in want) > 40 and sum(r[1] == "exact" for r in want) > 20
    assert replay.replayed(spark.createDataFrame(requests, ASKS), spark.createDataFrame([], PUTS), config).count() == 0
