"""Personal data over a table whose entities are known: what is left, what is replaced without need, and the time of long texts."""

import random
import re
import time

import pytest

from skeinrank.llm import pii

KEY = b"k"
CLEAN = [
    "Mr President said so.", "Dr. The Rock was a film.", "The smith worked on version 1.2.3.4.5 of chapter 12.", "It rose by 100-2000 units in 1999.", "Call 12 people at 10:30.", "The passport office opened.", "He was born on a Monday.",
    "See pages 555-1234567 there.", "Ratio 3:4, sum = 12, id=abc.", "Anna", "A token of thanks.", "x@y", "a.b.c.d", "Mrs", "12/03/1980 was a day.",
]


def entity(rng):
    """A form with an entity in it, and the parts that must not stay."""
    d = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    first, last = rng.choice(("Anna", "Peter", "Wei", "Maria", "Anna-Maria", "Priya")), rng.choice(("Quibell", "O'Quirk", "van Zwolle", "Smythe-Ubaldi", "Ñuñez", "Zhangwu", "de la Vegara"))
    title = rng.choice(("Mr", "Mrs.", "Dr.", "Herr", "Señora", "Ms"))
    return rng.choice([
        (f"{title} {last} came.", [last.split()[-1]]), (f"{title} {first} {last} came.", [last.split()[-1]]), (f"Then {first} {last} left.", [last.split()[-1]]), (f"{title} {last} and {last.upper()} again.", [last.split()[-1], last.split()[-1].upper()]),
        (f"Mail to q{d(4)}.x@host{d(3)}.org, please.", [f"host{d(0)}"]), (f"Tel. {(n := d(3) + '-' + d(4))} now.", [n]), (f"Call me at {(n := d(3) + ' ' + d(4))} now.", [n]), (f"Numéro 06 {(n := ' '.join(d(2) for _ in range(4)))}.", [n]),
        (f"Ring +49 {(n := d(3) + ' ' + d(4) + ' ' + d(3))} today.", [n]), (f"Born on {(n := f'{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/19{d(2)}')} there.", [n]), (f"date of birth: {(n := f'19{d(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}')}", [n]),
        (f"Passport no. {(n := 'X' + d(8))} is lost.", [n]), (f"Host {(n := '.'.join(str(rng.randrange(1, 255)) for _ in range(4)))} is up.", [n]), (f"ssn {(n := d(3) + '-' + d(2) + '-' + d(4))} .", [n]), (f"password={(n := 'p' + d(9))} is bad", [n]),
    ])


def test_nothing_known_stays_and_nothing_else_goes(spark):
    rng, rows, wanted = random.Random(5), [], {}
    for i in range(600):
        some = [entity(rng) for _ in range(rng.randrange(4))]
        clean = rng.sample(CLEAN, rng.randrange(4))
        parts = [(t, g) for t, g in some] + [(t, []) for t in clean]
        rng.shuffle(parts)
        rows.append((i, "\n".join(t for t, _ in parts)))
        wanted[i] = (parts, [x for _, g in parts for x in g])
    got = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    leaks, changed = [], []
    for i, (parts, gone) in wanted.items():
        lines = got[i].text.split("\n")
        assert len(lines) == max(1, len(parts))
        leaks += [(g, got[i].text) for g in gone if re.search(rf"(?<!\w){re.escape(g)}(?!\w)", got[i].text)]
        changed += [(t, line) for (t, g), line in zip(parts, lines, strict=False) if not g and t != line]
        assert got[i].n_entities >= sum(1 for _, g in parts if g)
    assert not leaks and not changed


def test_spans_that_were_left_or_found_in_error():
    new = lambda t: pii.rewrite(t, KEY, {})[0]
    assert new("Mrs. Anna-Maria Lopez").split()[0] == "Mrs." and "Lopez" not in new("Mrs. Anna-Maria Lopez") and "Maria" not in new("Mrs. Anna-Maria Lopez")
    assert new("the Smith of Mr Smith").startswith("the Smith") and new("a smith, Mr Smith").startswith("a smith")
    assert re.fullmatch(r"born on (\d\d)/(\d\d)/(19[3-9]\d|20[01]\d)", new("born on 31/12/1980"))
    for n in range(8):
        assert re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", pii.surrogate("ip", "10.0.0.1", KEY, n))
    assert len({pii.surrogate("birthday", "1980-01-02", KEY, n) for n in range(40)}) > 30


@pytest.mark.parametrize("text", ["a1." * 350_000, "a@" * 500_000, "a@" + "1." * 500_000, "x=1 " * 250_000, "Mr A" * 250_000, "0f:" * 330_000, ("Anna Meyer " + "word " * 20) * 10_000, "Anna A" + "-Aa" * 330_000, "DE89 " * 200_000, "1" * 10**6])
def test_a_megabyte_takes_seconds(text):
    began = time.time()
    pii.rewrite(text, KEY, {})
    assert time.time() - began < 30


def test_key_of_a_session_is_drawn_once(spark):
    from skeinrank.llm.queries import pii_key

    before = spark.conf.get("skeinrank.pii.key", None)
    spark.conf.unset("skeinrank.pii.key")
    try:
        assert pii_key(spark) == pii_key(spark) and len(pii_key(spark)) == 64 and pii_key(spark) != b"for tests only"
    finally:
        spark.conf.set("skeinrank.pii.key", before) if before else spark.conf.unset("skeinrank.pii.key")
