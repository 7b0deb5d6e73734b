"""Text functions as columns: sentences, tokens, windows, languages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EXPLAINING, REFUSALS, ROMANISED

#: Fixed value: what separates the tokens of sparse retrieval.
TOKEN_GAP = r"""[\s.,;:!?()\[\]{}"'\-/\\।॥]+"""
#: The type of merged sentences, not a DDL string, as it is made before there is a session.
CHILDREN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("chunk_index", T.IntegerType())]))
#: Fixed value: white space of any kind.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(r"""[^ \t\n\x0b\f\r.,;:!?()\[\]{}"'\-/\\।॥]{2,}""")
_WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
SENTENCE_GAP = r"(?<=[।॥.!?؟])\s+|(?<=\n)\s*"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """Tokens between white space of any kind."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def bm25_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TOKEN_GAP), lambda x: F.length(x) > 1)


def find_tokens(lowered: str) -> list[str]:
    """`bm25_tokens` of a lower-cased text, in Python."""
    return _TOKEN.findall(lowered)


def split_words(text: str) -> list[str]:
    """`words` of a text, in Python, whose own split also takes four control characters for white space."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def _packed(c: Column, least: int) -> Column:
    """Words joined greedily: a piece ends with the first word that makes it `least` characters or longer."""
    return F.regexp_extract_all(F.array_join(words(c), " "), F.lit(rf"(?s) ?(.{{{least}}}[^ ]*|.+)"), F.lit(1))


def sentences(c: Column) -> Column:
    """Sentences: cut behind a full stop and white space, or behind a line feed; one long sentence is packed by words."""
    cut = F.filter(F.transform(F.split(c, SENTENCE_GAP), strip), lambda x: x != "")
    return F.when((F.size(cut) == 1) & (F.length(strip(c)) > 200), _packed(c, 150)).otherwise(cut)


@F.pandas_udf(CHILDREN)
def merged_sentences(parts: pd.Series) -> pd.Series:
    """Children (text, chunk_index): short sentences dropped, those of few words put before the next.

    A fold in which each sentence depends on what is carried from the one before; built-in folds copy the children
    gathered so far at every step, so that it runs on Arrow batches, in time linear in the text.
    """

    def fold(sentences):
        carried, out = "", []
        for i, sentence in enumerate(sentences):
            text = f"{carried} {sentence}".strip()
            carried = ""
            if len(text) < 10:
                continue
            if i < len(sentences) - 1 and len(text.split(None, 4)) < 5:
                carried = text
            else:
                out.append({"text": text, "chunk_index": i})
        return out

    return parts.map(lambda x: None if x is None else fold(x))


def token_windows(c: Column, size: int, overlap: float) -> Column:
    """Windows (text, chunk_index) of `size` tokens; a text of no more is one window, left as it is."""
    step = size - int(size * overlap)
    toks = words(c)
    n = F.size(toks)
    count = F.greatest(F.ceil((n - size) / F.lit(float(step))), F.lit(0)).cast("int")
    many = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(F.array_join(F.slice(toks, i * step + 1, size), " ").alias("text"), i.alias("chunk_index")))
    return F.when(n <= size, F.array(F.struct(c.alias("text"), F.lit(0).alias("chunk_index")))).otherwise(many)


def char_windows(c: Column, size: int, overlap: int) -> Column:
    """Stripped windows of `size` characters; blank ones are left out."""
    t, step = strip(c), size - overlap
    count = F.greatest(F.ceil((F.length(t) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), count), lambda i: strip(F.substring(t, i * step + 1, F.lit(size)))), lambda x: x != "")


def language_key(c: Column) -> Column:
    """The first part of a language tag; empty for all languages."""
    key = F.lower(strip(F.substring_index(F.substring_index(F.coalesce(c, F.lit("")), "-", 1), "_", 1)))
    return F.when(key.isin("auto", "all", "none", "*"), F.lit("")).otherwise(key)


def strategy(c: Column, default: str = "semantic") -> Column:
    toks = words(F.lower(strip(c)))
    asks = F.arrays_overlap(F.slice(toks, 1, 6), F.array(*[F.lit(w) for w in EXPLAINING]))
    return F.when(F.size(toks) <= 4, F.lit("sliding")).when(asks, F.lit("semantic")).otherwise(F.lit(default))


def refused(c: Column) -> Column:
    """Whether an answer refuses; an empty one does."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (t == "") | F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(t, p))


def script_language(c: Column) -> Column:
    """ta, hi or te by the most characters of its script (ties in this order); null where there are none."""
    ta, hi, te = (F.regexp_count(c, F.lit(x)) for x in ("[஀-௿]", "[ऀ-ॿ]", "[ఀ-౿]"))
    return F.when((ta > 0) & (ta >= hi) & (ta >= te), "ta").when((hi > 0) & (hi >= te), "hi").when(te > 0, "te")


def romanised_language(c: Column) -> Column:
    """ta, hi or te by the words of its list in c: one point within another word, two between blanks; null without any."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))

    def points(words: str) -> Column:
        of = lambda w: F.when(F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))), 2).when(F.contains(padded, w), 1).otherwise(0)
        return F.aggregate(F.array(*map(F.lit, words.split())), F.lit(0), lambda n, w: n + of(w))

    ta, hi, te = (points(ROMANISED[x]) for x in ("ta", "hi", "te"))
    scores = F.struct(ta.alias("ta"), hi.alias("hi"), te.alias("te"))
    first = lambda s: F.when((s["ta"] > 0) & (s["ta"] >= s["hi"]) & (s["ta"] >= s["te"]), "ta").when((s["hi"] > 0) & (s["hi"] >= s["te"]), "hi").when(s["te"] > 0, "te")
    return F.element_at(F.transform(F.array(scores), first), 1)


def detected_language(c: Column) -> Column:
    """The language by script, else by romanised words, else en (null and empty texts as well)."""
    return F.coalesce(script_language(c), romanised_language(c), F.lit("en"))


def transcript_winner(anchored: Column, general: Column) -> Column:
    """The anchored transcript if it has Tamil or Hindi letters, the general one if it has Telugu letters, else the longer."""
    anchored, general = (F.coalesce(x, F.lit("")) for x in (anchored, general))
    longer = F.when(F.length(general) > F.length(anchored), general).otherwise(anchored)
    return F.when(F.regexp_count(anchored, F.lit("[஀-௿ऀ-ॿ]")) > 0, anchored).when(F.regexp_count(general, F.lit("[ఀ-౿]")) > 0, general).otherwise(longer)
