"""A kept index of sparse retrieval: postings in blocks with their maxima, statistics that are added up by changes.

Documents are tokenized once, when they come in. Each upsert writes a generation of its own, and a row in `commits` last: what has none isn't read.

* `forward`: a document's language, length, and counts of terms, by which later changes are worked out without its text.
* `postings`: a row for each term of a block of about `block` documents of a language and shard, in order of falling counts and rising
  lengths, with the highest count and the least length. Blocks gather documents of like length. Files are dealt by
  term, so that a search reads the folders of its terms only.
* `dead`: ids whose rows of earlier generations count no more.
* `statistics`: by language and term, changes of the documents with the term, with no term of documents and tokens; `spectrum`:
  changes of how many terms are in so many documents, from which the mean of all weights comes without the vocabulary.

Search goes by blocks. A block's maxima bound what any of its documents can score for a query: those of the highest bounds are scored
first, a few for each query, and the k-th best score is the bar for the others: blocks whose bound is below it
are skipped unread, all terms of theirs at once. Scores and order are those of a search of all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..sources.work import exists, written

FORWARD = "doc_id long, corpus string, dl long, terms array<struct<term:string,tf:int>>"
_FORWARD = pa.schema([("doc_id", pa.int64()), ("corpus", pa.string()), ("dl", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))])
POSTINGS = "corpus string, term string, block long, docs array<struct<doc_id:long,tf:int,dl:long>>, top_tf int, low_dl long, part int, gen long"
STATISTICS = "corpus string, term string, n long, size long, part int, gen long"
#: Files of postings are dealt by term to so many folders.
PARTS = 32


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, corpus, tokens in zip(batch["doc_id"].to_pylist(), batch["corpus"].to_pylist(), batch["t"], strict=True):
            own = tokens.as_py() or []
            rows.append({"doc_id": doc, "corpus": corpus, "dl": len(own), "terms": [{"term": t, "tf": n} for t, n in Counter(own).items()]})
        yield pa.RecordBatch.from_pylist(rows, _FORWARD)


def _part(corpus: str = "corpus", term: str = "term") -> Column:
    return F.pmod(F.xxhash64(corpus, term), F.lit(PARTS)).cast("int")


def _entries(forward: DataFrame, sign: int) -> DataFrame:
    """(corpus, term, n, size) of each document, counted by sign: a row without a term for its tokens, and one for each term."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("dl").alias("size")))
    each = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), F.lit(0).cast("long").alias("size")))
    return forward.select("corpus", F.explode(F.concat(whole, each)).alias("e")).select("corpus", "e.term", F.lit(sign).cast("long").alias("n"), (F.col("e.size") * sign).alias("size"))


def saturated(tf: Column, dl: Column, avgdl: Column, config: Config = DEFAULT) -> Column:
    """What a term gives per unit of its weight."""
    k1, b = config.bm25_k1, config.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


class SparseIndex:
    """An index under a path of the shared store. Documents: doc_id (unique among those given at once, not null), text, lang."""

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT, block: int = 64, shard: int = 50_000):
        self.spark, self.path, self.config, self.block, self.shard = spark, path.rstrip("/"), config, block, shard

    def _commits(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        return sorted(r.gen for r in self.spark.read.schema("gen long").parquet(f"{self.path}/commits").collect())  # a row an upsert

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows of the generations that are committed."""
        return self._files(name, schema).where(F.col("gen").isin(self._commits()))

    def _files(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, gen: int, *by: str) -> None:
        """Overwrites what a lost attempt at this generation has left."""
        rows.withColumn("gen", F.lit(gen).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", *by).parquet(f"{self.path}/{name}")

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts documents in, in place of those with the same ids, and takes the ids of gone (doc_id) out."""
        gen = max(self._commits(), default=0) + 1
        corpus = tx.language_key(F.col("lang")) if "lang" in docs.columns else F.lit("")
        core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), corpus.alias("corpus"), tx.bm25_tokens(F.coalesce("text", F.lit(""))).alias("t"))
        self._write(core.mapInArrow(_counted, FORWARD), "forward", gen)
        new = self._files("forward", FORWARD + ", gen long").where(F.col("gen") == gen).drop("gen")
        ids = new.select("doc_id") if gone is None else new.select("doc_id").union(gone.select(F.col("doc_id").cast("long")))
        old = self.forward().join(ids, "doc_id", "left_semi") if gen > 1 else None
        if gen > 1:
            self._write(ids.distinct(), "dead", gen)
        self._write_postings(new, gen)
        # Changes of documents, tokens and frequencies; nothing is counted anew.
        rows = _entries(new, 1) if old is None else _entries(new, 1).unionByName(_entries(old, -1))
        delta = rows.groupBy("corpus", "term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where("n <> 0 or size <> 0")
        self._write(delta.withColumn("part", _part()).repartition("part"), "statistics", gen, "part")
        moved = self._files("statistics", STATISTICS).where((F.col("gen") == gen) & F.col("term").isNotNull())
        before = self._statistics().where("term is not null").select("corpus", "term", F.col("n").alias("was"))
        was = F.coalesce("was", F.lit(0).cast("long"))
        both = moved.join(before, ["corpus", "term"], "left").select("corpus", F.explode(F.array(F.struct(was.alias("df"), F.lit(-1).alias("d")), F.struct((was + F.col("n")).alias("df"), F.lit(1).alias("d")))).alias("e"))
        self._write(both.where("e.df > 0").groupBy("corpus", "e.df").agg(F.sum("e.d").alias("terms")), "spectrum", gen)
        self.spark.createDataFrame([(gen,)], "gen long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _write_postings(self, new: DataFrame, gen: int) -> None:
        n = new.count()
        # Blocks are numbered within shards of bounded size, so that no window is large; documents of like length share one.
        shards = -(-n // self.shard) or 1
        place = new.select("doc_id", "corpus", "dl", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
        order = Window.partitionBy("corpus", "shard").orderBy("dl", "doc_id")
        numbered = place.select("doc_id", (F.lit(gen * 2**40) + F.col("shard") * 2**24 + F.floor((F.row_number().over(order) - 1) / self.block)).cast("long").alias("block"))
        post = new.join(numbered, "doc_id").select("doc_id", "corpus", "dl", "block", F.explode("terms").alias("e"))
        item = F.struct((-F.col("e.tf")).alias("k"), "dl", "doc_id")
        rows = post.groupBy("corpus", "e.term", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("e.tf").alias("top_tf"), F.min("dl").alias("low_dl"))
        docs = F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["k"]).alias("tf"), x["dl"].alias("dl")))
        rows = rows.select("corpus", "term", "block", docs.alias("docs"), "top_tf", "low_dl", _part().alias("part"))
        files = max(1, min(16, n // 500_000))
        self._write(rows.repartition(PARTS * files, "part", F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions("part", "term"), "postings", gen, "part")

    def forward(self) -> DataFrame:
        """(doc_id, corpus, dl, terms) of the documents that count."""
        return self._live(self._read("forward", FORWARD + ", gen long")).drop("gen")

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, gen) that no later generation has replaced."""
        if len(self._commits()) < 2:
            return rows
        dead = self._read("dead", "doc_id long, gen long").groupBy("doc_id").agg(F.max("gen").alias("replaced"))
        return rows.join(dead, "doc_id", "left").where("replaced is null or gen >= replaced").drop("replaced")

    def _statistics(self, terms: DataFrame | None = None) -> DataFrame:
        """(corpus, term, n, size); with terms (corpus, term, part) only of these, from their folders only."""
        s = self._read("statistics", STATISTICS)
        if terms is not None:
            s = s.where(F.col("part").isin([r.part for r in terms.select("part").distinct().collect()])).join(terms.select("corpus", "term"), ["corpus", "term"], "left_semi")  # at most PARTS numbers
        return s.groupBy("corpus", "term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > 0 or size > 0")

    def corpora(self) -> DataFrame:
        """(corpus, docs, avgdl, mean): documents, their mean length, the mean raw weight of all terms; a row a language."""
        s = self._read("statistics", STATISTICS).where("term is null").groupBy("corpus").agg(F.sum("n").alias("docs"), F.sum("size").alias("size")).where("docs > 0")
        spectrum = self._read("spectrum", "corpus string, df long, terms long, gen long").groupBy("corpus", "df").agg(F.sum("terms").alias("terms"))
        raw = F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = spectrum.join(s.select("corpus", "docs"), "corpus").groupBy("corpus").agg((F.sum(raw * F.col("terms")) / F.sum("terms")).alias("mean"))
        return s.join(mean, "corpus", "left").select("corpus", "docs", (F.col("size") / F.col("docs")).alias("avgdl"), "mean")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, corpus, term, part, avgdl, w): the weights of the terms of queries (query_id, text, lang) that the index has."""
        corpus = tx.language_key(F.col("lang")) if "lang" in queries.columns else F.lit("")
        t = queries.select("query_id", corpus.alias("corpus"), F.explode(tx.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "corpus", "term").agg(F.count("*").alias("qf")).withColumn("part", _part())
        t = written(t, "asked")
        stats = self._statistics(t.select("corpus", "term", "part").distinct()).select("corpus", "term", F.col("n").alias("df"))
        raw = F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.col("mean") * self.config.bm25_epsilon).otherwise(raw)
        return written(t.join(stats, ["corpus", "term"]).join(self.corpora(), "corpus").select("query_id", "corpus", "term", "part", "avgdl", (F.col("qf") * idf).alias("w")), "weights")

    def _postings(self, asked: DataFrame) -> DataFrame:
        parts = [r.part for r in asked.select("part").distinct().collect()]  # at most PARTS numbers
        return self._read("postings", POSTINGS).where(F.col("part").isin(parts))

    def _scored(self, blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the postings of blocks (corpus, term, block, docs, gen, query_id, w, avgdl)."""
        hit = self._live(blocks.select("query_id", "w", "avgdl", "gen", F.explode("docs").alias("d")).select("query_id", "w", "avgdl", "gen", "d.*"))
        part = F.col("w") * saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), self.config)
        return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of every document that shares a term with a query of its language."""
        from .retrieval import few

        asked = self.asked(queries)
        return self._scored(self._postings(asked).join(few(asked)(asked.drop("part")), ["corpus", "term"]), asked)

    def search(self, queries: DataFrame, k: int, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """The k best (query_id, doc_id, score, rank), and per query (query_id, blocks, scored): blocks with a term of it, and those read.

        first: blocks of a query that are scored before the others' bounds are held against its k-th score.
        """
        from .retrieval import few, top

        asked = self.asked(queries)
        near = few(asked)
        post = self._postings(asked)
        # A negative weight bounds nothing from above but zero.
        bound = F.greatest(F.col("w"), F.lit(0.0)) * saturated(F.col("top_tf"), F.col("low_dl"), F.col("avgdl"), self.config)
        limits = post.select("corpus", "term", "block", "top_tf", "low_dl").join(near(asked.drop("part")), ["corpus", "term"]).groupBy("query_id", "corpus", "block").agg(F.sum(bound).alias("bound"))
        limits = written(limits, "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        ranked = limits.withColumn("i", F.row_number().over(order))
        terms = asked.select("query_id", "corpus", "term", "w", "avgdl")

        def scored(pairs: DataFrame) -> DataFrame:
            return self._scored(post.drop("part").join(near(terms), ["corpus", "term"]).join(pairs.select("query_id", "block"), ["query_id", "block"], "left_semi"), asked)

        begun = written(scored(ranked.where(F.col("i") <= first)), "first-blocks")
        bar = top(begun, k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("bar"))
        # Scores are rounded to six places: a bound that misses the bar by less may still reach it.
        rest = ranked.where(F.col("i") > first).join(bar, "query_id", "left").where("bar is null or bound >= bar - 1e-6")
        both = begun.unionByName(scored(rest))
        read = ranked.where(F.col("i") <= first).select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("scored"))
        counts = limits.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")
        return top(both, k), counts
