"""Caption search on a stored inverted index of terms and positions, BM25 ranking, rank fusion, and the search that joins them."""

from __future__ import annotations

import contextlib
import hashlib
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.operators import filters, vectors
from lumora.operators.caption_index import CaptionIndex, Index, buckets_of, postings
from lumora.sources.commits import CommitTaken
from lumora.sources.shared import shared_dir

K1, B, RRF_K = 1.2, 0.75, 60
#: Latin letters with diacritics, by the rule that their first decomposed character is an ASCII letter, and that letter.
_FOLDED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and "a" <= unicodedata.normalize("NFD", c)[0] <= "z"}
FOLD_FROM, FOLD_TO = "".join(_FOLDED), "".join(_FOLDED.values())


def tokens(text: Column) -> Column:
    """Lower-cased, diacritics of Latin letters dropped, split at anything but letters and digits."""
    return F.filter(F.split(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """The same on the driver, for a query."""
    low = text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return [t for t in re.split(r"[\W_]+", low) if t]


def _idf(n: Column, total: Column) -> Column:
    return F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(1e-6))


def caption_index(spark: SparkSession, path: str, key: str = "image_id", text: str = "caption") -> CaptionIndex:
    return CaptionIndex(spark, path, tokens, key, text)


def stored(captions: DataFrame, key: str = "image_id", text: str = "caption") -> Index:
    """The captions' index in the shared folder; built where it isn't there yet.

    Its name depends on the captions' files, their sizes and times: other captions have another index. A catalog that grows keeps one
    caption_index() and updates it.
    """
    spark = captions.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    status = [(f, s.getLen(), s.getModificationTime()) for f in sorted(captions.inputFiles()) for s in [path(f).getFileSystem(conf).getFileStatus(path(f))]]
    name = hashlib.sha256(repr((key, text, status)).encode()).hexdigest()[:20]
    found = caption_index(spark, f"{shared_dir(spark)}/lumora-index-{name}", key, text)
    if not found.commits.numbers():
        with contextlib.suppress(CommitTaken):  # another session has built it meanwhile
            found.add(captions)
    return found.index()


def made(captions: DataFrame, key: str = "image_id", text: str = "caption") -> Index:
    """The index of captions that aren't files."""
    rows = postings(captions, tokens(F.col(text)), key, text).dropDuplicates(["doc", "part", "term"])
    return Index(rows.where("term is not null"), rows.where("term is null").agg(F.count("*").alias("total"), F.avg("length").alias("mean")))


def _ranked(hits: DataFrame, whole: DataFrame) -> DataFrame:
    """hits: doc, part, term, tf, length; doc, part, score: BM25 summed over terms."""
    n = hits.groupBy("term").agg(F.count("*").alias("n"))
    rows = hits.join(F.broadcast(n), "term").crossJoin(F.broadcast(whole))
    part = _idf(F.col("n"), F.col("total")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("doc", "part").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("terms"))


def of_terms(found: Index, terms: list[str]) -> DataFrame:
    """The postings of some terms; of a stored index only their buckets are read."""
    rows = found.terms.where(F.col("term").isin(terms))
    return rows.where(F.col("bucket").isin(buckets_of(found.terms.sparkSession, terms))) if "bucket" in rows.columns else rows


def all_terms(found: Index, query: str) -> DataFrame:
    """doc, score: captions that hold every term of the query, by BM25."""
    terms = sorted(set(query_terms(query)))
    hits = of_terms(found, terms).select("doc", "part", "term", "tf", "length")
    return _ranked(hits, found.whole).where(F.col("terms") == len(terms)).select("doc", "score")


def phrase(found: Index, query: str) -> DataFrame:
    """doc, n, score: captions with the query's terms in a row; the phrase ranks as one term. Each term's positions are joined with the ones that the term before leaves."""
    terms = query_terms(query)
    hits = None
    for i, t in enumerate(terms):
        mine = of_terms(found, [t]).select("doc", "part", "length", F.transform("positions", lambda p: p - F.lit(i)).alias("at"))
        hits = mine if hits is None else hits.join(mine.select("doc", "part", F.col("at").alias("more")), ["doc", "part"]).select("doc", "part", "length", F.array_intersect("at", "more").alias("at")).where(F.size("at") > 0)
    if hits is None:
        hits = found.terms.limit(0).select("doc", "part", "length", F.col("positions").alias("at"))
    hits = hits.select("doc", "part", "length", F.size("at").cast("long").alias("tf"), F.lit(" ".join(terms)).alias("term"))
    return hits.select("doc", "part", F.col("tf").alias("n")).join(_ranked(hits, found.whole), ["doc", "part"]).select("doc", "n", "score")


def best_caption(hits: DataFrame) -> DataFrame:
    """One row per asset where it has several captions: its best."""
    return hits.groupBy("doc").agg(F.max("score").alias("score"))


def fused(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score: reciprocal ranks 1 / (k + rank) of two ranked lists (id, rank) added up; union and sum, no outer join."""
    both = first.select("id", "rank").unionByName(second.select("id", "rank"))
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))


def with_rank(rows: DataFrame, score: str, most: int) -> DataFrame:
    """The best most rows with their rank; the limit comes first, so that the ranking window sees only those."""
    top = rows.orderBy(F.desc(score), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")).cast("long"))


def mode(asked: str, text: str | None, has_vectors: bool, has_query_vector: bool) -> tuple[str, str | None]:
    """The mode that can be served, and the one it is degraded from."""
    if asked in ("semantic", "text2image", "hybrid") and not (has_vectors and has_query_vector):
        return ("caption" if asked == "hybrid" and (text or "").strip() else "tags"), asked
    if asked == "caption" and not (text or "").strip():
        return "tags", asked
    return asked, None


def search(assets: DataFrame, tags: DataFrame, labels: DataFrame, captions: Index, store: DataFrame, spec: filters.FilterSpec, asked: str = "tags", text: str | None = None, query: DataFrame | None = None, k: int = 100, has_vectors: bool = True) -> tuple[DataFrame, str, str | None]:
    """(id, score in order; mode; degraded from): filters, then tags, caption, vector or fused ranking, as one plan."""
    now, was = mode(asked, text, has_vectors, query is not None)
    pool = filters.candidates(assets, tags, labels, spec).select("id")
    if now == "tags":
        return pool.select("id", F.lit(0.0).alias("score")).orderBy(F.desc("id")).limit(k), now, was
    if now == "caption":
        hits = best_caption(phrase(captions, text)).withColumnRenamed("doc", "id")
        return hits.join(pool, "id", "left_semi").orderBy(F.desc("score"), "id").limit(k), now, was
    near = vectors.nearest(store, query, k, pool).withColumnRenamed("similarity", "score")
    if now != "hybrid" or not (text or "").strip():
        return near.orderBy(F.desc("score"), "id"), now, was
    words = best_caption(all_terms(captions, text)).withColumnRenamed("doc", "id").join(pool, "id", "left_semi")
    return fused(with_rank(near, "score", k), with_rank(words, "score", k)).orderBy(F.desc("score"), "id").limit(k), now, was
