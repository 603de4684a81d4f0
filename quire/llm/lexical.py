"""Ranked lexical search: integer scores of documents for items, the best of each item kept.

Postings are a table (bucket, term, row, doc_id, n, tf): bucket is a hash of the term, and
every file is sorted by bucket and term, so a search reads the row groups of its terms'
buckets and no term, however frequent, lies in one task. A row without a term for each
document carries its length. A search joins its items' terms, scores each match in 64-bit
integers, sums by item and document, and ranks with a window that cuts to the best before
its shuffle. Sums need no shuffle of matches: postings are dealt by document, a fraction
of the corpus, and each document meets all items where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import written

BEST = 50
BUCKETS = 256
#: What may be broadcast, counted before it is: rows and bytes of the terms of all items. Beyond it terms are joined by shuffles.
MOST_ROWS, MOST_BYTES = 1_000_000, 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between terms: ASCII other than digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included; none for null. Only A-Z are lower-cased."""
    found = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(found, "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the terms of each item (item_id, text), once each; rows of one item_id are one item."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct()


def fits(df: DataFrame) -> bool:
    """Whether a table with a column term is small enough to be broadcast; counted, not estimated."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + F.lit(32)).alias("bytes")).first()
    return size.n <= MOST_ROWS and (size.bytes or 0) <= MOST_BYTES


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(bucket, term, row, doc_id, n, tf) of docs (doc_id, text, ...), each row of docs a document of its own numbered by ``row``.

    n is the number of terms of the document, tf that of this one. A document with terms has one more row with null
    term and bucket. ``wanted`` (term) limits terms, not documents.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("found"))
    rows = rows.select("row", "doc_id", F.size("found").cast("long").alias("n"), "found").where("n > 0")
    # the null at the end of each document's terms is its row for the length
    each = rows.select("row", "doc_id", "n", F.explode(F.array_append("found", F.lit(None).cast("string"))).alias("term"))
    if wanted is not None:
        known = wanted.select("term").distinct().withColumn("known", F.lit(True))
        if fits(known):
            each = each.join(F.broadcast(known), "term", "left").where("known or term is null").drop("known")
        else:  # the rows without a term would all meet in one task of a shuffled join
            lengths = rows.select("row", "doc_id", "n", F.lit(None).cast("string").alias("term"))
            each = each.where("term is not null").join(known, "term", "left_semi").select(lengths.columns).unionByName(lengths)
    counted = each.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    return counted.select(bucket(F.col("term")).alias("bucket"), "term", "row", "doc_id", "n", "tf").withColumn("bucket", F.when(F.col("term").isNotNull(), F.col("bucket")))


def stored(found: DataFrame) -> DataFrame:
    """Postings as a table in the shared folder, every file in the order of buckets and terms."""
    return written(found.sortWithinPartitions("bucket", "term"))


def search(items: DataFrame, index: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item over a table of postings; see rank_documents."""
    total = index.where("term is null").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total.n:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = item_terms(items)
    matched = index.where("term is not null")
    frequent = matched.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total.n + 2) / (2.0 * F.col("df") + 1)))
    # a term with weight zero adds nothing to any score
    weighted = asked.withColumn("bucket", bucket(F.col("term"))).join(frequent, ["bucket", "term"]).select("item_id", "bucket", "term", weight.alias("w")).where("w > 0")
    small = fits(weighted)
    length = F.expr(f"50L + ((50L * n * {total.n}L) div {total.l}L)")
    impact = F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    scored = matched.select("bucket", "term", "row", "doc_id", "tf", length.alias("m")).select("bucket", "term", "row", "doc_id", impact.alias("impact"))
    if small:
        met = scored.repartition("row").join(F.broadcast(weighted), ["bucket", "term"])
    else:
        met = scored.join(weighted, ["bucket", "term"])
    sums = met.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of items (item_id, text) its ``best`` documents of docs (doc_id, text, ...).

    Every row of docs is a document, so repeated rows each have a rank; rows of items with the same item_id (null too) are
    one item with the terms of all. Equal scores go by doc_id, nulls last. Null and empty texts have no terms; items
    without a match, and all items over an empty table, have no rows. Other columns are ignored.
    """
    return search(items, stored(postings(docs, item_terms(items))), best)


#: The same result in DuckDB; BEST and the integers as above.
RANK_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents
), len AS (SELECT rid, doc_id, found, len(found) AS n FROM d WHERE len(found) > 0),
total AS (SELECT count(*)::BIGINT AS total_n, sum(n)::BIGINT AS total_l FROM len),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), occurrences AS (SELECT rid, doc_id, n, unnest(found) AS term FROM len),
post AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM occurrences WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), freq AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term),
weighted AS (
  SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * total_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM asked JOIN freq USING (term), total
), sums AS (
  SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total_n) // total_l))))::BIGINT AS score
  FROM post JOIN weighted USING (term), total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid)::INTEGER AS rank, doc_id, score FROM sums WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
