"""Benchmark decontamination: short items found inside long documents, in DataFrame functions only.

A document's sketch says little about the few shingles of an item, so only items are sketched, and every shingle of a
document probes the sketches. Items are partitioned by size (powers of two); the bottom-k MinHash sketch of a partition
has k = the shingles that its largest item may miss, plus one. A document that contains the asked share of an item
therefore meets its sketch. Pairs that meet are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import having, lacking, saved, table

#: Rows of sketches or items' shingles up to which they are broadcast (24 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """Lower-case runs of ASCII letters and digits and of any other characters outside ASCII."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def with_shingles(df: DataFrame, text: str, keep: list[str], n: int) -> DataFrame:
    """One row per place of a shingle: keep and the hash of its n words. A text of fewer words has one, all its words."""
    w = df.select(*keep, words(text).alias("w"))
    shifted = [F.expr(f"slice(w, {k + 1}, greatest(size(w) - {n - 1}, 0))").alias(f"w{k}") for k in range(n)]
    one = F.array(F.struct(F.concat_ws(" ", "w").alias("w0"), *[F.lit(None).cast("string").alias(f"w{k}") for k in range(1, n)]))
    parts = F.when(F.size("w") >= n, F.arrays_zip(*shifted)).otherwise(F.when(F.size("w") > 0, one))
    rows = w.select(*keep, F.inline(parts).alias(*[f"w{k}" for k in range(n)]))
    return rows.select(*keep, F.xxhash64(*[f"w{k}" for k in range(n)]).alias("shingle"))


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a saved table, if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_items(
    docs: DataFrame, items: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id",
    item_col: str = "item_id", text: str = "text", item_text: str = "text",
) -> DataFrame:
    """(id, item, n_shared, n_item) for each document that holds at least percent of the item's distinct n-word
    shingles.

    Documents and items without words match nothing; those of fewer than n words are one shingle, their whole sequence.
    Rows that repeat an id count together as one document; items likewise. Null ids match nothing. Extra columns are not
    read. Work grows with the documents' shingles and the matches; a passage that many documents share costs a row each. A
    very long text is split into words by one task, as an array of its words and n more of its size; items that tie are all
    returned.
    """
    shingles = saved(with_shingles(items.where(F.col(item_col).isNotNull()), item_text, [item_col], n).distinct(), "items")
    sized = shingles.groupBy(item_col).agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("shingle")).alias("all"))
    largest = F.expr("2 * power(2, floor(log2(n_item))) - 1").cast("long")
    sketch = sized.select(item_col, F.explode(F.slice("all", F.lit(1), (F.floor((100 - percent) * largest / 100) + 1).cast("int"))).alias("shingle"))
    sketch = small(saved(sketch, "sketches"))
    places = with_shingles(docs.where(F.col(id_col).isNotNull()), text, [id_col], n)
    met = saved(places.join(sketch, "shingle").select(id_col, item_col).distinct(), "met")

    # exact containment, for the documents that met a sketch
    hit = having(docs.select(id_col, F.col(text).alias("__text")), met.select(id_col), id_col)
    held = with_shingles(hit, "__text", [id_col], n).join(small(shingles), "shingle").select(id_col, item_col, "shingle").distinct()
    shared = held.groupBy(id_col, item_col).agg(F.count("*").alias("n_shared"))
    both = shared.join(met, [id_col, item_col], "left_semi").join(sized.select(item_col, "n_item"), item_col)
    return both.where(100 * F.col("n_shared") >= percent * F.col("n_item")).select(id_col, item_col, "n_shared", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item. Rows with a null id are kept, as are null and empty texts; where rows repeat an
    id, all go if together they hold an item; without items, or documents, nothing changes. All columns are kept, and only
    rows that an id filter lets pass are shuffled."""
    gone = saved(find_items(docs, items, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return lacking(docs, gone, id_col)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
    WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
               UNION ALL
               SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    p AS (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
    s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
    n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id),
    m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY ALL)
    SELECT doc_id, item_id, n_shared, n_item FROM m JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n_item
"""
