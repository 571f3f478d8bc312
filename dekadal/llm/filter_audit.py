"""Filter interaction audit: what each of several filters removes, for every order in which they could be applied.

Each row's failures are a bit mask, and all counts of all orders are sums over the counts of masks. The one failure that a
text alone doesn't tell is that an earlier row has the same text. A counting-Bloom sketch of all texts clears those that no
other row has; only what may repeat is shuffled, whole, to find the least id of each text.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._sketch import perhaps_repeated, sketch
from ._text import LEAD, NOT_SPACE, byte_table, hits, map_texts, run_hashes, runs, saved, table, tuned

#: The filters by letter: the bit of the n-th is 1 << n. E, copies, is not told by a text alone.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER = byte_table((0x41, 0x5A))
SYMBOL = byte_table(*[(ord(c), ord(c)) for c in "#$%&*|"])


def failures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bits of A to D for each text. A: under 50 words; B: 100 times the distinct words under 65 times the words; C: 100
    times the letters A-Z over 5 times the code points; D: any of ``#$%&*|``. Words are compared by 64-bit hashes."""
    starts, ends, at = runs(buf, offs, NOT_SPACE)
    words = np.diff(at)
    doc, h = np.repeat(np.arange(len(words)), words), run_hashes(buf, starts, ends)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(words))
    upper, points = hits(UPPER[buf], offs), hits(LEAD[buf], offs)
    return (words < 50) + 2 * (100 * distinct < 65 * words) + 4 * (100 * upper > 5 * points) + 8 * (hits(SYMBOL[buf], offs) > 0)


def later_copies(docs: DataFrame, marks: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, a, b) of the rows whose text a row of a smaller id has too; a and b are the text's two hashes. marks: (id, a, b)
    of all rows, saved.

    The sketch of marks clears texts; the whole texts of the others are grouped, which combines copies before they are
    shuffled, so that a text that a third of all rows hold is a row a task. A row that may repeat and isn't the first of
    its text is a copy. A null id is neither smaller nor larger than others.
    """
    seen = sketch(marks, "__a", "__b")
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    texts = texts.withColumns({"__a": F.xxhash64("__text"), "__b": F.xxhash64(F.lit(1), "__text")})
    unsure = perhaps_repeated(texts, seen, "__a", "__b", "__perhaps").where("__perhaps")
    first = unsure.groupBy("__text").agg(F.min("__id").alias("__id"), F.first("__a").alias("__a"), F.first("__b").alias("__b"))
    again = perhaps_repeated(marks, seen, "__a", "__b", "__perhaps").where("__perhaps and __id is not null").select("__id", "__a", "__b").distinct()
    return again.join(first.select("__id", "__a", "__b"), ["__id", "__a", "__b"], "left_anti")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail and by their labels. Rows that fail nothing and
    surely have no copy are counted where they are; ids of the others, without texts, meet copies and labels."""
    # the prose of a text stays in the scan: what is saved of a document is its id, part, mask and hashes
    kept = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    kept = kept.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")})
    rows = saved(map_texts(kept, "mask long", lambda buf, offs: {"mask": failures(buf, offs)}, ["__id", "part", "__a", "__b"]), "audit-rows")
    copies = later_copies(docs, rows.select("__id", "__a", "__b"), id_col, text).withColumn("__copy", F.lit(COPY))
    full = rows.join(copies, ["__id", "__a", "__b"], "left").select("__id", "part", (F.col("mask") + F.coalesce("__copy", F.lit(0))).alias("mask"))
    full = saved(full, "audit-masks")
    marked = labels.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    lost = full.where("mask > 0").join(marked, "__id", "left")
    none = F.lit(0).cast("int")
    lost = lost.select("part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    rest = full.where("mask = 0").select("part", "mask", none.alias("good"), none.alias("toxic"))
    return lost.unionByName(rest).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def every_order(spark: SparkSession, filters: str = FILTERS) -> tuple[DataFrame, DataFrame]:
    """Two tables of fixed size. (filter, before, mask, kept, removed, redundant, alone, share): what a mask counts for where
    a filter comes after a set of others; (filter_order, step, filter, before): where each order does that."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    rules, steps = [], []
    for f in filters:
        others = [g for g in filters if g != f]
        for before in [sum(bit[g] for g in s) for k in range(len(filters)) for s in combinations(others, k)]:
            for mask in range(1 << len(filters)):
                fails, gone = bool(mask & bit[f]), bool(mask & before)
                share = factorial(len(filters)) // mask.bit_count() if fails else 0  # of a mask's filters each is first as often
                counts = {"__kept": not fails and not gone, "__removed": fails and not gone, "__redundant": fails and gone, "__alone": mask == bit[f]}
                rules.append({"filter": f, "before": before, "mask": mask, **{k: int(v) for k, v in counts.items()}, "__share": share})
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "filter": f, "before": before})
            before |= bit[f]
    return spark.createDataFrame(pa.Table.from_pylist(rules)), spark.createDataFrame(pa.Table.from_pylist(steps))


def filter_audit(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts of masks: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A count meets 80 rules and a part 600 steps, both tables of fixed size (2560 and 600 rows)."""
    rules, steps = every_order(counts.sparkSession)
    n = F.col("n")
    sums = {
        "kept": n * F.col("__kept"), "removed": n * F.col("__removed"), "redundant": n * F.col("__redundant"), "unique_fails": n * F.col("__alone"),
        "good_lost": n * F.col("good") * F.col("__removed"), "toxic_lost": n * F.col("toxic") * F.col("__removed"), "shapley": n * F.col("__share"),
    }
    by = counts.join(F.broadcast(rules), "mask").groupBy("part", "filter", "before").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return by.join(F.broadcast(steps), ["filter", "before"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), *sums)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Null and empty texts are the same text, and fail A. Rows that repeat an id are documents of their own; a text is a copy
    only of a smaller id's, so rows of one id, and of null ids, are no copies of each other. A null source is the part of
    the empty string. A document has a label if any row of labels gives it; null labels are none. An empty table has no
    parts. A very long text is one task's work, in memory of some ten times its size.
    """
    docs, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit(mask_counts(docs, labels))


#: The same by plain SQL: every row's mask, then every order over every mask.
SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
    f AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                 + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
                 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS mask FROM w),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT f AS filter_order, bit AS used FROM letters UNION ALL SELECT filter_order || f, used + bit FROM o, letters WHERE used & bit = 0),
    s AS (SELECT filter_order, step, (SELECT bit FROM letters WHERE f = filter_order[step]) AS bit,
                 coalesce((SELECT sum(bit) FROM letters WHERE contains(filter_order[1:step - 1], f)), 0)::INT AS before
          FROM o, range(1, 6) r(step) WHERE used = 31),
    a AS (SELECT part, filter_order, step::INT AS step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
                 sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                 sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
          FROM m, s GROUP BY ALL)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
           coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM a
"""
