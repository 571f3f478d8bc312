"""Approximate nearest neighbours by cosine: inverted lists, scanned in blocks of rotated dimensions.

Lists are fit on a bounded sample and hold every vector. A query visits its nearest lists. Within a list all vectors are
rotated, so that any block of dimensions tells about the whole: after each block of columns a hypothesis test compares the
partial distance with what a near enough vector would have by then, and gives up the candidates that fail. What stays is
scored on the original vectors, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import give_back, saved, table, tuned

#: Rows that lists are fit on, and of these the queries that tell how many lists to visit: the bounds of what the driver holds.
MAX_SAMPLE, MAX_TRIALS = 20_000, 500
#: Lists, and the share of the sample's neighbours that visits must find.
MAX_LISTS, RECALL = 1024, 0.97
#: Dimensions that a scan adds before it tests again, and the level of the test: a candidate that is just as near as the
#: threshold is given up with this probability a test; nearer ones with less.
BLOCK, LEVEL = 16, 0.005
#: Share of pairs below which a scan goes on with the pairs that stay, one by one, instead of whole blocks.
FEW = 0.1
#: Vectors of one list, and queries, that one task holds at once; larger lists are split.
LIST_ROWS, QUERY_ROWS = 4096, 4096
#: Pairs of a query and a candidate that one numpy pass compares.
PAIRS = 1 << 19


def usable(v: Column) -> Column:
    """Vectors that have a direction: no null, some length, all components finite, not all zero."""
    x = lambda e: e.cast("double")
    sound = F.forall(v, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) != float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda e: e != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def fit(sample: np.ndarray, lists: int, k: int, seed: int = 7, rounds: int = 10) -> tuple[np.ndarray, int]:
    """(centres of the lists, how many of them to visit): spherical k-means on the sample, and the least number of nearest
    lists that hold the share RECALL of the k nearest of some of its rows. Neighbours in a sample are farther than those in
    all rows, so the whole needs no more."""
    rng = np.random.default_rng(seed)
    u = unit(sample)
    centres = u[rng.choice(len(u), min(lists, len(u)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(u @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, u)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    own = np.argmax(u @ centres.T, axis=1)
    trial = rng.choice(len(u), min(MAX_TRIALS, len(u)), replace=False)
    near = u[trial] @ u.T
    near[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(u) - 1)]
    rank = np.argsort(np.argsort(-(u[trial] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    visits = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else 1
    return centres, visits


def rotation(n: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def shares(n: int) -> list[tuple[int, float]]:
    """(t, share) after each block of t of n dimensions: the part of a squared distance that lies in t random directions is
    above the share with probability LEVEL. It is distributed as Beta(t / 2, (n - t) / 2), summed numerically here."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for t in range(BLOCK, n, BLOCK):
        density = (t / 2 - 1) * np.log(x) + ((n - t) / 2 - 1) * np.log1p(-x)
        below = np.cumsum(np.exp(density - density.max()))
        out.append((t, float(x[min(len(x) - 1, np.searchsorted(below, (1 - LEVEL) * below[-1]))])))
    return [*out, (n, 1.0)]


def scan(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of queries, row of vectors) that may be among the k nearest of a query in this list: adaptive scan of both,
    unit rows. After each block the 2 k candidates that look nearest are measured in full: the k-th least distance is the
    query's threshold from then on, and the k least always stay. A block is a product of matrices while many pairs stay, and is
    summed for the pairs that stay once they are few."""
    n = vectors.shape[1]
    turn = rotation(n)
    q, v = queries @ turn, vectors @ turn
    tests, none = shares(n), np.zeros(0, np.int64)
    found_i, found_j = [none], [none]
    step = max(1, PAIRS // max(1, len(v)))
    for at in range(0, len(q), step):
        own = q[at : at + step]
        if len(v) <= k:
            i, j = np.indices((len(own), len(v))).reshape(2, -1)
            found_i.append(i + at)
            found_j.append(j)
            continue
        part = np.zeros((len(own), len(v)))
        limit, t = np.full(len(own), np.inf), 0
        i = j = d = first = None
        for to, share in tests:
            if i is None:
                part -= 2 * (own[:, t:to] @ v[:, t:to].T)
                part += (own[:, t:to] ** 2).sum(axis=1)[:, None]
                part += (v[:, t:to] ** 2).sum(axis=1)
                seem = np.argpartition(part, min(2 * k, len(v)) - 1, axis=1)[:, : 2 * k]
                full = ((own[:, None] - v[seem]) ** 2).sum(axis=2)
                best = np.argpartition(full, k - 1, axis=1)[:, :k]
                limit = np.minimum(limit, np.take_along_axis(full, best, axis=1).max(axis=1))
                first = np.take_along_axis(seem, best, axis=1)
                stay = part <= (limit * share * (1 + 1e-9) + 1e-13)[:, None]  # the last test is of the distance itself
                if to == n or np.count_nonzero(stay) < FEW * stay.size:
                    i, j = np.nonzero(stay)
                    d = part[i, j]
            else:
                d = d + ((own[i, t:to] - v[j, t:to]) ** 2).sum(axis=1)
                near = d <= limit[i] * share * (1 + 1e-9) + 1e-13
                i, j, d = i[near], j[near], d[near]
            t = to
        pairs = np.unique(np.concatenate([i * len(v) + j, (np.arange(len(own))[:, None] * len(v) + first).ravel()]))
        found_i.append(pairs // len(v) + at)
        found_j.append(pairs % len(v))
    return np.concatenate(found_i), np.concatenate(found_j)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b. A row is scaled by a power of two first, which is exact and keeps squares finite."""
    a, b = (x * np.exp2(-np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def nearest(
    vectors: DataFrame, chosen: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", max_lists: int = MAX_LISTS,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine of each row that chosen, a condition on rows, marks; nearest
    first, ties to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, and neither do null ids, nor
    vectors of another length than most have (the larger length on ties). Rows that repeat an id with one vector are one;
    an id with several vectors counts with the nearest of them. Fewer candidates than k are all returned. An empty table
    has no result.

    Rows with one and the same vector are one class, found by its hashes of 128 bits before any pair is looked at: of a
    class only its k + 1 least ids can be results, and its queries are answered once, so that a vector that a third of all
    rows hold costs no more than others. Lists, and the queries that visit one, are dealt over tasks in parts of bounded
    size. The driver holds a sample of MAX_SAMPLE rows and the lists' sizes.
    """
    spark = vectors.sparkSession
    zero = F.lit(0).cast(dict(vectors.dtypes)[vector].removeprefix("array<").removesuffix(">"))
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("__id"), F.when(usable(v), F.transform(v, lambda e: e + zero)).alias("__v"), chosen.alias("__q"))
    rows = rows.where("__id is not null and __v is not null")
    rows = rows.withColumns({"__n": F.size("__v"), "__a": F.xxhash64("__v"), "__b": F.xxhash64(F.lit(1), "__v")})
    sizes = rows.groupBy("__n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("__n")).limit(1).collect()
    length = sizes[0]["__n"] if sizes else 0
    rows = rows.where(F.col("__n") == length).drop("__n")
    # a class is a vector, shuffled once; its ids, without vectors, pass a limit in every task before they are shuffled
    place = F.row_number().over(Window.partitionBy("__a", "__b").orderBy("__id"))
    least = rows.select("__a", "__b", "__id").distinct().withColumn("__r", place).where(F.col("__r") <= k + 1)
    least = least.groupBy("__a", "__b").agg(F.array_sort(F.collect_list("__id")).alias("__ids"))
    classes = saved(rows.groupBy("__a", "__b").agg(F.first("__v").alias("__v")).join(least, ["__a", "__b"]), "vector-classes")
    asked = saved(rows.where("__q").select("__id", "__a", "__b").distinct(), "vector-queries")
    total = classes.count()
    wanted = F.pmod(F.xxhash64("__b", "__a"), F.lit(1 << 30)) < int(min(1.0, 0.95 * MAX_SAMPLE / max(1, total)) * (1 << 30))
    sample = classes.where(wanted).orderBy("__a", "__b").limit(MAX_SAMPLE).select("__v").toArrow()["__v"]
    result = f"query_id {dict(rows.dtypes)['__id']}, rank int, `{id_col}` {dict(rows.dtypes)['__id']}, score double"
    if not len(sample):
        return spark.createDataFrame([], result)
    centres, visits = fit(matrix(sample), min(max_lists, max(1, round(total**0.5))), k)

    def listed(batches):
        for batch in batches:
            own = np.argmax(unit(matrix(batch["__v"])) @ centres.T, axis=1).astype(np.int32)
            yield batch.append_column("__list", pa.array(own))
        give_back()

    kind = dict(classes.dtypes)
    index = saved(classes.mapInArrow(listed, f"__a long, __b long, __v {kind['__v']}, __ids {kind['__ids']}, __list int"), "vector-lists")
    held = np.zeros(len(centres), np.int64)
    for r in index.groupBy("__list").agg(F.count("*").alias("n")).collect():  # a row a list
        held[r["__list"]] = r["n"]

    def visiting(batches):
        """A row for each list that a query visits: the nearest ones, and more until they hold enough vectors."""
        for batch in batches:
            order = np.argsort(-(unit(matrix(batch["__v"])) @ centres.T), axis=1, kind="stable")
            upto = np.cumsum(held[order], axis=1) - held[order]  # vectors in the lists before
            at, rank = np.nonzero(((np.arange(len(centres))[None] < visits) | (upto < 64 * (k + 1))) & (held[order] > 0))
            for s in range(0, len(at), 1024):
                part = batch.take(pa.array(at[s : s + 1024]))
                yield part.append_column("__list", pa.array(order[at[s : s + 1024], rank[s : s + 1024]].astype(np.int32)))
        give_back()

    ask = classes.join(asked.select("__a", "__b").distinct(), ["__a", "__b"], "left_semi").select("__a", "__b", "__v")
    visits_of = saved(ask.mapInArrow(visiting, f"__a long, __b long, __v {kind['__v']}, __list int"), "vector-visits")
    asks = np.zeros(len(centres), np.int64)
    for r in visits_of.groupBy("__list").agg(F.count("*").alias("n")).collect():
        asks[r["__list"]] = r["n"]
    parts = {"__slots": -(-held // LIST_ROWS), "__turns": -(-asks // QUERY_ROWS)}
    sizes = spark.createDataFrame(pa.table({"__list": pa.array(np.arange(len(centres), dtype=np.int32)), **{c: np.maximum(1, n) for c, n in parts.items()}}))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod("__b", F.col(n))
    left = index.join(F.broadcast(sizes), "__list").withColumn("__slot", deal("__slots")).withColumn("__turn", every("__turns"))
    right = visits_of.join(F.broadcast(sizes), "__list").withColumn("__turn", deal("__turns")).withColumn("__slot", every("__slots"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return out.empty_table()
        v, q = matrix(left["__v"]), matrix(right["__v"])
        i, j = scan(unit(q), unit(v), k + 1)
        score = np.concatenate([cosine(q[i[s : s + PAIRS]], v[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])
        least = left["__ids"].combine_chunks()
        smallest = least.flatten().to_numpy()[np.asarray(least.offsets)[:-1] - least.offsets[0].as_py()]
        order = np.lexsort((smallest[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = i[place <= k], j[place <= k], score[place <= k]
        return pa.table([right["__a"].take(pa.array(i)), right["__b"].take(pa.array(i)), pa.array(score), left["__ids"].take(pa.array(j))], schema=out)

    ids = pa.list_(pa.int64())
    out = pa.schema([("__a", pa.int64()), ("__b", pa.int64()), ("score", pa.float64()), ("__ids", ids)])
    by = ["__list", "__slot", "__turn"]
    met = left.select(*by, "__v", F.col("__ids").cast("array<bigint>").alias("__ids")).groupBy(*by).cogroup(right.select(*by, "__a", "__b", "__v").groupBy(*by))
    met = met.applyInArrow(compare, "__a long, __b long, score double, __ids array<bigint>")
    # the best of each visit meet, and only as many of them as can be results
    best = lambda *ties: Window.partitionBy("__a", "__b").orderBy(F.desc("score"), *ties)
    top = met.withColumn("__r", F.row_number().over(best("__ids"))).where(F.col("__r") <= k + 1).drop("__r")
    pair = F.struct((-F.col("score")).alias("s"), F.col("__found").alias("i"))
    near = top.withColumn("__found", F.explode("__ids")).groupBy("__a", "__b", "__found").agg(F.max("score").alias("score"))
    near = near.groupBy("__a", "__b").agg(F.array_sort(F.collect_list(pair)).alias("__near"))
    each = asked.join(near, ["__a", "__b"]).select(F.col("__id").alias("query_id"), F.inline(F.filter("__near", lambda x: x["i"] != F.col("__id"))))
    # an id with several vectors has several classes; else there is one row of a query and a result
    each = each.groupBy("query_id", "i").agg(F.min("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("s", "i"))
    each = each.withColumn("rank", rank).where(F.col("rank") <= k)
    kind_of_id = dict(rows.dtypes)["__id"]
    return each.select("query_id", "rank", F.col("i").cast(kind_of_id).alias(id_col), (-F.col("s")).alias("score"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the five nearest of every vector whose id is divisible by 50, by ``nearest``."""
    return nearest(table(tuned(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
