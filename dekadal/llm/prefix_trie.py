"""Conversation prefix trie: which conversations begin alike, and how many tokens their shared prefixes save.

A prefix of d turns is known by its digest, the xor of 128-bit hashes of its turns, each bound to its place. A count-min
sketch of all digests proves that a prefix has one conversation alone where its estimate is one; whatever follows is that
conversation's own too, so tails are made where they are. Only prefixes that may be shared are shuffled and grouped.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._sketch import perhaps_repeated, sketch
from ._text import saved, table, tuned

#: Places of a conversation that one task orders or sums at once; a longer conversation is dealt over several.
PIECE_BITS = 12
#: Conversations whose ids are a multiple of this many lend their first turns to those that follow.
FAMILY, LENT = 20, 4
#: Bytes of a piece of a list of ids.
ID_BYTES = 1 << 16
NO_IDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "a", "b"]


def n_words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``, without a list of them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def running(rows: DataFrame, order: str, sums: dict[str, Column], merge, back: bool = False, inclusive: bool = True) -> DataFrame:
    """Columns with a running aggregate by conversation (conv) over order, a long from 0: over the rows up to each, its peers
    included, or backwards; not inclusive, over the rows before it (then orders differ). merge is the aggregate, which must
    have a way of its own to go on: its value over pieces is its value over their values.

    A conversation is summed in pieces of places, and pieces start from the aggregate of those before, so no conversation
    is one task's, however long it is.
    """
    rows = rows.withColumn("__piece", F.shiftright(order, PIECE_BITS))
    by = (F.desc if back else F.asc)
    inner = Window.partitionBy("conv", "__piece").orderBy(by(order))
    inner = inner.rangeBetween(Window.unboundedPreceding, 0) if inclusive else inner.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv").orderBy(by("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "__piece").agg(*[merge(c).alias(f"__t_{k}") for k, c in sums.items()])
    totals = totals.select("conv", "__piece", *[merge(f"__t_{k}").over(before).alias(f"__b_{k}") for k in sums]).where(" or ".join(f"__b_{k} is not null" for k in sums))
    both = rows.withColumns({f"__i_{k}": merge(c).over(inner) for k, c in sums.items()}).join(totals, ["conv", "__piece"], "left")
    joined = {k: _merged(merge, F.coalesce(f"__i_{k}", F.lit(0).cast("long")), F.coalesce(f"__b_{k}", F.lit(0).cast("long"))) for k in sums}
    return both.withColumns(joined).drop("__piece", *[f"__i_{k}" for k in sums], *[f"__b_{k}" for k in sums])


def _merged(merge, x: Column, y: Column) -> Column:
    return {F.bit_xor: x.bitwiseXOR(y), F.bit_or: x.bitwiseOR(y), F.sum: x + y}[merge]


def placed(convs: DataFrame) -> DataFrame:
    """(conv, place, u, v, words) of all turns of conversations with an id: place counts from 0 by turn, nulls first; u and v
    are hashes of role and text. Turns alike are ordered by role and text; texts are shuffled for those alone that share
    a turn and differ."""
    turns = convs.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    turns = turns.withColumns({"u": F.xxhash64("role", "text"), "v": F.xxhash64(F.lit(1), "text", "role"), "none": F.col("turn").isNull(), "at": F.coalesce("turn", F.lit(0).cast("long"))})
    short = saved(turns.select("conv", "none", "at", "u", "v", n_words(F.col("text")).alias("words")), "trie-turns")
    same = ["conv", "none", "at"]
    tied = saved(short.groupBy(*same).agg(F.min("u") != F.max("u"), F.min("v") != F.max("v")).toDF(*same, "x", "y").where("x or y").select(*same), "trie-ties")
    short = short.withColumn("tie", F.lit(0))
    if not tied.isEmpty():
        rank = F.dense_rank().over(Window.partitionBy(*same).orderBy("role", "text"))
        ties = turns.join(tied, same, "left_semi").select(*same, "u", "v", rank.alias("__tie")).distinct()
        short = short.join(ties, [*same, "u", "v"], "left").withColumn("tie", F.coalesce("__tie", F.lit(0))).drop("__tie")
    # the place within a piece of turn numbers, after the turns of the pieces before
    piece = F.when(F.col("none"), F.lit(-(1 << 52))).otherwise(F.shiftright("at", PIECE_BITS))
    short = short.withColumn("__piece", piece)
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = short.groupBy("conv", "__piece").agg(F.count("*").alias("n")).select("conv", "__piece", before.alias("__start")).where("__start is not null")
    inner = F.row_number().over(Window.partitionBy("conv", "__piece").orderBy("at", "tie"))
    rows = short.withColumn("__i", inner).join(starts, ["conv", "__piece"], "left")
    return rows.select("conv", (F.col("__i") - 1 + F.coalesce("__start", F.lit(0))).alias("place"), "u", "v", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, place, u, v, words) of the rebuilt conversations, (conv, length) of all). turns: as placed makes them, saved.

    Conversation c begins with the first h turns of conversation c - c % 20, where h = crc32(c in decimal) % 4, as far as
    that has them, and goes on with its own turns from its h-th on.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"lender": F.col("conv") - F.col("conv") % FAMILY, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % LENT})
    head = F.array_sort(F.collect_list(F.struct("place", "u", "v", "words"))).alias("head")  # at most three
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("place") < LENT - 1)).groupBy(F.col("conv").alias("lender")).agg(head)
    convs = convs.join(heads, "lender", "left").withColumn("lent", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    length = (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    convs = saved(convs.select("conv", "h", "lent", length, F.when(F.col("lent") > 0, F.slice("head", F.lit(1), F.col("lent").cast("int"))).alias("head")), "trie-convs")
    first = convs.select("conv", "length", F.inline("head")).select("conv", "length", "place", "u", "v", "words")
    rest = turns.join(convs.select("conv", "h", "lent", "length"), "conv").where("place >= h").select("conv", "length", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "u", "v", "words")
    return first.unionByName(rest), convs.select("conv", "length")


def id_hashes(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of the comma-joined ascending ids (conv) of each node. Ids are sorted by range over all
    tasks and joined in pieces there; the pieces of one node follow each other through one task, in constant memory, since
    a hash is one chain."""
    out = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def join(batches):
        node, first, ids, size = None, 0, [], 0
        made: list = []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node or size > ID_BYTES:
                    if ids:
                        made.append((*node, first, ",".join(ids)))
                    node, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], schema=out)
                made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, first, ",".join(ids))], schema=out)

    done = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])

    def digest(batches):
        node, state = None, None
        made: list = []
        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if state:
                        made.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], schema=done)
                made = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], schema=done)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.select(*KEY, "conv").repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = ranged.mapInArrow(join, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, a long, b long, ends string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node of the trie
    of rebuilt conversations.

    Rows with a null conv_id take no part; null roles and texts are empty; null turns come first; rows of one turn are
    ordered by role, then text, and repeated rows are turns each; an empty table has no nodes, not even a root. Texts may be
    of any length: what is kept of one is two hashes and a number of words.

    No conversation, node or family is one task's: long conversations are dealt in pieces, counts of nodes combine before
    they are shuffled, and joins by node have a unique side, so that the adaptive skew join can split the other. What a
    node sums over its subtree each node below gives to its least member, and every node sums that over its members.
    """
    zero = F.lit(0).cast("long")
    turns, lengths = rebuilt(saved(placed(convs), "trie-places"))
    own = turns.withColumns({"g": F.xxhash64("place", "u", "v"), "k": F.xxhash64(F.lit(1), "v", "place", "u")})
    rows = running(own, "place", {"a": F.col("g"), "b": F.col("k")}, F.bit_xor)
    rows = rows.select(
        "conv", (F.col("place") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("g")).alias("pa"), F.col("b").bitwiseXOR(F.col("k")).alias("pb"), "words",
        (F.col("place") + 1 == F.col("length")).alias("last"),
    )
    rows = saved(rows, "trie-rows")
    # the sketch's verdict holds for all that follows
    rows = perhaps_repeated(rows, sketch(rows, "a", "b"), "a", "b", "perhaps").withColumn("alone", (~F.col("perhaps")).cast("long"))
    rows = running(rows, "depth", {"before": F.col("alone")}, F.bit_or, inclusive=False)
    rows = saved(rows.withColumns({"tail": F.col("alone").bitwiseOR(F.col("before")) == 1, "first": (F.col("before") == 0) & (F.col("alone") == 1)}).drop("perhaps", "alone", "before"), "trie-marked")
    shared, tails = rows.where("not tail"), rows.where("tail")
    nodes = shared.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.count_if("last").alias("n_ends"), F.first("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb")
    )
    nodes = saved(nodes, "trie-nodes")
    # what each node and tail gives to its least member, summed over that member's prefixes
    given = nodes.select("conv", "depth", ((F.col("n") - 1) * F.col("words")).alias("saves"), (F.col("n_ends") == F.col("n")).cast("long").alias("leaf"))
    given = given.unionByName(tails.where("first").select("conv", "depth", zero.alias("saves"), F.lit(1).cast("long").alias("leaf")))
    chain = shared.select("conv", *KEY, zero.alias("saves"), zero.alias("leaf")).unionByName(given, allowMissingColumns=True)
    chain = running(chain, "depth", {"saves": F.col("saves"), "leaf": F.col("leaf")}, F.sum, back=True).where("a is not null")
    sums = chain.groupBy(*KEY).agg(F.sum("saves").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    inner = nodes.join(sums, KEY).select("conv", *KEY, "pa", "pb", "n", "n_ends", "n_leaves", "saved_tokens")
    beneath = [F.col("depth") - 1, F.col("pa"), F.col("pb")]
    kids = nodes.select(*beneath).union(tails.where("first").select(*beneath)).toDF(*KEY).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    turnless = lengths.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv")
    ends = id_hashes(saved(shared.where("last").select(*KEY, "conv").unionByName(turnless), "trie-ends"))
    inner = inner.join(kids, KEY, "left").join(ends, KEY, "left")
    # parents: the least member of the node above, or of all
    root = lengths.agg(F.min("conv").alias("__least"), F.count("*").alias("__all"))  # one row
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("__above"))
    alone = {"n": 1, "n_leaves": 1, "saved_tokens": 0}
    single = tails.select("conv", "depth", "pa", "pb", "first", *[F.lit(v).cast("long").alias(k) for k, v in alone.items()], (~F.col("last")).cast("long").alias("n_children"), F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).alias("ends"))
    columns = ["conv", "depth", "n", "n_children", "n_leaves", "saved_tokens", "ends"]
    joint = inner.unionByName(single.where("first").drop("first"), allowMissingColumns=True).join(above, ["depth", "pa", "pb"], "left").crossJoin(F.broadcast(root))
    joint = joint.select(*columns, F.coalesce("__above", "__least").alias("parent"))
    below = single.where("not first").select(*columns, F.col("conv").alias("parent"))
    every = joint.unionByName(below).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")
    )
    every = saved(every, "trie")
    top = every.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ended = saved(ends.where("depth = 0").select("ends"), "trie-root")
    top = root.where("__all > 0").crossJoin(F.broadcast(top)).join(F.broadcast(ended), F.lit(True), "left")
    top = top.select(
        F.col("__least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("__all").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    return every.unionByName(top)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, by ``prefix_trie``."""
    return prefix_trie(table(tuned(spark), sf_dir, "conversations"))


#: The same by plain SQL, with whole prefixes as keys. The table of CRC-32 is made by its rule.
SQL = r"""
    WITH k0 AS (SELECT i, i AS v FROM range(256) t(i)), """ + ", ".join(
    f"k{n + 1} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM k{n})" for n in range(8)
) + r""",
    crc AS (SELECT list(v ORDER BY i) AS t FROM k8),
    o AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT c, l, c - c % 20 AS p, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda r, x: xor(r >> 8, t[xor(r & 255, x) + 1])), 4294967295) % 4 AS h FROM o, crc),
    b AS (SELECT h.c, list_concat(coalesce(o.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.p),
    x AS (SELECT c, d, l[1:d] AS k, d = len(l) AS last FROM b, range(0, len(l) + 1) r(d)),
    n AS (SELECT d, k, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends,
                 CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saves FROM x GROUP BY d, k),
    q AS (SELECT n.*, m.c AS parent, (SELECT count(*) FROM n s WHERE s.d = n.d + 1 AND s.k[1:n.d] = n.k) AS kids FROM n LEFT JOIN n m ON m.d = n.d - 1 AND m.k = n.k[1:n.d - 1]),
    u AS (SELECT e AS d, k[1:e] AS k, count(*) FILTER (kids = 0) AS leaves, sum(saves) AS saves FROM q, range(0, d + 1) r(e) GROUP BY e, k[1:e])
    SELECT q.c AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, u.leaves AS n_leaves, u.saves::BIGINT AS saved_tokens, ends AS ends_sha256 FROM q JOIN u USING (d, k)
"""
