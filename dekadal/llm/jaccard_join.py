"""N-gram Jaccard join: grouped prefix join on sets of word shingles.

1. Documents with equal sets are one set from here on (its members are expanded at the end).
2. A set that links with another shares all but a tenth of its shingles with it (at 0.9; Rule has the general form).
   Shingles of one set alone rule out the sets that have more of them. They are counted first over a hashed share of the
   shingles, a tenth more than a set may lack, and then over all shingles of the sets that are left.
3. The order of shingles is: those of one set alone, then by hash, then the most frequent ones, by frequency. Two sets that
   link share a shingle of their prefixes, the first n // 10 + 1 in that order, at places that leave enough behind.
4. Sets with the same prefix and size are one group. Group pairs that share a prefix shingle pass the size and place
   filters and one by parity: a set's bitmap holds the parity of its shingles in each of 512 hash classes, so two bitmaps
   differ in no more bits than the sets do in shingles (for groups: in the bits on which their members agree). The pairs'
   members pass the same filter, and what is left is verified exactly.
5. A large family of near copies would give pairs with its square. So each group's members, and each shingle's sets,
   are first verified against one or a few of them (stars). What the stars connect needs no further pairs: the full join
   looks only at members of different components, so no link between components is lost. Where it would still make many
   pairs, more stars come first, around several members of each shingle's largest component.
6. A shingle that comes late in a prefix joins its set with smaller ones only, so a pair has it early in one set at least;
   late places meet early ones alone. A family that shares most of its text, but whose members each have too much of their
   own, has its shared shingles late, and makes no pairs.
7. Keys that many sets have: frequent shingles come last, and so into the prefixes of sets only that have little else;
   the join by shingle is dealt by size band too, since only neighbouring bands can link; the members of a star are dealt
   over as many copies of its centre as their number asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import LOWER, NOT_SPACE, having, id_filter, lacking, map_texts, mix, ngrams, passing, run_hashes, runs, saved, table, tuned
from .components import connected_components

#: Longs of a parity bitmap, and of the one folded from it that rides along with every posted shingle.
WORDS, FOLDED = 8, 4
#: Shingles of at least so many sets are ordered by their frequency, the most frequent FREQUENT of them at most: they go
#: to the driver and the tasks, 16 bytes each. Any order gives the same result; this one keeps shared passages last.
COMMON, FREQUENT = 16, 1 << 18
#: Pairs that the full join may look at for each posted shingle, on average, before more stars are drawn; rounds of such
#: stars, and centres of a round. What they leave open is the full join's, whatever its size.
DENSE, ROUNDS, CENTRES = 32, 1, 8
#: Members that are verified against one copy of a star's centre.
STAR = 500


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of so many words link from a Jaccard similarity of percent / 100 on. They share at least
    percent / (100 + percent) of the sum of their sizes, and so differ in at most (100 - percent) / (100 + percent) of it."""

    words: int
    percent: int

    def places(self) -> str:
        """Sizes are near, and both sets have enough shingles from the shared one on."""
        left = f"{100 + self.percent} * least(n1 - at1, n2 - at2) >= {self.percent} * (n1 + n2)"
        return f"100 * least(n1, n2) >= {self.percent} * greatest(n1, n2) AND {left}"

    def early(self) -> str:
        """A posted shingle's place (at, of n) leaves enough behind for a set of the same size or more. One that comes later
        joins smaller sets only, so two such can never both be right: of a pair, one place at least is early."""
        return f"{100 + self.percent} * (n - at) >= {2 * self.percent} * n"

    def parity(self, bits: list[str]) -> str:
        """The bits that differ are no more than the shingles that may."""
        return f"{100 + self.percent} * ({' + '.join(f'bit_count({b})' for b in bits)}) <= {100 - self.percent} * (n1 + n2)"

    def band(self, n: str) -> Column:
        """Sizes by a rising scale: a set links with sets of its own band and the next ones only."""
        return F.floor(F.log(F.col(n)) / np.log(100.001 / self.percent)).cast("int")


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets. A document of fewer words has one shingle,
    its whole sequence; one without words has none."""
    low = LOWER[buf]
    starts, ends, wo = runs(low, offs, NOT_SPACE)
    h = run_hashes(low, starts, ends)
    size = np.diff(wo)
    g = ngrams(h, n)
    doc = np.repeat(np.arange(len(size)), size)
    inside = doc[n - 1 :] == doc[: len(doc) - n + 1] if len(doc) >= n else np.zeros(0, bool)
    docs, got = [doc[: len(g)][inside]], [g[inside]]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            v = np.full(len(short), k, np.uint64)
            for j in range(k):
                v = mix(v + h[wo[short] + j] * np.uint64(2 * j + 3))
            docs.append(short)
            got.append(v)
    doc, g = np.concatenate(docs), np.concatenate(got).astype(np.int64)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    doc, g = doc[new], g[new]
    return g, np.searchsorted(doc, np.arange(len(offs)))


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value per set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).astype(np.int64)


def sampled(buf: np.ndarray, offs: np.ndarray, rule: Rule) -> dict:
    """Size and fingerprint of each set, and its shingles of the first count."""
    sets, at = shingle_sets(buf, offs, rule.words)
    own = sets.astype(np.uint64) % np.uint64(100) < np.uint64(min(100, 110 - rule.percent))
    counted = np.concatenate([[0], np.cumsum(own)])
    return {"n": np.diff(at), "fp": fingerprints(sets, at), "shingles": pa.ListArray.from_arrays(counted[at].astype(np.int32), pa.array(sets[own]))}


def parities(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """Per set, WORDS longs of parity bits."""
    docs, width = len(at) - 1, 64 * WORDS
    doc = np.repeat(np.arange(docs), np.diff(at))
    odd = np.bincount(doc * width + (mix(sets.astype(np.uint64)) % np.uint64(width)).astype(np.int64), minlength=docs * width) & 1
    longs = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, docs * WORDS + 1, WORDS, dtype=np.int32), pa.array(longs))


def whole(buf: np.ndarray, offs: np.ndarray, n: int = 3) -> dict:
    sets, at = shingle_sets(buf, offs, n)
    return {"fp": fingerprints(sets, at), "bits": parities(sets, at), "shingles": pa.ListArray.from_arrays(at.astype(np.int32), pa.array(sets))}


def whole_sets(docs: DataFrame, live: DataFrame, id_col: str, text: str, n: int = 3) -> DataFrame:
    """(__id, fp, bits, shingles) of the documents whose id an id filter of the live sets lets pass: all of those, and
    a few others, which the join by id and fingerprint drops later. No text is shuffled."""
    few = passing(docs, id_col, id_filter(live.select(F.col("__rep").alias(id_col)), id_col))
    sets = map_texts(few, "fp long, bits array<bigint>, shingles array<bigint>", partial(whole, n=n), [id_col], text)
    return sets.withColumnRenamed(id_col, "__id")


def lonely(sets: DataFrame) -> DataFrame:
    """(fp, shingle): shingles that one set alone has."""
    rows = sets.select("fp", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"))
    return rows.where("fp = other").select("fp", "shingle")


def counted(sets: DataFrame) -> DataFrame:
    """(shingle, fp, n_sets) of the shingles that one set alone has (fp), and of those that COMMON sets have (null).
    Counts combine before the shuffle, so common shingles are no hot keys."""
    rows = sets.select("fp", F.explode("shingles").alias("shingle")).groupBy("shingle")
    rows = rows.agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.count("*").alias("n_sets"))
    own = F.when(F.col("fp") == F.col("other"), F.col("fp"))
    return rows.select("shingle", own.alias("fp"), "n_sets").where(f"fp is not null or n_sets >= {COMMON}")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their frequencies: all from that power of two on from which there are no
    more than FREQUENT."""
    common = counts.where("fp is null")
    sizes = dict(common.groupBy(F.floor(F.log2("n_sets")).cast("int").alias("k")).count().collect())
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > FREQUENT:
            break
        least = k
    got = common.where(F.col("n_sets") >= F.lit(2.0**least)).select("shingle", "n_sets").toPandas().sort_values("shingle")
    return got["shingle"].to_numpy(np.int64), got["n_sets"].to_numpy(np.int64)


def prefixes(near: DataFrame, rule: Rule, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(fp, n, alone, bits, prefix): the first shingles of each set in the order that all sets share, without those that
    it has alone, which come before them."""
    shared = near.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known, n_sets = shared.value
        for batch in batches:
            sets, own = batch.column(4), batch.column(5)
            at = np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])
            docs = np.repeat(np.arange(len(batch)), np.diff(at))
            own_docs = np.repeat(np.arange(len(batch)), np.diff(own.offsets.to_numpy()))
            values = sets.flatten().to_numpy()
            tell = lambda v, d: mix(v.view(np.uint64) ^ mix(d.astype(np.uint64) + np.uint64(1)))
            rest = ~np.isin(tell(values, docs), tell(own.flatten().to_numpy(), own_docs))
            values, docs = values[rest], docs[rest]
            often = np.zeros(len(values), np.int64)
            if len(known):
                slot = np.minimum(np.searchsorted(known, values), len(known) - 1)
                often = np.where(known[slot] == values, n_sets[slot], 0)
            order = np.lexsort((values, often, docs))
            values, docs = values[order], docs[order]
            first = np.searchsorted(docs, np.arange(len(batch)))
            n, alone = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            size = np.minimum((100 - rule.percent) * n // 100 + 1 - alone, np.diff(np.append(first, len(values))))
            ends = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
            prefix = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values[take]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], prefix], names=["fp", "n", "alone", "bits", "prefix"])

    rows = near.select("fp", "n", "alone", "bits", "shingles", "own")
    return rows.mapInArrow(run, "fp long, n long, alone long, bits array<bigint>, prefix array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) of sets that link, by exact intersection. Sets in no pair stay where they are; y's shingles are
    joined first, and then dealt over copies of x's, one for STAR of its pairs."""
    copies = saved(pairs.groupBy("x").agg(F.ceil(F.count("*") / STAR).alias("copies")), "join-centres")
    dealt = pairs.join(copies, "x").withColumn("deal", F.pmod(F.xxhash64("y"), F.col("copies")))
    other = passing(sets, "fp", id_filter(pairs.select(F.col("y").alias("fp")), "fp"))
    other = other.select(F.col("fp").alias("y"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    centre = passing(sets, "fp", id_filter(copies.select(F.col("x").alias("fp")), "fp")).withColumnRenamed("fp", "x").join(copies, "x")
    centre = centre.select("x", F.col("n").alias("n1"), F.col("shingles").alias("s1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("deal"))
    both = F.size(F.array_intersect("s1", "s2")).cast("long")
    rows = dealt.drop("copies").join(other, "y").join(centre, ["x", "deal"]).select("x", "y", (F.col("n1") + F.col("n2")).alias("n"), both.alias("both"))
    return rows.where(f"100 * both >= {rule.percent} * (n - both)").select("x", "y").distinct()


def live_sets(first: DataFrame, id_col: str, rule: Rule) -> DataFrame:
    """(__rep, fp, n) of the sets that a first count does not rule out: the least id, fingerprint and size."""
    less = 100 - rule.percent
    alone = lonely(first).groupBy("fp").agg(F.count("*").alias("alone"))
    # two different sets link only from sizes m and m + 1 on with m / (m + 1) >= percent / 100: 9 and 10 at 90
    large = first.where(f"{less} * n >= {rule.percent}").groupBy("fp").agg(F.min(id_col).alias("__rep"), F.first("n").alias("n"))
    return large.join(alone, "fp", "left").where(f"100 * coalesce(alone, 0) <= {less} * n").select("__rep", "fp", "n")


def near_sets(sets: DataFrame, live: DataFrame, counts: DataFrame, rule: Rule) -> DataFrame:
    """(fp, n, alone, bits, shingles, own) of the sets that the whole count does not rule out; own: shingles that no other
    set has. A set comes as often as its least id repeats."""
    own = counts.where("fp is not null").groupBy("fp").agg(F.collect_list("shingle").alias("own"))
    known = live.join(own, "fp", "left").withColumn("own", F.coalesce("own", F.expr("cast(array() as array<bigint>)")))
    known = known.withColumn("alone", F.size("own").cast("long")).where(f"100 * alone <= {100 - rule.percent} * n")
    known = saved(known, "join-known")
    return passing(sets, "fp", id_filter(known, "fp")).join(known, "fp").where("__id <=> __rep").select("fp", "n", "alone", "bits", "shingles", "own")


def grouped(heads: DataFrame) -> DataFrame:
    """A row for each set of heads, with g, the least fingerprint of those with the same prefix and size."""
    key = ["n", "alone", "key"]
    heads = heads.dropDuplicates(["fp"]).withColumn("key", F.xxhash64("prefix"))
    return heads.join(heads.groupBy(*key).agg(F.min("fp").alias("g")), key).drop("key")


def folded(bits: str) -> list[Column]:
    """The FOLDED longs of a bitmap's parity in fewer classes."""
    return [F.expr(" ^ ".join(f"{bits}[{i}]" for i in range(k, WORDS, FOLDED))).alias(f"b{k}") for k in range(FOLDED)]


def star_pairs(rows: DataFrame, rule: Rule, seeds: range) -> DataFrame:
    """(x, y): each shingle's sets outside its largest component with some of that one, as many as there are
    seeds. A seed orders all sets alike, and the sets of a family agree on most of their shingles, and so on few
    centres."""
    slim = ["c", "g", "n", "at", *[f"b{k}_" for k in range(FOLDED)]]
    rows = rows.withColumnsRenamed({f"b{k}": f"b{k}_" for k in range(FOLDED)})
    best = [F.max(F.struct("size", F.xxhash64("g", F.lit(i)).alias("order"), *slim)).alias(f"o{i}") for i in seeds]
    centre = rows.groupBy("shingle").agg(*best).select("shingle", F.explode(F.array(*[f"o{i}" for i in seeds])).alias("o"))
    centre = centre.select("shingle", *[F.col(f"o.{c}").alias(f"{c}1") for c in slim])
    both = rows.where("other").select("shingle", *[F.col(c).alias(f"{c}2") for c in slim]).join(centre, "shingle")
    parity = rule.parity([f"(b{k}_1 ^ b{k}_2)" for k in range(FOLDED)])
    return both.where(f"c1 <> c2 AND {rule.places()} AND {parity}").select(F.col("g1").alias("x"), F.col("g2").alias("y")).distinct()


def open_postings(posted: DataFrame, inside: DataFrame) -> DataFrame:
    """The posted shingles whose groups the stars left in several components. Of each group: its least and greatest
    component, the parity bits of all its members (a) and those on which they agree (e), its first one's component (c), that
    one's size, and whether it is outside the shingle's largest component (top), in part at least (other)."""
    ands, ors = ([F.expr(f"{f}(b{k})").alias(f"{f}{k}") for k in range(FOLDED)] for f in ("bit_and", "bit_or"))
    span = inside.select("g", "c", *folded("bits")).groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), *ands, *ors)
    agree = [F.expr(f"~(bit_and{k} ^ bit_or{k})").alias(f"e{k}") for k in range(FOLDED)]
    sizes = inside.groupBy("c").agg(F.count("*").alias("size"))
    heads = inside.where("fp = g").select("g", "c").join(sizes, "c")
    span = span.select("g", "low", "high", *[F.col(f"bit_and{k}").alias(f"a{k}") for k in range(FOLDED)], *agree).join(heads, "g")
    span = saved(span, "join-spans")
    slim = posted.select("shingle", "g").join(span.select("g", "low", "high", "c", "size"), "g")
    mixed = slim.groupBy("shingle").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.max(F.struct("size", "c")).alias("top")).where("a < b")
    other = (F.expr("c <> top.c OR low <> high")).alias("other")
    return posted.join(mixed, "shingle").join(span, "g").select(*posted.columns, *span.drop("g").columns, other, F.col("top.c").alias("top"))


def open_sets(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """The open postings by set instead of by group: with each set's own name (g), bits and component."""
    sizes = inside.groupBy("c").agg(F.count("*").alias("size"))
    sets = inside.join(sizes, "c").select(F.col("g").alias("group"), F.col("fp").alias("g"), "c", "size", *folded("bits"))
    each = rows.select("shingle", F.col("g").alias("group"), "n", "at", "top").join(sets, "group")
    return each.withColumn("other", F.col("c") != F.col("top")).drop("group", "top")


def open_pairs(rows: DataFrame, inside: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): sets of different components whose groups share a posted shingle, and that all filters let pass. Of two
    groups that a shingle joins, one at least is outside its largest component, and one at least has it early; they are
    dealt by size band too. So texts that share most shingles, but have a tenth of them from elsewhere, never meet."""
    slim = ["g", "n", "at", "low", "high", *[f"{c}{k}_" for c in "ae" for k in range(FOLDED)]]
    rows = rows.withColumnsRenamed({f"{c}{k}": f"{c}{k}_" for c in "ae" for k in range(FOLDED)}).withColumn("band", rule.band("n"))
    one, two = (rows.select("shingle", "band", "early", "other", *[F.col(c).alias(f"{c}{i}") for c in slim]) for i in (1, 2))
    either = F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    one = one.where("other").drop("other").withColumn("early", F.explode(either)).withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    parity = rule.parity([f"((a{k}_1 ^ a{k}_2) & e{k}_1 & e{k}_2)" for k in range(FOLDED)])
    once = "(NOT other OR g1 <= g2) AND least(low1, low2) < greatest(high1, high2)"
    met = one.join(two, ["shingle", "early", "band"]).where(f"{once} AND {rule.places()} AND {parity}")
    groups = met.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).distinct()
    side = lambda i, name: inside.select(F.col("fp").alias(name), *[F.col(c).alias(f"{c}{i}") for c in ("g", "c", "n", "bits")])
    exact = rule.parity([f"(bits1[{i}] ^ bits2[{i}])" for i in range(WORDS)])
    pairs = groups.join(side(1, "x"), "g1").join(side(2, "y"), "g2")
    return pairs.where(f"c1 <> c2 AND (g1 <> g2 OR x < y) AND {exact}").select("x", "y").distinct()


def links(docs: DataFrame, id_col: str, text: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(id, n, fp) per row, and (fp, component) of the sets that link with a different one."""
    schema = "n long, fp long, shingles array<bigint>"
    first = saved(map_texts(docs, schema, partial(sampled, rule=rule), [id_col], text), "join-first")
    rows = first.select(id_col, "n", "fp")
    live = saved(live_sets(first, id_col, rule), "join-live")
    sets = saved(whole_sets(docs, live, id_col, text, rule.words), "join-sets")
    counts = saved(counted(sets), "join-counts")
    near = saved(near_sets(sets, live, counts, rule), "join-near")
    members = saved(grouped(prefixes(near, rule, frequent(counts))), "join-members")
    at = F.col("alone") + F.col("place")
    posted = members.where("fp = g").select("g", "n", "alone", *folded("bits"), F.posexplode("prefix").alias("place", "shingle"))
    posted = posted.select("shingle", "g", "n", at.alias("at"), *[f"b{k}" for k in range(FOLDED)]).withColumn("early", F.expr(rule.early()))
    posted = saved(posted, "join-posted")

    own = members.where("fp <> g").select(F.col("g").alias("x"), F.col("fp").alias("y"))
    alone = [F.col("fp").alias("g"), F.col("fp").alias("c"), F.lit(1).alias("size"), F.lit(True).alias("other")]
    each = members.select(*alone, "n", "alone", *folded("bits"), F.posexplode("prefix").alias("place", "shingle")).withColumn("at", at)
    pairs = own.union(star_pairs(each, rule, range(CENTRES // 2))).distinct()
    edges = saved(verified(saved(pairs, "join-star"), near, rule), "join-star-edges")
    for turn in range(1, ROUNDS + 2):
        known = connected_components(edges)
        inside = members.select("fp", "g", "n", "bits").join(known, F.col("fp") == F.col("node"), "left")
        inside = saved(inside.select("fp", "g", "n", "bits", F.coalesce("component", "fp").alias("c")), "join-inside")
        open_ = saved(open_postings(posted, inside), "join-open")
        sizes = {"n": "true", "early": "early", "others": "other and early", "late": "other and not early"}
        load = open_.groupBy("shingle").agg(*[F.count_if(F.expr(c)).alias(k) for k, c in sizes.items()])
        n_rows, n_pairs = load.agg(F.sum("n"), F.sum(F.col("n") * F.col("others") + F.col("early") * F.col("late"))).first()
        if not n_rows:
            return rows, known.withColumnRenamed("node", "fp")
        if n_pairs <= DENSE * n_rows or turn > ROUNDS:
            break
        more = saved(verified(saved(star_pairs(open_sets(open_, inside), rule, range(CENTRES * turn, CENTRES * (turn + 1))), "join-star"), near, rule), "join-star-edges")
        if more.isEmpty():
            break
        edges = saved(edges.union(more), "join-edges")
    more = saved(verified(saved(open_pairs(open_, inside, rule), "join-rest"), near, rule), "join-rest-edges")
    if more.isEmpty():
        return rows, known.withColumnRenamed("node", "fp")
    return rows, connected_components(edges.union(more)).withColumnRenamed("node", "fp")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) per row: sets of shingles of so many words link from a Jaccard similarity of percent
    / 100 on.

    component_id is the smallest id that links reach; sets of the same similarity need no tie to be broken. Null texts,
    and texts without words, have no shingles, link with nothing and keep their own id. A row with a null id takes part
    like others, and its component's smallest id is that of the rows that have one (null if none has). Repeated rows stay,
    each in the component of its set; an empty table gives none; extra columns are not read. A very long text is one set:
    it is built in one task, in memory of some 80 bytes a word. Shingles are 64-bit hashes of their words, sets 64-bit
    fingerprints.
    """
    rows, component = links(docs, id_col, text, Rule(words, percent))
    named = rows.where("n > 0").join(component, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    # ids of a component meet as one minimum per set first
    least = named.groupBy("c").agg(F.min(id_col).alias("component_id"))
    sets = rows.where("n > 0").select("fp").distinct().join(component, "fp", "left")
    classes = sets.select("fp", F.coalesce("component", "fp").alias("c")).join(least, "c").select("fp", "component_id")
    out = rows.join(classes, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return out.select(id_col, F.col("n").alias("n_shingles"), own.alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rule: three words, 0.9."""
    return jaccard_components(table(tuned(spark), sf_dir, "documents"), words=3, percent=90)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """docs with one document of each component: that of the smallest id, and one row of it where rows repeat its id (any
    of them: they stand for one document). Rows with a null id stay, as do rows without words; an empty table stays empty;
    very long texts as in jaccard_components. All columns are kept. Only rows that an id filter lets pass are shuffled."""
    found = saved(jaccard_components(docs, id_col, text, words, percent), "join-components")
    gone = saved(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "join-gone")
    kept = lacking(docs, gone, id_col)
    repeated = saved(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "join-repeated")
    if repeated.isEmpty():
        return kept
    return lacking(kept, repeated, id_col).union(having(kept, repeated, id_col).dropDuplicates([id_col]).select(docs.columns))
