"""Toxicity: gradient-boosted trees over dense features of the text, calibrated isotonically.

Features: densities of lexicons, hits near words of the second person, capitals, punctuation, and rates of obfuscated
words (digits or signs in place of letters). Spark's own boosted trees learn from them on the cluster. Beside the fixed
lexicons there is a learnt one: beginnings of words that labelled toxic documents hold far more often than others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._calibrate import bounded, held_out, isotonic
from ._stats import UPPER, as_lists
from ._text import ALNUM_LOWER, LOWER, hash_word, hits, lacking, map_texts, run_hashes, running, runs, saved, table, tuned
from .quality_rules import distinct

# Common words of insult, contempt, threat and the second person in four languages.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb fool fools loser losers imbecile clown clowns jerk jerks dumbass bastard bastards ass asshole bitch cretin dimwit halfwit dunce twit coward cowards liar liars creep creeps freak freaks pig pigs rat rats weirdo nitwit airhead blockhead idiote imbécile crétin abruti connard salaud débile trottel dummkopf arschloch depp blödmann schwachkopf idiota imbécil estúpido estúpida tonto cabrón pendejo",
    "contempt": "worthless pathetic disgusting trash garbage scum filth filthy vermin useless vile ugly hopeless horrible hideous despicable repulsive revolting miserable sickening contemptible lowlife sewage parasite parasites subhuman inutile dégoûtant minable ordure wertlos erbärmlich widerlich abschaum dreck inútil patético asqueroso basura escoria",
    "threat": "kill die hurt destroy murder beat punch strangle hang shoot stab burn rot suffer hate shut crush tuer mourir töten sterben matar morir odio hasse déteste",
    "curse": "fuck fucking fucked shit shitty damn damned crap bloody hell piss merde putain scheiße verdammt mierda joder",
}
SECOND_PERSON = "you your yours yourself youre tu toi te vous votre du dich dir dein deine ihr euch tú ti usted ustedes tus"
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

TO_LETTER = LOWER.copy()
for sign, letter in LEET.items():
    TO_LETTER[ord(sign)] = ord(letter)
SIGN = np.isin(np.arange(256), [ord(c) for c in LEET])
#: Words to either side in which a word of the second person counts as near.
NEAR = 5
NAMES = [f"{w}_{k}" for k in LEXICONS for w in ("share", "log")]
NAMES += ["any_share", "any_log", "near_share", "near_log", "second", "obfuscated_share", "obfuscated_log", "caps_hits", "upper", "shout", "question", "signs_inside"]
NAMES += ["learnt_share", "learnt_log", "learnt_sum", "learnt_most", "learnt_distinct"]
#: Lengths, in bytes, of the word beginnings that the learnt lexicon may hold.
STEMS = (4, 5, 6)


class Lexicon:
    def __init__(self):
        pairs = sorted({(hash_word(w), k) for k, line in enumerate([*LEXICONS.values(), SECOND_PERSON]) for w in line.split()})
        self.hashes, first = np.unique(np.array([p[0] for p in pairs], np.uint64), return_index=True)
        self.kind = np.array([p[1] for p in pairs], np.int8)[first]

    def kinds(self, h: np.ndarray) -> np.ndarray:
        """The lexicon of each word, -1 for none."""
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[slot] == h, self.kind[slot], -1)


def stems(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of at least k bytes, and hashes of their first k bytes."""
    at = np.flatnonzero(ends - starts >= k)
    return at, run_hashes(buf, starts[at], starts[at] + k)


def stem_lists(buf: np.ndarray, offs: np.ndarray) -> dict:
    """Distinct stems of each document."""
    low = LOWER[buf]
    starts, ends, wo = runs(low, offs, ALNUM_LOWER)
    got = [stems(low, starts, ends, k) for k in STEMS]
    at, h = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
    doc = np.searchsorted(wo, at, "right") - 1
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    offsets = np.searchsorted(doc[new], np.arange(len(offs)))
    return {"stems": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(h[new]))}


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str, text: str, *, max_toxic: int = 8000, max_clean: int = 16000,
) -> tuple[np.ndarray, np.ndarray]:
    """Stems and log odds, from at most about max_toxic and max_clean labelled documents (hash samples beyond).

    Every stem of three toxic documents, and of one in 400, whose log odds are 2 at least is in it, however common. The bounds
    on documents bound it too: a document has no more stems than letters.
    """
    some = [bounded(labels.where(F.col("label") == k), "__id", n) for k, n in ((1, max_toxic), (0, max_clean))]
    n = [x.count() for x in some]
    if not n[0] or not n[1]:
        return np.zeros(0, np.int64), np.zeros(0)

    def counted(sample: DataFrame, name: str) -> DataFrame:
        own = docs.join(F.broadcast(sample.select("__id")), F.col(id_col) == F.col("__id"), "left_semi")
        lists = map_texts(own, "stems array<bigint>", stem_lists, [id_col], text)
        return lists.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias(name))

    toxic = counted(some[0], "toxic").where(F.col("toxic") >= max(3, n[0] // 400))
    both = toxic.join(counted(some[1], "clean"), "stem", "left")
    odds = F.log((F.col("toxic") + 0.5) / (n[0] + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n[1] + 1))
    found = both.select("stem", odds.alias("odds")).where("odds >= 2").toPandas().sort_values("stem")
    return found["stem"].to_numpy(np.int64), found["odds"].to_numpy(float)


def features(lexicon: Lexicon, learnt: tuple[np.ndarray, np.ndarray]):
    second_kind = len(LEXICONS)
    shout, question = (np.arange(256) == ord(c) for c in "!?")

    def each(buf: np.ndarray, offs: np.ndarray) -> dict:
        low = LOWER[buf]
        starts, ends, wo = runs(low, offs, ALNUM_LOWER)
        kind = lexicon.kinds(run_hashes(low, starts, ends))
        words = np.maximum(np.diff(wo), 1)
        cols = []

        def add(hit: np.ndarray, at: np.ndarray = wo) -> None:
            n = hits(hit, at)
            cols.extend([np.minimum(1.0, n / words), np.log1p(n)])

        for k in range(len(LEXICONS)):
            add(kind == k)
        bad = (kind >= 0) & (kind < second_kind)
        add(bad)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
        second = np.concatenate([[0], np.cumsum(kind == second_kind)])
        at = np.flatnonzero(bad)
        near = np.zeros(len(bad), bool)
        near[at] = second[np.minimum(at + NEAR + 1, wo[doc[at] + 1])] > second[np.maximum(at - NEAR, wo[doc[at]])]
        add(near)
        cols.append(hits(kind == second_kind, wo) / words)
        plain = TO_LETTER[buf]
        s2, e2, w2 = runs(plain, offs, ALNUM_LOWER)
        signs, letters = running(SIGN[buf]), running(ALNUM_LOWER[low] & ~SIGN[buf])
        odd = (signs[e2] > signs[s2]) & (letters[e2] > letters[s2])
        hidden = np.zeros(len(s2), bool)
        at = np.flatnonzero(odd)
        got = lexicon.kinds(run_hashes(plain, s2[at], e2[at])) if len(at) else np.zeros(0)
        hidden[at] = (got >= 0) & (got < second_kind)
        add(hidden, w2)
        upper = running(UPPER[buf])
        shouted = bad & (upper[ends] - upper[starts] == ends - starts)
        size = np.maximum(np.diff(offs), 1)
        cols.append(np.log1p(hits(shouted, wo)))
        cols.append((upper[offs[1:]] - upper[offs[:-1]]) / size)
        cols.append(hits(shout[buf], offs) / words)
        cols.append(hits(question[buf], offs) / words)
        inner = odd & ~SIGN[buf[e2 - 1]] if len(e2) else odd
        cols.append(hits(inner, w2) / words)
        weight = np.zeros(len(starts))
        for k in STEMS if len(learnt[0]) else ():
            at, h = stems(low, starts, ends, k)
            h = h.astype(np.int64)
            slot = np.minimum(np.searchsorted(learnt[0], h), len(learnt[0]) - 1)
            weight[at] = np.maximum(weight[at], np.where(learnt[0][slot] == h, learnt[1][slot], 0))
        at = np.flatnonzero(weight)
        add(weight > 0)
        cols.append(np.log1p(np.bincount(doc, weight, len(words))))  # a document's sum starts from 0
        most = np.zeros(len(words))
        np.maximum.at(most, doc[at], weight[at])
        cols.append(most)
        cols.append(np.log1p(distinct(run_hashes(low, starts[at], ends[at]), np.searchsorted(at, wo))))
        return {"features": as_lists(np.stack(cols, 1).astype(np.float32))}

    return each


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", *, id_col: str = "doc_id", text: str = "text",
    trees: int = 20, depth: int = 3, step: float = 0.3, max_labelled: int = 300_000,
) -> DataFrame:
    """(id, held_out, score, predicted) per document.

    Learns from labelled rows whose crc32 of the id does not divide by 5: remainders 2 and 3 teach the lexicon, 4 grows
    the trees (at most about max_labelled rows, a hash sample beyond), 1 calibrates. Inputs are features of the text
    only. Null and empty texts have features 0 and a score like others; null labels are not learnt from; where the rows
    that grow trees lack one of the classes, scores are the share of label 1 (0 without rows). Rows of one text get one
    score; repeated rows stay, null ids pass through, and an empty table gives none; ids that labels repeat are learnt from
    as often. A very long text is one row of features, made in memory of some 40 bytes a byte. Extra columns are not read.
    """
    fold = (F.crc32(F.col(id_col).cast("string")) % 5).cast("int").alias("fold")
    learn = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("label"), fold).where("label is not null and fold <> 0")
    learnt = learn_lexicon(docs, learn.where("fold in (2, 3)"), id_col, text)
    rows = saved(map_texts(docs, "features array<float>", features(Lexicon(), learnt), [id_col], text), "toxicity-features")
    labelled = saved(rows.join(learn.where("fold in (1, 4)"), F.col(id_col) == F.col("__id")).drop("__id"), "toxicity-labelled")
    grow = bounded(labelled.where("fold = 4"), id_col, max_labelled)
    share = grow.agg(F.avg("label")).first()[0] or 0.0
    flag = held_out(id_col, 5, 0).alias("held_out")
    if share in (0.0, 1.0):
        return rows.select(id_col, flag, F.lit(float(share)).alias("score"), F.lit(int(share)).alias("predicted"))
    vector = F.transform("features", lambda v: v.cast("double"))
    tree = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, maxBins=32, seed=11)
    model = tree.fit(grow.select(array_to_vector(vector).alias("x"), "label").coalesce(12))
    raw = vector_to_array("probability")[1].alias("raw")
    seen = model.transform(labelled.where("fold = 1").select(array_to_vector(vector).alias("x"), "label")).select(raw, "label")
    x, y = isotonic(seen)

    @F.pandas_udf("double")
    def calibrated(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v, x, y))

    scored = model.transform(rows.select(id_col, array_to_vector(vector).alias("x"))).select(id_col, raw)
    return scored.select(id_col, flag, calibrated("raw").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that the trees predict to be toxic; a score of 0.5 is. Rows with a null id stay; where rows that
    repeat an id differ in their texts, all go if one is toxic. Null, empty and very long texts, labels and empty tables as
    in score_toxicity; all columns are kept."""
    scored = score_toxicity(docs, labels, id_col=id_col, **options)
    gone = saved(scored.where("predicted = 1").select(id_col).distinct(), "toxic")
    return lacking(docs, gone, id_col)
