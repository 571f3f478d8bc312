"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. Versioned
policies are bit masks that are applied to the ledger afterwards, and ablations are bitwise aggregates of it: neither
reads a text again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import LEAD, NOT_SPACE, byte_table, hits, map_texts, mix, ngrams, per_doc, run_hashes, running, runs, saved, table, tuned

SYMBOLS = byte_table(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
NOT_NEWLINE = ~byte_table((10, 10))
LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letter_words long"


def dup_lines(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those of them equal to an earlier one."""
    ls, le, _ = runs(buf, offs, NOT_NEWLINE)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[worded], le[worded]
    return np.diff(np.searchsorted(ls, offs)), np.diff(np.searchsorted(ls, offs)) - distinct(run_hashes(buf, ls, le), np.searchsorted(ls, offs))


def distinct(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Distinct values in each document's slice."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # tells documents apart
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order][new], minlength=len(offs) - 1)


def repeat_words(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words that lie in a 3-word window found at least twice in the document."""
    count = np.zeros(len(offs) - 1, np.int64)
    if len(h) < 3:
        return count
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = doc[2:] == doc[:-2]
    key = mix(ngrams(h, 3) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    place = np.flatnonzero(whole)
    order = np.argsort(key[place], kind="stable")
    k = key[place][order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    hit = np.zeros(len(h), bool)
    at = place[order][same]
    for d in range(3):
        hit[at + d] = True
    return hits(hit, offs)


def measure(buf: np.ndarray, offs: np.ndarray) -> dict:
    starts, ends, wo = runs(buf, offs, NOT_SPACE)
    lead, letters = running(LEAD[buf]), running(LETTER[buf])
    lines, dup = dup_lines(buf, offs, starts)
    return {
        "n_words": np.diff(wo),
        "word_chars": per_doc((lead[ends] - lead[starts]).astype(np.int64), wo),
        "n_symbols": hits(SYMBOLS[buf], offs),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(run_hashes(buf, starts, ends), wo),
        "n_lines": lines,
        "n_letter_words": hits(letters[ends] > letters[starts], wo),
    }


#: (name, the document fails where this holds). A rule's place is its bit, so rules are only ever appended.
RULES: list[tuple[str, Column | str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("few_letter_words", "10 * n_letter_words < 7 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]
#: Version -> the rules that count; a document is kept if it fails none of them.
POLICIES: dict[str, int] = {"v1": BASE, "v2": sum(BIT.values())}


def ledger(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, measurements, fail_bits. Null and empty texts have no words, and so fail
    ``too_few_words``; a null id passes through. Repeated rows stay, each with the measurements of its text, and an empty
    table gives none; there are no ties to break. A very long text is measured whole, in memory of some 40 bytes a byte.
    Extra columns are not read."""
    measured = map_texts(df, MEASURES, measure, [id_col], text)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)])
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, mask: int) -> DataFrame:
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, mask: int) -> DataFrame:
    """Per rule of the policy: rows failing it, rows failing it alone, and rows kept without it; from the bits only."""
    bad = F.col("fail_bits").bitwiseAND(F.lit(mask))
    each = [(n, b) for n, b in BIT.items() if b & mask]
    sums = [F.count(F.when(bad == 0, 1)).alias("kept")]
    for n, b in each:
        sums += [F.count(F.when(bad.bitwiseAND(F.lit(b)) != 0, 1)).alias(f"f_{n}"), F.count(F.when(bad == b, 1)).alias(f"a_{n}")]
    wide = rows.agg(*sums)
    stack = ", ".join(f"'{n}', f_{n}, a_{n}, kept + a_{n}" for n, _ in each)
    return wide.selectExpr(f"stack({len(each)}, {stack}) as (rule, n_failed, n_failed_alone, n_kept_without)")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by policy v2; then the ledger's other columns, what v1 keeps, and the rule, if any, without
    which v2 would keep the document (the ablation, by document; ``ablation`` sums it up)."""
    rows = apply_policy(ledger(table(tuned(spark), sf_dir, "documents")), POLICIES["v2"])
    fails = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    alone = reduce(lambda a, b: a.when(F.col("fail_bits") == b[1], b[0]), BIT.items(), F.when(F.lit(False), ""))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), "kept"]
    more = ["n_lines", "n_letter_words", "fail_bits", F.lit("v2").alias("policy"), (~fails(POLICIES["v1"])).alias("kept_v1")]
    return rows.select(*out, *more, alone.alias("kept_without"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule: documents that fail it, that fail it alone, and that would be kept without it. The stored
    ledger serves all policies."""
    rows = saved(ledger(table(tuned(spark), sf_dir, "documents")), "ledger")
    return reduce(DataFrame.union, [ablation(rows, mask).select(F.lit(v).alias("policy"), "*") for v, mask in POLICIES.items()])
