"""The prefix trie, the filter audit and the nearest neighbours against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F

from dekadal.llm import _sketch, filter_audit, nearest, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- trie


def trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = {}
    for key, all_ in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(j[: len(k)] == k and len(j) > len(k) for j in below)]
        saves = sum((len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c, last in all_ if last))
        parent = min(c for c, _ in members[key[:-1]]) if key else None
        out[(min(c for c, _ in all_), len(key))] = (parent, len(all_), len(kids), len(leaves), saves, hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations(rng):
    rows, opening = [], [("system", "be  brief"), ("user", "hello there"), ("assistant", "yes ?")]
    for c in [*range(0, 70), *range(100, 119), -5, -20, -40, 1000]:  # 100 and 0 lend, 1000's lender is itself, 101.. and -5 too
        if c == 40:
            continue  # a lender that is absent
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role, text = opening[t] if t < 3 and rng.random() < 0.6 else (rng.choice(["user", None]), rng.choice([None, "", "a b", "c　d e", "same words again", prose(rng, 12)]))
            rows.append((c, t, role, text))
    for c in (200, 201, 202, 203, 300, 301):  # whole copies, one of them longer
        rows += [(c, t, "user", f"copy {t}") for t in range(23 + (c == 301))]
    rows += [(400, None, "user", "null turns first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, 0, "assistant", "z"), (400, 0, "user", "a"), (400, None, None, None)]
    rows += [(None, 0, "user", "no id"), (500, 5, "user", "far"), (500, 1 << 40, "user", "farther"), (500, -(1 << 40), "user", "before")]
    rows += [(600, t, "user", "long " * (t % 3)) for t in range(90)] + [(620, t, "user", "long " * (t % 3)) for t in range(80)]
    rows += [(640, 0, "user", "word " * 30_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits,blocks", [(12, 1 << 11), (2, 1)])
def test_trie(spark, monkeypatch, bits, blocks):
    """Also with long conversations in pieces of four places, and a sketch of eight cells, which clears nearly nothing."""
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", bits)
    if blocks == 1:
        monkeypatch.setattr(_sketch, "_cells", lambda b: [b.bitwiseAND(F.lit(7)), F.shiftrightunsigned(b, 20).bitwiseAND(F.lit(7))])
        monkeypatch.setattr(prefix_trie, "ID_BYTES", 4)
    rows = conversations(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "depth": F.lit("x"), "a": F.lit(2), "n": F.lit(0), "place": F.lit(0)}).repartition(5)
    got = {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.prefix_trie(df).collect()}
    assert got == trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    short = [(c, 0, "user", "own") for c in (21, 22, 23, 24, 25)]  # no lender: some lose all of their turns
    got = {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.prefix_trie(spark.createDataFrame(short, SCHEMA)).collect()}
    assert got == trie(short)
    turnless = [(c, 0, "user", "own") for c in (21, 22, 23, 24, 25) if zlib.crc32(str(c).encode()) % 4]
    assert turnless
    got = {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.prefix_trie(spark.createDataFrame(turnless, SCHEMA)).collect()}
    assert got == trie(turnless) and len(got) == 1


# ---- audit


def audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    fails = []
    for doc, text, part in rows:
        text, w = text or "", WORDS.findall(text or "")
        upper = len(re.findall("[A-Z]", text))
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        named = zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy), strict=True)
        fails.append((part or "", {f for f, x in named if x}, doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in own if f in x[0] and not x[0] & set(order[:k])]
                total[f] += len(gone)
                out[(part, "".join(order), k + 1)] = [
                    sum(not x[0] & set(order[: k + 1]) for x in own), len(gone), sum(f in x[0] and bool(x[0] & set(order[:k])) for x in own),
                    sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("cells", [None, 3])
def test_audit(spark, texts, monkeypatch, cells):
    """Also with a sketch of four cells, which clears nearly nothing."""
    if cells:
        monkeypatch.setattr(_sketch, "_cells", lambda b: [b.bitwiseAND(F.lit(cells)), F.shiftrightunsigned(b, 20).bitwiseAND(F.lit(cells))])
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["web", "web", "books", None])) for i, t in enumerate(texts)]
    rows += [(900 - i, texts[k], "web") for i, k in enumerate((0, 1, 11, 14, 20, 20, 21))]  # copies, of smaller ids
    rows += [(14, texts[14], "web"), (14, texts[11], "books"), (None, texts[11], "web"), (None, "alone " + texts[12], "null"), (950, texts[12], "")]
    rows += [(1000 + i, "the copied text of a third of all rows", "hot") for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 900, 2)] + [(14, 1, 0), (14, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit(2), "n": F.lit(3), "good": F.lit(4)}).repartition(4)
    counts = filter_audit.mask_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.filter_audit(counts).collect()}
    assert got == audit(rows, labels)


def test_audit_of_no_rows(spark, empty):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(filter_audit.mask_counts(empty, labels)).count() == 0


def test_a_sketch_never_clears_a_repeat(spark):
    keys = spark.range(3000).select((F.col("id") % 2500).alias("k")).select("k", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b"))
    for blocks in (1, 64):
        got = {r.k: r.p for r in _sketch.perhaps_repeated(keys, _sketch.sketch(keys, "a", "b", blocks), "a", "b", "p").collect()}
        assert all(got[k] for k in range(500)) and sum(got.values()) < 800


# ---- nearest neighbours


def exact(rows, every=50, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    sizes = {n: sum(len(v) == n for _, v in rows) for n in {len(v) for _, v in rows}}
    rows = [(i, v) for i, v in rows if len(v) == max(sizes, key=lambda n: (sizes[n], n))]
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b)))
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max([best.get(i, -2.0), *(cos(v, w) for j, w in rows if j == q)])
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def held(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_nearest_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=20).astype(np.float32)]) for i in range(300)]
    same = rows[7][1]
    rows += [(i, same) for i in range(1000, 1160)] + [(i, [2 * x for x in same]) for i in range(1200, 1210)]  # copies, and one direction
    rows += [rows[50], rows[50], (51, rows[60][1]), (100, rows[3][1])]  # repeated rows, ids with two vectors
    rows += [(400, None), (450, []), (500, [0.0] * 20), (550, [1.0] * 19 + [None]), (551, [1.0] * 19 + [float("nan")]), (552, [float("inf")] * 20), (553, [1.0, 2.0]), (None, same)]
    rows += [(600, [3e38] * 20), (601, [-0.0] + [1e-38] * 19), (602, [0.0] + [1e-38] * 19)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).withColumns({"score": F.lit(1), "rank": F.lit(2), "__list": F.lit(3)}).repartition(4)
    got, want = held(nearest.nearest(df, F.col("vec_id") % 50 == 0, max_lists=1).collect()), exact(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert len(got[q]) == len(near) and all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got[q], near, strict=True))
    assert [i for i, _ in got[1000]] == [7, 1001, 1002, 1003, 1004] and [i for i, _ in got[1050]] == [7, 1000, 1001, 1002, 1003]


def test_few_candidates_are_all_returned(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])]
    got = held(nearest.nearest(spark.createDataFrame([(*r, 1) for r in rows], VECTORS), F.col("vec_id") % 50 == 0).collect())
    assert [i for i, _ in got[0]] == [50, 1] and [i for i, _ in got[50]] == [0, 1]
    none = spark.createDataFrame([], VECTORS)
    assert nearest.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [1.0], 1)], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("spread", [None, 0.3])
def test_recall(spark, spread, monkeypatch):
    """Vectors without any clusters, and in clusters; lists and queries dealt in small parts."""
    monkeypatch.setattr(nearest, "LIST_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 10)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4000, 48))
    if spread:
        v = rng.normal(size=(25, 48))[rng.integers(25, size=4000)] + spread * v
    rows = [(i, [float(x) for x in r.astype(np.float32)]) for i, r in enumerate(v)]
    got = held(nearest.nearest(spark.createDataFrame([(*r, 1) for r in rows], VECTORS), F.col("vec_id") % 50 == 0).collect())
    x = np.array([r[1] for r in rows])
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = u[::50] @ u.T
    s[np.arange(80), np.arange(0, 4000, 50)] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    hit = sum(len({i for i, _ in got[50 * q]} & set(map(int, w))) for q, w in enumerate(want))
    assert hit >= 0.95 * 400 and all(len(near) == 5 for near in got.values())


def test_a_scan_gives_up_early_and_misses_little():
    rng = np.random.default_rng(1)
    v = nearest.unit(rng.normal(size=(3000, 128)) + 4 * rng.normal(size=(20, 128))[rng.integers(20, size=3000)])
    q = v[:60]
    i, j = nearest.scan(q, v, 6)
    best = np.argsort(-(q @ v.T), axis=1)[:, :6]
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert sum((a, b) in pairs for a in range(60) for b in best[a].tolist()) >= 0.98 * 360
    assert len(pairs) < 0.05 * 60 * 3000
