"""The prefix join at five words and 0.8, against brute force."""

import functools
import random

import brute
from brute import prose

from dekadal.llm import jaccard_join


def test_five_words_and_eighty_percent(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(rng, rng.choice([8, 9, 10, 20, 54, 120])).split(" ")
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
            rows.append((len(rows), " ".join(words[rng.randint(0, 1) :])))
    fifty = [f"w{i}" for i in range(50)]
    rows += [(900, " ".join(fifty)), (901, " ".join(fifty[:25] + ["other"] + fifty[26:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    three = brute.components(rows)
    monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, n=5))
    five = brute.components(rows, 80)
    assert (901, 46, 900) in five and (901, 48, 901) in three
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, words=5, percent=80).collect())) == five
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs, words=5, percent=80).collect()) == [i for i, _, c in five if i == c]
