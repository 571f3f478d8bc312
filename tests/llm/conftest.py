import random

import pytest
from brute import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, fp long, score double, label int, item_id long"


@pytest.fixture(scope="session")
def texts():
    """Texts with every odd case: nulls, empty, white space, short, long, copies, near copies, repeated lines."""
    rng = random.Random(3)
    base = prose(rng, 120)
    out = [None, "", " \n\t ", "a", "a b", "A  B", "a b c", "a b c d e f g h i", "a b c d e f g h i", "é è ü ß   naïve", prose(rng, 60000)]
    out += [base, base, base.upper(), " ".join(["same words again"] * 40), "line one two\n" * 12 + prose(rng, 60)]
    for k in range(12):
        words = base.split(" ")
        for _ in range(1 + k % 4):
            words[rng.randrange(len(words))] += "x"
        out.append(" ".join(words))
    nine, ten = [f"w{i}" for i in range(11)], [f"w{i}" for i in range(12)]
    out += [" ".join(nine), " ".join(ten), " ".join(ten[1:])]
    out += [
        "Licensed under the Apache License, Version 2.0 and the MIT  LICENSE; general public license. GNU General Public License",
        "mit license", "MIT licence", "apache\nlicense mit license mit license", "general public", "license",
        "write to a.b@c.de or x@y, +1 (743) 555-3824, 4111 1111 1111 1111, 70.23.22.57, 999.1.1.1, 1.2.3.4.5 and 4111111111111112",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" then a@b.c_d@e.fg and +12 34', "+" * 50 + "1" * 40 + "@" * 20,
        "# $ % & | < > * " * 30, "a<|endoftext|>b it's A's don't",
    ]
    out += [prose(rng, rng.randint(5, 400)) for _ in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with repeated rows and columns whose names operators might use themselves."""
    rows = [(i, t, None, None, len(t) if t is not None else None, 1, 2, 0.5, 1, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[11:14], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
