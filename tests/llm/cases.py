"""Small documents with the odd cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, `doc id` string"


def rows(seed=0, n=40):
    rng = random.Random(seed)
    words = ["tree", "House", "of", "the", "ä", "river", "42", "Is", "blue|x", "run"]
    def some(k):
        return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(k))
    base = [some(rng.randint(60, 120)) for _ in range(n // 4)]
    texts = []
    for i in range(n):
        kind = i % 8
        t = rng.choice(base)
        w = t.split(" ")
        if kind == 0:
            t = t
        elif kind == 1:
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = some(20) + "\n" + " ".join(w[10:60]) + "\n" + some(20)
        elif kind == 3:
            t = "\n".join([" ".join(w[:30])] * 3 + [" ".join(w[30:])])
        elif kind == 4:
            t = some(rng.randint(1, 6))
        elif kind == 5:
            t = "abc " * rng.randint(30, 200)
        elif kind == 6:
            t = some(90)
        else:
            t = "  \n\t" + some(70) + " \n"
        texts.append(t)
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100, None), (101, ""), (102, " \n "), (None, texts[6]), (None, "lost " * 40), (5, texts[5]), (5, texts[5]), (6, "another text under the same number " * 3), (103, (some(400) + "\n") * 12)]
    return out


def documents(spark, seed=0, n=40):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "d", "x") for i, t in rows(seed, n)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
