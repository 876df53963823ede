"""Small corpora with the awkward cases: nulls, empty and long texts, copies, near copies, ties, repeated rows."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, copy string, `gone` int"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def sentences(rnd, n):
    return "\n".join(" ".join(words(rnd, rnd.randint(3, 14))).capitalize() + "." for _ in range(n))


def texts(seed=1, n=60):
    """Texts by doc_id with shared passages, exact copies, near copies and periodic ones."""
    rnd = random.Random(seed)
    passage = " ".join(words(rnd, 45))
    out = {}
    for d in range(n):
        kind = d % 10
        if kind == 0:
            out[d] = None if d % 20 else ""
        elif kind == 1:
            out[d] = sentences(rnd, 4) + "\n" + passage + "\n" + sentences(rnd, 2)
        elif kind == 2 and d > 10:
            out[d] = out[d - 1]
        elif kind == 3:
            near = (out[d - 2] or "x").split(" ")
            near[rnd.randrange(len(near))] = "changed"
            out[d] = " ".join(near)
        elif kind == 4:
            out[d] = "again and " * rnd.randint(1, 60)
        elif kind == 5:
            out[d] = "  \t\n " if d % 20 == 5 else "one two"
        else:
            out[d] = sentences(rnd, rnd.randint(1, 12))
    out[n] = sentences(rnd, 900)
    return out


def table(spark, docs, more=()):
    """A documents table with extra columns whose names the operators use themselves."""
    rows = [(d, t, ("en", "de", None)[d % 3], (None, "s1", "s2", "s3")[d % 4], None if t is None else len(t), d, t, "mine", 1) for d, t in docs.items()]
    return spark.createDataFrame([*rows, *more], COLUMNS).repartition(3)


def awkward_rows(docs):
    """A row without a doc_id and a repeated row."""
    d = next(d for d, t in docs.items() if t)
    return [(None, docs[d], None, None, None, None, None, None, None), (d, docs[d], ("en", "de", None)[d % 3], (None, "s1", "s2", "s3")[d % 4], len(docs[d]), d, docs[d], "mine", 1)]
