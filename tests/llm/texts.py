"""Small corpora for the tests of the training-data operators."""

import random

import pandas as pd
import pyarrow as pa

WORDS = "the of and river stone winter garden market letter window silver road quiet morning paper engine copper field harbor music".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


def corpus(n=120, seed=1):
    """(doc_id, text) with copies, near copies, shared passages, empty, null, very short and one long text."""
    rng = random.Random(seed)
    passages = [sentence(rng, k) for k in (49, 50, 51, 70, 120)]
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 0 or not rows:
            text = sentence(rng, rng.randint(0, 200))
        elif kind == 1:
            text = rng.choice(rows)[1]
        elif kind == 2 and (old := (rng.choice(rows)[1] or "").split(" ")):
            for _ in range(rng.randint(1, 3)):
                old[rng.randrange(len(old))] = rng.choice(WORDS)
            text = " ".join(old)
        elif kind in (3, 4):
            text = "\n".join([sentence(rng, rng.randint(0, 40)), rng.choice(passages), sentence(rng, rng.randint(0, 40)), rng.choice(passages)])
        elif kind == 5:
            text = rng.choice([None, "", " \t\n ", "one", "Ünïcode — text… ⟨x⟩", "a b c", "a " * 150, "A B c d\x0be\x1cf g"])
        else:
            text = sentence(rng, rng.randint(0, 90)) + "\n" + rng.choice(passages)
        rows.append((i * 3, text))
    rows[-1] = (rows[-1][0], sentence(rng, 20_000))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)
