import hashlib
import math
import random

import pytest

from tessera.llm import mixing
from tessera.llm.mixing import Mix

from .texts import frame, sentence


def place(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def brute(rows, mix):
    """(id, source, tokens, weight, block, turn, position) with a plain bisection and a sort of all blocks."""
    docs = [(d, s or "", len((t or "").split())) for d, s, t in rows]
    size = {}
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    size = {s: n for s, n in size.items() if n}
    total, most, least = sum(size.values()), max(size.values()), min(size.values())

    def z(a):
        return sum((n / total) ** a for n in size.values())

    def budget(a):
        return mix.budget if mix.budget is not None else most * z(a) / (most / total) ** a

    def holds(a):
        if mix.max_repeats is not None:
            return (least / total) ** a / z(a) * budget(a) / least > mix.max_repeats
        weights = [(n / total) ** a / z(a) for n in size.values()]
        return -sum(w * math.log(w) for w in weights) >= mix.entropy_share * math.log(len(size))

    low, high = 0.0, 1.0
    for _ in range(48):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    a = round(high if mix.max_repeats is not None else low, 9)
    out = []
    for source, n in size.items():
        weight = (n / total) ** a / z(a)
        quota = math.floor(weight * budget(a) + 0.5)
        passes, left = divmod(quota, n)
        blocks = math.ceil(n / mix.block_tokens)
        own = [(d, t, place(mix.seed, "null" if d is None else d) % blocks) for d, s, t in docs if s == source]
        tokens = {}
        for _, t, b in own:
            tokens[b] = tokens.get(b, 0) + t
        taken, held = set(), 0
        for b in sorted(tokens, key=lambda b: (place(mix.seed, source, b, passes), b)):
            held += tokens[b]
            if held > left:
                break
            taken.add(b)
        for d, t, b in own:
            for turn in range(passes + (left > 0 and b in taken)):
                out.append((d, source, t, round(weight, 9), b, turn, round((turn + place(mix.seed, source, b, turn) / 2**32) * n / quota, 12)))
    return sorted(out, key=str)


def rows(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None]), rng.choice([sentence(rng, rng.randint(1, 60))] * 9 + [None])) for i in range(n)]


@pytest.mark.parametrize(
    "mix",
    [
        Mix(entropy_share=0.95, block_tokens=200),
        Mix(max_repeats=1.5, block_tokens=100, seed=3),
        Mix(max_repeats=4, budget=20_000, block_tokens=300),
        Mix(entropy_share=0.9, budget=500, block_tokens=50),
        Mix(entropy_share=0.0, block_tokens=10_000),
    ],
)
def test_against_a_plain_sort(spark, mix):
    got = mixing.mixed_documents(frame(spark, [(*r, 9) for r in rows()], "doc_id long, source string, text string, tokens int"), mix)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), mix)


def test_weights_meet_the_aim(spark):
    mix = Mix(max_repeats=2.0, block_tokens=50)
    got = mixing.mixed_documents(frame(spark, rows(), "doc_id long, source string, text string"), mix).collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 2
    assert {d for d, _, _ in rows()} == set(times)  # nothing is left out without a budget


def test_rows_keep_their_columns(spark):
    docs = frame(spark, [(*r, "x", "y") for r in rows()], "doc_id long, source string, text string, block string, turn string")
    mix = Mix(max_repeats=1.5, block_tokens=100)
    got = mixing.mixed_rows(docs, mix)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect())) == sorted(r[0] for r in brute(rows(), mix))


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    mix = Mix(max_repeats=1.5, block_tokens=100)
    got = mixing.mixed_documents(frame(spark, rows(), "doc_id long, source string, text string"), mix)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), mix)


def test_odd_rows(spark):
    mix = Mix(entropy_share=0.95)
    assert mixing.mixed_documents(frame(spark, [], "doc_id long, source string, text string"), mix).count() == 0
    assert mixing.mixed_rows(frame(spark, [(1, "a", None), (2, "b", "")], "doc_id long, source string, text string"), mix).count() == 0
    odd = [(None, "a", "x y"), (1, None, "z"), (1, None, "z")]
    got = mixing.mixed_documents(frame(spark, odd, "doc_id long, source string, text string"), mix)
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd, mix)
    with pytest.raises(ValueError):
        mixing.mixed_rows(frame(spark, odd, "doc_id long, source string, text string"), Mix())


def test_very_long_text_and_clashing_names(spark):
    """A text that is many blocks' worth, in a table whose columns are called like the operator's own."""
    rows = [(1, "s", "w " * 300_000, 1, 2, 3), (2, "s", "a b", 1, 2, 3), (3, "t", "c " * 50, 1, 2, 3), (4, None, None, 1, 2, 3)]
    docs = frame(spark, rows, "doc_id long, source string, text string, tokens long, block long, turn long")
    mix = Mix(max_repeats=1.25)
    got = mixing.mixed_rows(docs, mix)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in brute([(d, s, t) for d, s, t, *_ in rows], mix))
    assert mixing.mixed_rows(docs.limit(0), mix).count() == 0
