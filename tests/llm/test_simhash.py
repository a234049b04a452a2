import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.graph import components

from .texts import corpus, frame


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: smallest id reachable} over (id, print)."""
    root = {d: d for d, _ in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, f) in enumerate(prints):
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in root}


def test_query(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest_query(frame(spark, rows)).collect()}
    prints = [(d, brute_print(t)) for d, t in rows]
    roots = brute_components(prints)
    assert got == {d: (f"{f:016x}", roots[d]) for d, f in prints}


@pytest.mark.parametrize("most,aim", [(12_000_000, 1_500_000), (3_000, 1_500_000), (2_100, 5_000)])
def test_links_of_dense_groups(spark, monkeypatch, most, aim):
    """Fingerprints close to each other, with buckets that are dealt out further and further."""
    monkeypatch.setattr(simhash, "VARIANTS_MOST", most)
    monkeypatch.setattr(simhash, "VARIANTS_AIM", aim)
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centers for _ in range(6)} | {0, (1 << 64) - 1, 15, 31})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    want = brute_components([(s, f) for s, f in zip(signed, fps)])
    want = {s: min(x for x in signed if want[x] == want[s]) for s in signed}
    assert {s: got.get(s, s) for s in signed} == want


def test_odd_rows(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(frame(spark, [(1, "a")]), radius=3)
    docs = frame(spark, [(None, "a b c d e f"), (4, None), (2, ""), (4, None), (9, "a b c d e f"), (None, "zz yy xx ww")])
    got = sorted((r.doc_id, r.component_id) for r in simhash.digest_query(docs).collect() if r.doc_id is not None)
    assert got == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert simhash.digest_query(frame(spark, [])).count() == 0


def test_representatives(spark):
    docs = frame(spark, [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (8, None, 3), (None, "zz yy xx ww", 4), (None, "a b c d e f", 5)], "doc_id long, text string, root long")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, "a b c d e f", 2), (8, None, 3), (None, "zz yy xx ww", 4)], key=str)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (200, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 200: 199}


def test_similar_texts_are_linked(spark):
    """Texts of five-word similarity 0.8 or more go, however far their fingerprints are; others stay."""
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    near, far = [*words], [*words]
    for k in range(20, 400, 60):
        near[k] = "other"
    for k in range(0, 400, 20):
        far[k] = "other"
    rows = [(d, " ".join(w)) for d, w in enumerate([words, near, far, [w + "z" for w in words]])]
    prints = [brute_print(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 4
    assert sorted(r.doc_id for r in simhash.representatives(frame(spark, rows), similarity=0.8).collect()) == [0, 2, 3]
    import corpus_pipeline

    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, frame(spark, rows), "").collect()) == [0, 2, 3]


def test_clashing_names(spark):
    """Columns that the operator has itself are not read and do not disturb it."""
    docs = frame(spark, [(1, "a b c d e", 2, 3, 4), (2, "a b c d e", 2, 3, 4)], "doc_id long, text string, fp long, bucket long, row_key long")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e", 2, 3, 4)]
