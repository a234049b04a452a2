"""Near-duplicates by five-word similarity against all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import simhash, similar

from .texts import corpus, frame, sentence


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]


def brute_groups(rows, similarity=0.8):
    """{id: smallest id reachable} over (id, text) by all pairs."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, words_of(t)) for d, t in rows)}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = [d for d, _ in rows]
    for i, d in enumerate(ids):
        for e in ids[:i]:
            both = len(sets[d] & sets[e])
            if both >= similarity * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in root}


def edited(rng, text, edits):
    own = text.split(" ")
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
    return " ".join(own)


def near_group(rng, n, first=10_000):
    """Copies of one text with scattered edits: some similar to it, some to each other, some to none."""
    base = " ".join(f"word{rng.randrange(10**6)}" for _ in range(150))
    return [(first + k, edited(rng, base, rng.randrange(7))) for k in range(n)]


def kept(spark, rows, similarity=0.8):
    return sorted(r.doc_id for r in simhash.representatives(frame(spark, rows), similarity=similarity).select("doc_id").collect())


def compared(rows, got):
    """No document goes without a link, and of those that all pairs would drop at least 0.95 go: balls are probabilistic."""
    want = set(brute_groups(rows).values())
    assert set(got) >= want and len(set(got)) == len(got)
    assert len(set(got) - want) <= 0.05 * (len(rows) - len(want))


def test_groups(spark):
    rng = random.Random(3)
    rows = [(d, t) for d, t in corpus(160) if not t or len(t) < 50_000] + near_group(rng, 80)
    compared(rows, kept(spark, rows))


def test_truncated_copies_and_long_texts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        text = sentence(rng, 300 if k else 30_000).split(" ")
        rows += [(4 * k, " ".join(text)), (4 * k + 1, " ".join(text[: len(text) * 9 // 10])), (4 * k + 2, " ".join(text[len(text) // 2 :])), (4 * k + 3, " ".join(text).upper())]
    compared(rows, kept(spark, rows))


@pytest.mark.parametrize("most,aim", [(12_000_000, 20_000), (4_000, 2_000), (40, 1_000)])
def test_buckets_that_are_dealt_out(spark, monkeypatch, most, aim):
    monkeypatch.setattr(simhash, "VARIANTS_MOST", most)
    monkeypatch.setattr(simhash, "VARIANTS_AIM", aim)
    rows = near_group(random.Random(5), 30) + near_group(random.Random(6), 10, 20_000)
    compared(rows, kept(spark, rows))


def test_pairs_in_memory_are_thinned(monkeypatch):
    """However few pairs are held at once, the nodes stay connected as they are by all near pairs."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    flips = lambda bits, most: np.array([sum(1 << int(b) for b in rng.choice(bits, rng.integers(0, most), replace=False)) for _ in range(300)], np.uint64)
    check = base[rng.integers(0, 3, 300)] ^ flips(64, 9)
    prints = (base[:1] ^ flips(44, 3)) & np.uint64((1 << 44) - 1)
    rests = np.full(300, 2)
    monkeypatch.setattr(similar, "PAIRS_AT_ONCE", 500)
    x, y = similar.bucket_pairs(prints, rests, check, 44)
    a, b = np.nonzero((np.bitwise_count(prints[:, None] ^ prints) <= 4) & (np.bitwise_count(check[:, None] ^ check) <= similar.CHECK_RADIUS))
    nodes = np.arange(300)
    assert np.array_equal(similar.joined_roots(nodes, x, y), similar.joined_roots(nodes, a, b))
    assert len(x) < 300 * (similar.FORESTS + similar.HUBS)


def test_no_link_goes_with_the_candidates_that_do_not_stay(spark, monkeypatch):
    """With hardly any candidates kept the same texts stay as with all of them, in one block or many."""
    rows = near_group(random.Random(7), 90) + near_group(random.Random(8), 60, 20_000)
    monkeypatch.setattr(similar, "FORESTS", 200)
    whole = kept(spark, rows)
    monkeypatch.setattr(similar, "FORESTS", 1)
    monkeypatch.setattr(similar, "HUBS", 0)
    assert kept(spark, rows) == whole
    monkeypatch.setattr(similar, "SHINGLES_AT_ONCE", 4_000)
    assert kept(spark, rows) == whole


def test_links_of_sets():
    """Different roots are connected as by all pairs, whatever the number of pairs at once; two blocks across only."""
    sets = [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 5, 7], [9], [9], [20, 21]]
    size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    told = lambda root, block: sorted(zip(*map(np.ndarray.tolist, similar.set_links(np.zeros(6, np.uint64), np.array(root), np.array(block), size, flat, 0.8))))
    assert told(range(6), [0] * 6) == [(0, 2), (3, 4)]
    assert told([0, 1, 0, 3, 4, 5], [0] * 6) == [(3, 4)]
    assert told(range(6), [0, 0, 0, 0, 1, 1]) == [(3, 4)]


def test_odd_rows(spark):
    text = "a b c d e f g"
    docs = frame(spark, [(None, text, 1), (4, None, 2), (2, "", 3), (4, None, 2), (9, text.upper(), 4), (None, "zz yy", 5), (7, "zz  yy", 6), (None, "only one", 7)], "doc_id long, text string, row_key long")
    got = sorted((r.doc_id, r.row_key) for r in similar.representatives(docs).collect() if r.doc_id is not None)
    assert got == [(2, 3), (7, 6), (9, 4)] and similar.representatives(docs).columns == docs.columns
    assert [r.row_key for r in similar.representatives(docs).filter("doc_id IS NULL").collect()] == [7]
    assert similar.representatives(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = frame(spark, [(1, "a b", 2, 3, 4, 5), (2, "a b", 2, 3, 4, 5)], "doc_id long, text string, node long, content long, `key` long, `a.b` long")
    got = similar.representatives(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]
