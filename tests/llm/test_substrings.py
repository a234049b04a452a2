import hashlib
import re

import numpy as np

from tessera.llm import substrings

from .texts import corpus, frame


def brute(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) by looking at every window."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        yield d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_query(spark):
    rows = corpus(160)
    got = sorted(map(tuple, substrings.digest_query(frame(spark, rows)).collect()))
    want = sorted(brute(rows))
    assert got == want
    assert sum(r[2] > 0 for r in want) > 30


def test_small_windows_and_small_batches(spark, monkeypatch):
    rows = corpus(80, seed=4)
    for window in (1, 3, 8, 9):
        out = substrings.without_repeats(frame(spark, rows), window)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text, sum(s.past - s.first for s in r.removed_spans)) for r in out.collect()}
        for d, n, gone, digest in brute(rows, window):
            assert got[d][:2] == (n, gone) and got[d][3] == gone
            assert hashlib.sha256(got[d][2].encode()).hexdigest() == digest


def test_passages_repeated_within_documents(spark):
    """The owner of a block may have it several times; each of them is judged."""
    passage = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(["x"] + passage[:55])), (2, " ".join((passage + ["q", "r"]) * 3)), (3, " ".join(["a", "b"] * 80 + passage * 2)), (4, " ".join(["a"] * 200)), (5, " ".join(["z"] + ["a"] * 70 + ["a", "b"] * 40))]
    got = sorted(map(tuple, substrings.digest_query(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows)) and got[1][2] == 165


def test_leftmost_least():
    values = np.random.default_rng(2).integers(0, 9, 300)
    for width in (1, 2, 3, 7, 43, 300):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]
        assert substrings.leftmost_least(values, width).tolist() == want
    assert not len(substrings.leftmost_least(values, 301))


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, passage, 1), (2, "x " + passage, 2), (2, "x " + passage, 3), (None, passage, 4), (3, None, 5), (4, "", 6)], "doc_id long, text string, spans int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.digest_query(docs).collect()), key=str)
    assert got == sorted([(1, 60, 0), (2, 61, 60), (2, 61, 60), (None, 60, 0), (3, 0, 0), (4, 0, 0)], key=str)
    assert substrings.digest_query(frame(spark, [])).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """They count as one document: neither empties the other, and each is cut at its own places."""
    passage = " ".join(f"w{i}" for i in range(130))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "tiny"), (1, "a b " + passage), (1, passage + " " + other), (2, "q " + other), (2, "z " * 90 + passage), (2, "z " * 90 + passage), (3, other + " " + passage)]
    assert sorted(map(tuple, substrings.digest_query(frame(spark, rows)).collect())) == sorted(brute(rows))


def test_factors(spark):
    """The greedy parse: each factor is a run of at least a window that its source has at the place told."""
    rows = corpus(120, seed=9)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    found = 0
    for r in substrings.without_repeats(frame(spark, rows)).collect():
        covered = set()
        for f in r.factors:
            n = f.past - f.first
            assert n >= 50 and f.source < r.doc_id
            assert words[r.doc_id][f.first : f.past] == words[f.source][f.source_first : f.source_first + n]
            covered |= set(range(f.first, f.past))
            found += 1
        assert len(covered) == r.n_removed
    assert found > 30


def test_string_ids(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [("b", passage), ("a", "x " + passage), ("c", None)], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.digest_query(docs).collect()) == [("a", 0), ("b", 60), ("c", 0)]
