import hashlib

import pytest
import xxhash

from tessera.llm import lzprint

from .texts import corpus, frame


def brute_phrases(text):
    phrases, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in phrases:
            phrases.add(text[start:end])
            start = end
    return phrases


def brute_print(text):
    return sorted({xxhash.xxh32_intdigest(p) for p in brute_phrases(text)})[: lzprint.SIZE]


def hexed(values):
    return "".join(f"{v:08x}" for v in values)


def brute(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        a, b, c = map(brute_print, (text, edited, following))
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), lzprint.likeness(a, b), lzprint.likeness(a, c)


@pytest.mark.parametrize("docs_in_range", [7, 1, 1000])
def test_query(spark, monkeypatch, docs_in_range):
    monkeypatch.setattr(lzprint, "RANGE_DOCS", docs_in_range)
    rows = corpus(90)
    got = sorted(map(tuple, lzprint.digest_query(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows))


def test_likeness_tells_edits_from_others(spark):
    got = [r for r in lzprint.digest_query(frame(spark, corpus(90))).collect() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in got) >= 0.9 * len(got)


def test_likeness_estimates_the_jaccard_share():
    a, b = brute_phrases(corpus(90)[10][1] or "x"), brute_phrases("a b c")
    assert lzprint.likeness(brute_print("abcabcabc"), brute_print("abcabcabc")) == 1
    assert lzprint.likeness([], []) == 1 and lzprint.likeness([], [3]) == 0
    assert lzprint.likeness([1, 2, 3], [2, 3, 4]) == 0.5
    assert a and b


def test_odd_rows(spark):
    assert lzprint.digest_query(frame(spark, [])).count() == 0
    one = lzprint.digest_query(frame(spark, [(3, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    docs = frame(spark, [(5, "abc", "p"), (5, "abc", "q"), (None, "xyz", "r"), (2, None, "s")], "doc_id int, text string, fingerprint string")
    got = lzprint.digest_query(docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["2", "5", "5", "None"]
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"xya").hexdigest()}


def test_fingerprints_of_whole_texts(spark):
    rows = corpus(40)
    got = {r.doc_id: r.fingerprint for r in lzprint.fingerprint_documents(frame(spark, rows)).collect()}
    assert got == {d: hexed(brute_print(t or "")) for d, t in rows}


def test_string_ids_and_equal_ids(spark, monkeypatch):
    """Ids of any type; a hot id is dealt over several ranges by the digests of its texts."""
    monkeypatch.setattr(lzprint, "RANGE_DOCS", 3)
    rows = [(f"k{d:04d}", t) for d, t in corpus(40)]
    got = {r.doc_id: tuple(r)[1:] for r in lzprint.digest_query(frame(spark, rows, "doc_id string, text string")).collect()}
    assert got == {r[0]: r[1:] for r in strings(rows)}
    large = [((1 << 62) + k, f"large {k}") for k in range(9)] + [(None, "none")]
    assert sorted((r.doc_id or 0, r.near_next < 1) for r in lzprint.with_edited(frame(spark, large)).collect()) == sorted((d or 0, True) for d, _ in large)
    hot = [(7, f"text {k} of many") for k in range(60)] + [(None, f"none {k}") for k in range(20)] + [(7, "text 3 of many"), (1, "x")]
    out = lzprint.with_edited(frame(spark, hot)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(d), len(t)) for d, t in hot)
    follows = [r.edited_text[len(r.edited_text) - r.n_chars // 3 :] for r in out if r.n_chars > 3]
    assert sum(f.startswith("text") for f in follows) == 60 and follows.count("no") == 19


def strings(rows):
    numbers = {d: k for k, (d, _) in enumerate(sorted(rows))}
    names = {k: d for d, k in numbers.items()}
    return [(names[r[0]], *r[1:]) for r in brute([(numbers[d], t) for d, t in rows])]


def test_long_text(spark):
    rows = [(1, "ab" * 300_000), (2, "c"), (3, None)]
    got = sorted(map(tuple, lzprint.digest_query(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows))
