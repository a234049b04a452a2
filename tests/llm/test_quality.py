import re
from collections import Counter

from tessera.llm import quality

from .texts import corpus, frame


def longest_repeat(words):
    k = 8
    while max(Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)).values(), default=0) > 1:
        k += 1
    return k - 1 if k > 8 else 0


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = [False] * n
    for i in range(n - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = n < 20 or 100 * sum(covered) > 30 * n
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, sum(covered), failed, not failed and longest_repeat(words) <= min(200, 15 * n / 100)


def test_query(spark):
    block = " ".join(f"w{i}" for i in range(205))
    filler = " ".join(f"v{i}" for i in range(1200))
    rows = [(d, t) for d, t in corpus() if not t or len(t) < 20_000] + [(1001, "a b " * 40), (1002, "é#* $\n é#* $\n\n \n"), (1003, f"{block} {filler} {block}"), (None, "few words"), (1001, "a b " * 40)]
    got = quality.quality_rules(frame(spark, [(*r, 3) for r in rows], "doc_id long, text string, n_words int")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_spans").collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert all(sum(s.past - s.first for s in r.repeat_spans) == r.n_repeat_words for r in got)


def test_kept_documents_are_those_of_the_rules(spark):
    docs = frame(spark, [(*r, 3) for r in corpus()], "doc_id long, text string, n_words int")
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    out = quality.kept_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == kept
    assert quality.kept_documents(docs.limit(0)).count() == 0


def test_verdict_goes_beyond_the_base_rules(spark):
    """A loop that overlaps itself and a repeat without end fail though little enough is covered."""
    words = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    loop = "ha " * 25 + words(75, "v")
    long = f"{words(205, 'w')} {words(1200, 'v')} {words(205, 'w')}"
    pair = f"{words(14, 'w')} {words(72, 'v')} {words(14, 'w')}"
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(frame(spark, [(1, loop), (2, long), (3, pair)])).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True)}
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_very_long_text(spark):
    """Half a million words, all different but for one passage and its copy."""
    words = [f"w{i}" for i in range(500_000)]
    words[400_000:400_030] = words[:30]
    row = quality.quality_rules(frame(spark, [(1, " ".join(words))])).first()
    assert (row.n_words, row.n_repeat_words, row.longest_repeat, row.kept) == (500_000, 60, 30, True)
