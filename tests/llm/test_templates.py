import hashlib
import random
import re

import pytest

from tessera.llm import templates

from .texts import corpus, frame, sentence


def brute(rows, depth=3, share=0.5, min_docs=10, keep_first=True):
    lines = []
    for d, t in rows:
        for k, line in enumerate(t.split("\n") if t else []):
            tokens = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if tokens and d is not None:
                lines.append((d, k, (len(tokens), *tokens[:depth]), tokens))
    count = {}
    for _, _, leaf, tokens in lines:
        for at, w in enumerate(tokens):
            count[leaf, at, w] = count.get((leaf, at, w), 0) + 1
    of, docs = {}, {}
    for d, k, leaf, tokens in lines:
        constants = tuple((at, w) for at, w in enumerate(tokens) if w != "<*>" and count[leaf, at, w] >= min_docs)
        if constants and len(constants) >= share * len(tokens):
            of[d, k] = (leaf, constants)
            docs.setdefault((leaf, constants), set()).add(d)
    out = []
    for d, t in rows:
        split = t.split("\n") if t else []
        gone = {k for k in range(len(split)) if (d, k) in of and len(docs[of[d, k]]) >= min_docs and (not keep_first or d > min(docs[of[d, k]]))}
        kept = "\n".join(line for k, line in enumerate(split) if k not in gone)
        out.append((d, sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in split), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    out = []
    for i in range(150):
        lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 4))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Copyright {1990 + i} by {rng.choice(['Ann', 'Bob', 'Cy'])} and others, all rights reserved")
        if i % 5 == 0:
            lines.append(f"Posted by user{rng.choice('abcdefghijkl')} in general talk on a day")
        if i % 10 == 1:
            lines.append("Read more")
            lines.append("Read more")
        out.append((i * 2, "\n".join(lines)))
    return out + [(1001, None), (1002, ""), (1003, "\n\n"), (None, "Read more\nRead more"), *corpus(40, 9)[:5]]


def test_query(spark):
    own = [(d if k < 154 else 5000 + k, t) for k, (d, t) in enumerate(rows())]
    got = sorted(map(tuple, templates.lines_query(frame(spark, [(*r, 1) for r in own], "doc_id long, text string, parsed int")).collect()), key=str)
    assert got == brute(own)
    assert sum(r[2] for r in got) > 60


def test_parameters(spark):
    own = rows()[:154]
    for depth, share, least, first in ((1, 0.8, 3, False), (4, 0.3, 20, True)):
        out = templates.without_templates(frame(spark, own), depth, share, least, first).select("doc_id", "parsed.*").collect()
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in out), key=str)
        assert got == brute(own, depth, share, least, first)


def test_rows_keep_their_columns(spark):
    docs = frame(spark, [(d, t, "en", len(t or ""), 1, 2, 3) for d, t in rows()], "doc_id long, text string, lang string, n_chars long, parsed int, dropped int, line int")
    got = templates.deduped_rows(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    collected = got.collect()
    assert {(r.parsed, r.dropped, r.line) for r in collected} == {(1, 2, 3)}
    assert len(collected) == docs.count() and all(r.n_chars == len(r.text) for r in collected if r.text is not None)
    assert templates.lines_query(frame(spark, [])).count() == 0


def test_repeated_rows_count_once(spark):
    own = [(7, "Read more of this")] * 12 + [(9, "x")]
    assert {r.n_dropped for r in templates.lines_query(frame(spark, own)).collect()} == {0}


def test_rows_of_one_id_with_different_texts(spark):
    """A line goes from the row that has it, not from the same place of another row of the id."""
    own = [(k, "Read more of this") for k in range(12)] + [(20, "first\nRead more of this"), (20, "Read more of this\nkept"), (20, "other\nlines")]
    out = templates.without_templates(frame(spark, own)).filter("doc_id = 20").select("parsed.kept_text", "parsed.n_dropped").collect()
    assert sorted(map(tuple, out)) == [("first", 1), ("kept", 1), ("other\nlines", 0)]


def test_clashing_names(spark):
    docs = frame(spark, [(1, "a", 2, 3, 4, 5)], "doc_id long, text string, __id int, __dropped int, __parsed int, dropped_lines int")
    got = templates.deduped_rows(docs)
    assert got.columns == docs.columns and list(map(tuple, got.collect())) == [(1, "a", 2, 3, 4, 5)]
    with pytest.raises(ValueError):
        templates.without_templates(docs, name="__parsed")


def test_very_many_lines(spark):
    """Lines are told from dropped ones without comparing each with each."""
    long = "\n".join(line for k in range(30_000) for line in ("Read more of this", f"w{k}"))
    own = [(k, "Read more of this") for k in range(12)] + [(50, long)]
    row = templates.without_templates(frame(spark, own)).filter("doc_id = 50").select("parsed.*").first()
    assert (row.kept_text, row.n_dropped) == ("\n".join(f"w{k}" for k in range(30_000)), 30_000)
