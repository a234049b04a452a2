import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokencounts

from .texts import corpus, frame

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(library, texts, rule):
    """Sections by a plain loop over tokens and sections, in bytes, with token bytes from the library's vocabulary."""
    shown = {c: b for b, c in enumerate(byte_characters())}
    joined = "\n".join(t or "" for t in texts)
    spans, at = [], 0
    for k, t in enumerate(texts):
        for number, line in enumerate((t or "").split("\n")):
            end = at + len(line) + 1
            spans.append([k, number, at, end])
            at = end
    spans[-1][3] -= 1
    counts = [[0.0, 0] for _ in spans]
    encoded = library.encode(joined, add_special_tokens=False)
    byte_of = [len(joined[:i].encode()) for i in range(len(joined) + 1)]
    at = 0
    for token in encoded.tokens:
        size = len([shown[c] for c in token])
        touched = [(min(at + size, byte_of[e]) - max(at, byte_of[s]), i) for i, (_, _, s, e) in enumerate(spans)]
        touched = [(n, i) for n, i in touched if n > 0]
        counts[touched[0][1]][1] += len(touched) > 1
        if rule == "start":
            counts[touched[0][1]][0] += 1
        elif rule == "most":
            counts[max(touched, key=lambda x: (x[0], -x[1]))[1]][0] += 1
        else:
            for n, i in touched:
                counts[i][0] += n / size
        at += size
    return [(k, number, s, e, round(c, 9), x) for (k, number, s, e), (c, x) in zip(spans, counts)], len(encoded.ids)


def byte_characters():
    from tessera.llm.bpe import byte_alphabet

    return byte_alphabet()


TEXTS = ["", None, "a\n\n\nb", "\n", "\n\n\n   \n", "x  \n  y", "Ünï\ncode — 漢字\n😀😀\n", "<|endoftext|>\nz"]


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_sections_of_fields(spark, library, rule):
    texts = TEXTS + [t for _, t in corpus(30)[:12] if t and len(t) < 4000]
    rows = [(i, t, texts[(i * 5 + 1) % len(texts)]) for i, t in enumerate(texts)]
    out = tokencounts.attributed_tokens(frame(spark, rows, "doc_id long, text string, field string"), RANKS, PATTERN, ("text", "field"), rule)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((["text", "field"].index(r.field), r.section, r.first_char, r.past_char, round(r.n_tokens, 9), r.n_crossing))
    for i, a, b in rows:
        want, n = brute(library, (a, b), rule)
        assert sorted(got[i]) == want
        assert sum(r[4] for r in want) == pytest.approx(n)


def test_query_and_odd_rows(spark, library):
    rows = [*corpus(24)[:10], (None, "no\nid"), (1, "twice"), (1, "twice")]
    got = tokencounts.lines_query(frame(spark, rows), RANKS, PATTERN).collect()
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for d, t in rows:
        want[d] = want.get(d, 0) + len(library.encode(t or "", add_special_tokens=False).ids)
    assert totals == want
    assert tokencounts.lines_query(frame(spark, []), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        tokencounts.attributed_tokens(frame(spark, []), RANKS, PATTERN, rule="end")


def test_very_long_runs(spark):
    """Runs of white space that the library cannot match, and a word without end, give the tokens of their pieces."""
    encoder = tokencounts.Encoder(open(RANKS, "rb").read(), PATTERN)
    short = ["ab  cd " + " " * 300 + "x\t\t \n\n y", "\x1c \x1d z\u2003\u00a0 q"]
    for text in short:
        by_pieces = [i for p in encoder.pieces.finditer(text) for i in encoder.encoding._encode_single_piece(p.group().encode())]
        assert by_pieces == encoder.encoding.encode_ordinary(text)
    rows = [(1, " " * 2_000_000), (2, "w" * 500_000), (3, "a" + " \t" * 100_000 + "\nb")]
    got = tokencounts.lines_query(frame(spark, rows), RANKS, PATTERN).collect()
    assert sorted((r.doc_id, r.section, r.past_char - r.first_char) for r in got) == [(1, 0, 2_000_000), (2, 0, 500_000), (3, 0, 200_002), (3, 1, 1)]
    assert all(r.n_tokens > 0 for r in got)
