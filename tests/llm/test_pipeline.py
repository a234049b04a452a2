"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm.common import written

from . import test_mixing, test_quality, test_similar, test_templates
from .texts import corpus, frame, sentence


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage, over a small table of documents."""
    import random

    rng = random.Random(12)
    rows = [(d, t, "en", f"src{d % 4}", len(t or "")) for d, t in corpus(150) if not t or len(t) < 50_000]
    rows += [(5000 + k, "\n".join([sentence(rng, 40), "Licensed under the terms of version 2 of this", sentence(rng, 30)]), "en", "src0", 0) for k in range(15)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, ""), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(stages):
    assert list(stages) == ["quality", "lines", "simhash", "mixing", "bpe"]
    for name, (before, after) in stages.items():
        assert name == "bpe" or after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    before, after = stages["quality"]
    assert sorted(pairs(after), key=str) == sorted(((d, t) for d, t in pairs(before) if test_quality.brute(t)[-1]), key=str)
    assert 0 < after.count() < before.count()


def test_lines_stage(stages):
    before, after = stages["lines"]
    want = {r[0]: r[3] for r in test_templates.brute(pairs(before))}
    got = after.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == want and len(got) == before.count()
    assert sum("Licensed" in t for _, t in pairs(after)) == 1


def test_simhash_stage(stages):
    """One document of each group of texts with a five-word similarity of 0.8 or more."""
    before, after = stages["simhash"]
    test_similar.compared(pairs(before), [d for d, _ in pairs(after)])
    assert after.count() < before.count()


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    rows = [(r.doc_id, r.source, r.text) for r in before.collect()]
    assert sorted(d for d, _ in pairs(after)) == sorted(r[0] for r in test_mixing.brute(rows, test_mixing.Mix(max_repeats=1.25)))
    assert {d for d, _ in pairs(after)} == {r[0] for r in rows}


def test_bpe_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages["bpe"]
    text = dict(pairs(before))
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_odd_tables(spark):
    """Every stage over an empty table, and over nulls in all columns, repeated rows and a column of its own."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, parsed string"
    word = " ".join(f"w{k}" for k in range(40))
    rows = [(None, None, None, None, None, None), (None, word, None, None, None, "x"), (3, word, "en", "s", 0, "y"), (3, word, "en", "s", 0, "y"), (4, "", "en", None, 0, "z"), (5, word + " end", None, "s", 1, None)]
    for own in ([], rows):
        docs = frame(spark, own, columns)
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, docs, ""), f"odd-{name}")
            assert name == "bpe" or after.columns == docs.columns
            docs = after
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ({3} if own else set())
