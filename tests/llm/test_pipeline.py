"""The stages against brute force, each on its predecessor's rows."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from inkfold.llm.bpe import default_tokenizer
from inkfold.llm.mixing import mix_sources
from inkfold.llm.toxicity import fit_toxicity, score_texts
from inkfold.session import scratch_path
from tests.llm import brute
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_secret_scan import masked


def stages(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean, unique, safe, mixed, counted = stages(spark, docs, sf)[1:]
    assert clean.columns == unique.columns == safe.columns == mixed.columns == docs.columns

    model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.orderBy("doc_id").collect()
    want = [r for r, s in zip(rows, score_texts(model, [r.text for r in rows]), strict=True) if s < 0.7]
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, want))

    classes = brute_classes([r.text for r in want])
    assert sorted(map(tuple, unique.collect())) == sorted(tuple(r) for i, r in enumerate(want) if classes[i] == i)

    before = {r.doc_id: r for r in unique.collect()}
    after = {r.doc_id: r for r in safe.collect()}
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert r.text == masked(before[i].text) and r.n_chars == len(r.text) and not brute.base_spans(r.text)

    copies = {r.doc_id: r.copies for r in mix_sources(safe).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    tok = Tokenizer.from_file(default_tokenizer())
    sizes = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    got = counted.collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == sizes
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)
    assert corpus_pipeline.run(spark, sf).count() == mixed.count()


def test_nulls_repeats_and_empty(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"
    odd = [(None, None, None, None, None, "a"), (1, "", "en", "s", 0, "b"), (1, "", "en", "s", 0, "b"), (2, "password=abcdef12 x", None, None, 19, "c"), (2, "other words here", "en", "s", 16, "d")]
    out = stages(spark, spark.createDataFrame(odd, schema), sf)
    # A null text is an empty text: one of the three stays.
    assert [d.count() for d in out[:4]] == [5, 5, 3, 3] and out[5].count() == out[4].count()
    empty = stages(spark, spark.createDataFrame([], schema), sf)
    assert [d.count() for d in empty] == [0] * 6


def test_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries()) == 1
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())
