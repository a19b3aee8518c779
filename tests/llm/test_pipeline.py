from collections import Counter

import corpus_pipeline

from . import test_quality_rules, test_simhash
from peltrane.llm import mixing, pii


def test_stages(spark, awkward, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "private_data", "mixture", "packing"]
    for docs in (awkward.select("doc_id", "text", "lang", "source", "n_chars"), small):
        stage = dict(corpus_pipeline.STAGES)
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        kept = stage["quality"](spark, docs, None).cache()
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in test_quality_rules.verdicts(rows) if x[7])
        single = stage["near_dedup"](spark, kept, None).cache()
        groups = {c if c is not None else f for _, f, c in test_simhash.expected([tuple(r) for r in kept.select("doc_id", "text").collect()])}
        assert len(groups) == single.count()
        clean = stage["private_data"](spark, single, None).cache()
        assert clean.columns == docs.columns and clean.count() == single.count()
        mixed = stage["mixture"](spark, clean, None).cache()
        want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(clean).collect() if r.taken}
        assert Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in want.items() if n}
        packed = stage["packing"](spark, mixed, None).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_near_dedup_is_simhash(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words[:57], "a", "b", "c"]), " ".join([*words * 20, "x"]), " ".join(words * 20), None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {c for _, _, c in test_simhash.expected(list(enumerate(texts)))}
    assert 2 in want  # similar to 0 by five-word shingles, not by fingerprint
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, None).collect()} == want


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns[0] == "doc_id"
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter((r.doc_id, r.doc_tokens) for r in out.collect()) == Counter((r.doc_id, r.doc_tokens) for r in again.collect())
