import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from test_packing import check
from test_simhash_trie import expected_without
from test_suffix_dedup import brute as brute_passages
from wavedeck.llm.quality_rank import features, fit


def test_run_is_brute_force(spark, sf_dir, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    taught = sorted(((labels[i], features(t)) for i, t in rows if i in labels), key=str)
    model = fit(np.array([x for _, x in taught]), np.array([y for y, _ in taught]))
    kept = [r for r, s in zip(rows, model.scores(np.array([features(t) for _, t in rows]))) if s >= 0.7]
    assert sum(labels.get(i) == 0 for i, _ in kept) <= 0.03 * sum(y == 0 for y in labels.values())
    assert sum(labels.get(i) == 1 for i, _ in kept) >= 0.97 * sum(y == 1 for i, y in labels.items())
    single = expected_without(kept)
    kept = [r for r in kept if r[0] in single]
    cut = [(i, k.decode(errors="ignore")) for (i, _), (_, k) in zip(kept, brute_passages(kept))]
    ids = [np.array(e.ids + [1], dtype="<u4").tobytes() for e in Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch([t for _, t in cut], add_special_tokens=False)]
    check(corpus_pipeline.run(spark, sf_dir).collect(), list(zip([i for i, _ in cut], ids)), 4096)


def test_stages_keep_the_columns(spark, sf_dir, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes




def test_odd_rows_and_columns(spark, sf_dir, odd_docs):
    """Nulls in any column, empty and repeated rows, and columns named as the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, `a.b` int, spans int, id long"
    rows = [(*d[:5], 1.0, "k", 1, None, 7) for d in odd_docs]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = part
            part = stage(spark, part, sf_dir)
            assert part.dtypes == before.dtypes and part.count() <= before.count()
            assert all(r.kept == "k" and r.id == 7 and r.score == 1.0 for r in part.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, part, sf_dir)
        assert packed.select("doc_id").distinct().count() == part.select("doc_id").distinct().count()
