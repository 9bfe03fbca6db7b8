"""The registered queries on the smallest tables, and the pipeline against a brute-force version."""

import brute
import pytest
from conftest import SMALL, same_rows
from test_llm_operators import brute_contained, digests

import corpus_pipeline
from tallybook.llm.queries import ORACLES, QUERIES, vocabulary

#: The smallest tables hold no secrets in what the pipeline keeps.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df())


COLUMNS = {
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op5_embeddings": ["vec_id", "n_links", "component_id", "kept"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_brown": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op9_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SMALL)
    source = "embeddings" if name == "op5_embeddings" else "documents"
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert found.count() == spark.read.parquet(f"{SMALL}/{source}.parquet").count()


def test_pipeline_against_brute_force(spark):
    """Every stage by a plain version: the classifier on dense tables, five-word similarity of all pairs that share a shingle,
    shingle sets of items, all pairs of spans, the tokenizers library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    labels = dict(map(tuple, spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").collect()))
    scores = brute.toxic_scores([(r.doc_id, r.text) for r in rows], labels)
    rows = [r for r in rows if scores[r.doc_id] < 0.5]
    label = brute.near_copies([r.text for r in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    items = [r.text for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    hit = {w[0] for w in brute_contained([r.text for r in rows], items)}
    rows = [r for k, r in enumerate(rows) if k not in hit]
    t = Tokenizer.from_file(vocabulary())
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, LARGER).collect()}
    assert found.keys() == {r.doc_id for r in rows} and len(rows) < docs.count()
    changed = 0
    for r in rows:
        out, got = brute.redacted(r.text), found[r.doc_id]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == digests(t, out)
        assert got.n_chars == (len(out) if out != r.text else r.n_chars)
        changed += out != r.text
    assert changed


def test_pipeline_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id here at all", None, None, 5), (3, "word " * 50000, "en", "s", 1), (4, "token = 0123456789abcdef0123456789abcdef", "en", "s", 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            if k < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = docs.collect()
        assert sorted(r.doc_id or 0 for r in kept) == ([0, 1, 3, 4] if rows else [])
