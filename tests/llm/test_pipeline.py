"""The stages of the pipeline against brute force, and odd inputs."""

import corpus_pipeline
from tessera.llm import jaccard
from tests.llm.test_jaccard import brute as components_of
from tests.llm.test_substrings import brute as removed_of
from tests.llm.test_tokens import check_packing


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    one = corpus_pipeline.language_id(spark, docs, sf_dir).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} >= {r.doc_id for r in docs.collect() if len(r.text) > 100}
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    groups = components_of([(r.doc_id, r.text) for r in one.collect()], jaccard.Measure(5, 80, 100))
    assert {r.doc_id for r in two.collect()} == {d for d, _, c in groups if d == c} and two.columns == columns
    three = corpus_pipeline.repeated_passages(spark, two, sf_dir).cache()
    removed = {d: (n, gone) for d, n, gone, _ in removed_of([(r.doc_id, r.text) for r in two.collect()])}
    rows = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and set(rows) == {d for d, (n, gone) in removed.items() if gone < n or not n}
    assert all(len(r.text.split()) == removed[d][0] - removed[d][1] and r.n_chars == len(r.text) for d, r in rows.items())
    check_packing(corpus_pipeline.packed(spark, three, sf_dir).collect(), [(d, r.text) for d, r in rows.items()])


def test_odd_documents(spark):
    text = "the cat sat on the mat and looked at the dog " * 8
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, text, "en", "a", 5), (3, text, None, "a", 5), (3, text, "en", "a", 5), (4, text, "en", None, None), (5, "123 456", "en", "a", 1), (6, "x " * 30_000, "en", "a", 1), (7, "der Hund und die Katze", "de", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "")
        got = {r.doc_id for r in d.collect()}
        assert got == (set() if empty else {3, 6, 7})


def test_repeated_ids_and_clashing_names(spark):
    """Different texts of one doc_id are different documents; names that the stages use are kept as they are."""
    base = [f"{a} {b}" for a in ("the old cat", "a young dog", "my little house", "this green tree", "your long way") for b in ("sat on the mat", "ran over the hill", "went down to the sea", "looked at the moon", "came home again")]
    one, two, three = (" ".join(base[k::3] * 2) for k in range(3))
    near = one + " too"
    extra = {"score": 1.5, "lang_pred": "x", "mark": 7, "state": "s", "node": 9, "component_id": 3, "key": "k", "at": 4, "predicted": "p", "first": 2, "bucket": 1}
    rows = [(7, one), (7, two), (7, one), (3, near), (9, three), (9, three), (8, two + " " + " ".join(f"w{i}" for i in range(400)))]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t), *extra.values()) for d, t in rows], ["doc_id", "text", "lang", "source", "n_chars", *extra])
    d = corpus_pipeline.language_id(spark, docs, "")
    assert d.columns == docs.columns and d.count() == len(rows)
    d = corpus_pipeline.near_duplicates(spark, d, "")
    assert d.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in d.collect()) == sorted([(7, two), (3, near), (9, three), rows[-1]])
    three_ = corpus_pipeline.repeated_passages(spark, d, "")
    assert three_.columns == docs.columns
    got = sorted((r.doc_id, len(r.text.split()), r.score, r.mark) for r in three_.collect())
    left = {d: n - gone for d, n, gone, _ in removed_of([(r.doc_id, r.text) for r in d.collect()])}
    assert got == sorted((d, n, 1.5, 7) for d, n in left.items()) and left[8] < 410
    assert corpus_pipeline.packed(spark, three_, "").count() >= 4
