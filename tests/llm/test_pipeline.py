"""The pipeline: each stage against brute force on its own input, edge rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from riskframe.llm import langid, packing, toxicity
from test_packing import check
from test_simhash import brute_components, brute_fingerprint
from test_substring import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and result of every stage on the documents of SF."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        new = spark.read.parquet(str(folder / name))
        out[name] = (docs, new, docs.toPandas(), new.toPandas())
        docs = new
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "repeated_passages", "packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(steps[name][3].columns) == COLUMNS
        assert dict(steps[name][1].dtypes) == dict(steps[name][0].dtypes)


def test_filters_follow_their_models(spark, steps):
    docs, _, _, kept = steps["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~corpus_pipeline.held_out(0, 5))
    model = toxicity.train(docs, "doc_id", "text", labels, "doc_id", "toxic")
    want = toxicity.score(docs, "doc_id", "text", model).where("score < 0.5").toPandas()
    assert sorted(kept.doc_id) == sorted(want.id) and len(kept) < docs.count()
    docs, _, _, kept = steps["language"]
    want = langid.identify(docs, "doc_id", "text", langid.train(docs, "text", "lang")).where("not rejected").toPandas()
    assert sorted(kept.doc_id) == sorted(want.id) and len(kept) > 0.97 * docs.count()


def test_one_of_each_group_stays(steps):
    _, _, docs, kept = steps["near_duplicates"]
    docs = docs.sort_values("doc_id")
    label = brute_components(list(docs.doc_id), [brute_fingerprint(t) for t in docs.text])
    assert sorted(kept.doc_id) == sorted(set(label)) and len(kept) < len(docs)
    assert kept.merge(docs, on=COLUMNS).shape[0] == len(kept)


def test_passages_go_and_other_texts_stay(steps):
    _, _, docs, out = steps["repeated_passages"]
    both = docs.sort_values("doc_id").merge(out, on="doc_id", suffixes=("", "_new"))
    assert len(both) == len(docs) == len(out)
    for (_, r), (_, removed, kept) in zip(both.iterrows(), brute(both.text), strict=True):
        assert r.text_new == (kept if removed else r.text) and r.n_chars_new == len(r.text_new)


def test_packing_holds_every_document(steps):
    _, _, docs, out = steps["packing"]
    tokens = {i: len(t.encode().split()) + 1 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    check(list(out.itertuples(index=False, name=None)), tokens, packing.LENGTHS)


def test_run_is_the_stages_and_is_registered(spark, steps):
    got = E.queries()["pipeline"](spark, SF).toPandas()
    want = steps["packing"][3]
    assert sorted(zip(got.doc_id, got.piece, got.length, strict=True)) == sorted(zip(want.doc_id, want.piece, want.length, strict=True))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()


def test_edge_rows_and_extra_columns(spark, tmp_path):
    words = " ".join(f"wort{i % 13} the and on in" for i in range(30))
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (3, words, "en", "s", 1, 1, "x"),
            (3, words, "en", "s", 1, 1, "x"), (None, words + " more", "en", "s", 1, 1, "x"), (7, "1234", "en", "s", 4, 1, "x"),
            (None, "quite another text that has an end", "en", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, kept string")
    for d in (docs, docs.limit(0)):
        folder = tmp_path / f"t{d.count()}"
        spark.createDataFrame([(3, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        now = d
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, str(folder)).write.parquet(str(folder / str(i)))
            new = spark.read.parquet(str(folder / str(i)))
            if i < 4:
                assert new.dtypes == d.dtypes
            now = new
    third = spark.read.parquet(str(tmp_path / "t7" / "2"))
    assert sorted((r.doc_id or 0) for r in third.select("doc_id").collect()) in ([0, 3], [0, 0, 3])
    assert third.where(F.col("doc_id") == 3).count() == 1


def test_stages_bound_the_bytes_of_a_batch(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", 400
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.column("text").nbytes]})

    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        corpus_pipeline.packing_stage(spark, docs, SF)
        got = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert max(got) < 2 * corpus_pipeline.BATCH_BYTES < sum(got)
        spark.conf.set(key, "1000")  # a lower bound of the session stays
        corpus_pipeline.packing_stage(spark, docs, SF)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
