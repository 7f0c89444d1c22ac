from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm.common import cut


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, None), (1, c), (1, c), (2, c), (3, d), (3, b + " end"), (4, a + " end"), (5, ""), (6, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    texts = [t for _, t in out]
    assert len(out) == len(set(out)) and {(None, None), (1, c), (5, ""), (6, "")} <= set(out) and texts.count(c) == texts.count(d) == 1
    assert sum(t in (a, a + " end") for t in texts) == sum(t in (b, b + " end") for t in texts) == 1


def stage_inputs(spark, tmp_path, docs):
    """A folder with labels and a benchmark, and the stages' input: plain, toxic, odd and repeated rows beside a clashing column."""
    good = [(k, " ".join(f"w{(k * 7 + n * n) % 97}" for n in range(40)) + f" plain end {k}") for k in range(100, 160)]
    bad = [(k, f"you are a zorgwit and a blatherskite, number {k}") for k in range(200, 240)]
    text = docs.select("doc_id", "text").unionByName(spark.createDataFrame(good + bad, "doc_id long, text string"))
    spark.createDataFrame([(k, int(k >= 200)) for k, _ in good + bad], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage = " ".join(f"bench{n}" for n in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return text.unionByName(spark.createDataFrame([(300, "before it " + passage + " after it")], "doc_id long, text string"))


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = stage_inputs(spark, tmp_path, odd.where("doc_id <> 5"))
    for extra in ("lang", "source", "sig", "n_lines", "_gone", "_n", "_row", "_several", "_first", "key", "row", "n", "several"):
        docs = docs.withColumn(extra, F.lit("x"))
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))
    docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = cut(stage(spark, rows, str(tmp_path)), name)
        assert set(rows.columns) == set(docs.columns), name
    left = {r.doc_id for r in rows.select("doc_id").collect()}
    assert set(range(100, 160)) <= left and {2, 3, 4, 7, 8} <= left, sorted(set(range(100, 160)) - left)
    assert 300 not in left and len({1, 6} & left) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
    assert last.count() == rows.count()


def test_stages_on_an_empty_table(spark, none, tmp_path):
    stage_inputs(spark, tmp_path, none.select("doc_id", "text"))
    docs = none.withColumn("n_chars", F.lit(0).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0, name


def test_training_takes_one_text_of_a_repeated_document(spark, monkeypatch):
    """A doc_id with very many rows brings one row into the sample that is held and sent."""
    from kbspark.llm import toxicity

    rows = [(k, f"you zorgwit number {k}" if k < 20 else f"plain words in document {k}") for k in range(60)] + [(25, f"plain words again {n}") for n in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(60)], "doc_id long, toxic int")
    sizes, count = [], toxicity._word_evidence
    monkeypatch.setattr(toxicity, "_word_evidence", lambda sample: sizes.append(sample.count()) or count(sample))
    toxicity.train(docs, labels)
    assert sizes == [60]
