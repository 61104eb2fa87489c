"""The pipeline's stages on the smallest table, each against a plain version on its own input."""

import collections

from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from tidewave.llm import decontamination, mixing, overlap, queries, sstable, toxicity
from tidewave.llm.common import local_rows, text_node

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_the_operators_do(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((before, docs))
    (raw, clean), (_, single), (_, free), (_, mixed), (_, tokens) = kept
    assert all(d.columns == columns for _, d in kept[:-1])
    model = queries.toxicity_model(spark, SF)
    passed = {r["doc_id"] for r in toxicity.score(raw, model).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == passed
    texts = [r["text"] for r in single.collect()]
    assert len(texts) == len(set(texts)) <= clean.count()
    items = [decontamination.normalise(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    assert not any(i in decontamination.normalise(r["text"]) for r in free.collect() for i in items)
    plan = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(free).collect() if r["copies"]})
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == plan
    whole = queries.sstable.encoder(queries.tokenizer_path()).whole
    expect = collections.Counter((r["doc_id"], len(whole.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in tokens.collect()) == expect


def test_a_worker_gives_up_the_tokenizer_when_another_stage_begins():
    import numpy as np
    import pyarrow as pa

    from tidewave.llm import toxicity
    from tidewave.llm.common import release
    from tidewave.llm.queries import tokenizer_path
    from tidewave.llm.tokens import encoder

    held = encoder(tokenizer_path())
    release(encoder)
    assert encoder(tokenizer_path()) is held and encoder.cache_info().currsize == 1
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    (scored,) = toxicity._margin_task(toxicity.Model(np.zeros(toxicity.SYMBOLS**3), 1.0, 0.0))([batch])
    assert scored.column(0).to_pylist() == [1, 2] and encoder.cache_info().currsize == 0


def test_rows_of_the_driver_need_no_python_workers_of_their_own(spark, monkeypatch):
    rows = [("ä", 1, 0.5), (None, 2, None)]
    for some in (rows, []):
        made = local_rows(spark, some, "source string, n long, target double")
        assert made.schema.simpleString() == "struct<source:string,n:bigint,target:double>"
        assert [tuple(r) for r in made.collect()] == some
    dealt, parallelize = [], SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a: dealt.append(a) or parallelize(self, *a))
    mixed = mixing.apply(queries.table(spark, SF, "documents"))
    listed = sstable.read(spark, [{"file": "/none", "tokens": 1}])
    assert mixed.columns and listed.columns and not dealt


def test_a_task_of_near_duplicates_shingles_its_sample_in_one_worker(spark):
    texts = queries.table(spark, SF, "documents").select(F.col("text").alias("_text"), text_node(F.col("text")).alias("_hash"))
    each = overlap._sampled(texts, 5)
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    expect = {(r["_hash"], s) for r in texts.collect() if r["_hash"] % overlap.SAMPLE == 0 for s in overlap.shingles_of((r["_text"] or "").encode(), 5).view("int64").tolist()}
    assert expect and {tuple(r) for r in each.collect()} == expect and each.count() == len(expect)


def test_a_worker_holds_the_vocabulary_once(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import tokenizers

    from tidewave.llm.tokens import WordEncoder

    read, real = [], tokenizers.Tokenizer

    class Counted:
        def __new__(cls, model):
            return real(model)

        @staticmethod
        def from_file(path):
            read.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    coder = WordEncoder(queries.tokenizer_path())
    assert len(read) == 1
    texts = ["Some WORDS, some <|endoftext|> more; co-op's 12 Été <| |> x_y", "", "naïve déjà-vu (e.g.) 中文 <|startoftext|>"]
    found = [np.frombuffer(x, coder.type).tolist() for x in coder.encode(pa.array(texts))]
    assert found == [real.from_file(queries.tokenizer_path()).encode(t, add_special_tokens=False).ids for t in texts]
