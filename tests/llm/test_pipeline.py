import corpus_pipeline
from quaver.llm import quality
from tests.llm import brute


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    now, made = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, small).write.parquet(str(tmp_path / name))
        now = made[name] = spark.read.parquet(str(tmp_path / name))
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    rules = quality.learn_rules(quality.labelled_rows(docs, labels))
    kept = {r.doc_id for r in quality.apply_rules(docs, rules).filter("kept").collect()}
    first = {i: t for i, t in text(docs).items() if i in kept}
    assert text(made["quality_rules"]) == first
    cut = brute.lines(list(first.items()))
    second = {i: t for i, (n, gone, t) in cut.items() if not gone or gone < n}
    assert text(made["line_dedup"]) == second
    third = {i: second[i] for i, (n, c) in brute.components(list(second.items()), 5, 80).items() if i == c or not n}
    assert text(made["near_duplicates"]) == third
    fourth = {i: t for i, t in third.items() if not brute.contamination(t, bench)[4]}
    assert text(made["benchmark_decontamination"]) == fourth
    assert {r.doc_id for r in now.collect()} == set(fourth)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert made[name].columns == docs.columns
