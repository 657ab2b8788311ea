from tidelog.llm import toxicity


def test_few_toxic_texts_dont_make_every_text_toxic(spark):
    """Nine toxic texts of 64 labelled ones give few features; the bias alone must not pass the threshold."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.score("") <= 9 / 64 + 1e-9
    found = toxicity.scored(docs, model).join(labels, "doc_id")
    assert found.where("toxic = 0 and predicted = 1").count() == 0 and found.where("toxic = 1 and predicted = 1").count() >= 5
