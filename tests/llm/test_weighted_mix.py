from thermaline.llm.mixing import mix_corpus


def test_inclusion_follows_the_weight(spark):
    # documents of equal size; half of source b is drawn, and its documents of weight 9 are likelier than those of weight 1
    docs = [(i, "the same words again", "a", 1) for i in range(200)] + [(1000 + i, "the same words again", "b", 9 if i % 2 else 1) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_files int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    equal, weighted = mix_corpus(df, targets), mix_corpus(df, targets, weight="n_files")
    heavy = lambda m: m.chosen.filter("source = 'b' AND doc_id % 2 = 1").count()
    assert 75 < heavy(equal) < 125 and heavy(weighted) > 150
    for m in (equal, weighted):
        shares = {r.source: r.actual_share for r in m.report.collect()}
        assert abs(shares["a"] - 0.5) < 0.005 and abs(shares["b"] - 0.5) < 0.005
