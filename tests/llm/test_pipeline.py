"""The pipeline's stages one by one, on planted rows."""

import corpus_pipeline as P
from folia.llm.common import table
from tests.llm import cases


def test_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = table(spark, data, "documents")
    item = table(spark, data, "benchmark").orderBy("item_id").limit(2).collect()
    text = docs.where("lang = 'en' AND n_chars > 1000").orderBy("doc_id").first().text
    plant = spark.createDataFrame([(9001, text, "en", "src0", 1), (9002, "12 34", "en", "src0", 1), (9003, f"{cases.words(1, 60)} {item[0].text} {cases.words(2, 60)} {item[1].text}", "en", "src1", 1), (9004, f"the and of this mail a.b@c.example {cases.words(8, 40)}", "en", None, 1), (None, None, None, None, None)], docs.schema)
    df = docs.unionByName(plant).withColumn("score", docs["doc_id"])
    seen = []
    for name, stage in P.STAGES:
        df = stage(spark, df, data)
        if name != "packing":
            assert df.columns == list(P.COLUMNS)
            df = df.cache()
        seen.append({r.doc_id: r for r in df.collect()})
    language, near, bench, private, packed = seen
    assert 9002 not in language and None not in language and len(language) >= 200
    assert 9001 not in near and 9003 in near and len(near) < len(language)
    assert 9003 not in bench
    assert "[EMAIL]" in private[9004].text and private[9004].n_chars == len(private[9004].text) and set(private) == set(bench)
    assert set(packed) == set(private)


def test_empty(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents").where("false")
    for _, stage in P.STAGES:
        df = stage(spark, df, "/root/testdata/sf0.001")
    assert df.collect() == []
