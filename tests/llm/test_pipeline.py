"""The stages on a small corpus: what each decides takes effect, and run() equals the stages by hand."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    clean = [(i, text(120)) for i in range(60)]
    junk = [(100 + i, "".join(rng.choice("XQZ#$%&*9") for _ in range(300))) for i in range(5)]
    item = text(20)
    dirty = [(200, text(60) + " " + item + " " + text(40))]
    copies = [(300, clean[0][1]), (301, clean[1][1] + " extra")]
    secret = [(400, text(300) + " password: hunter2222 " + text(300))]
    every = clean + junk + dirty + copies + secret
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, {i for i, _ in every}
    gone = [{i for i, _ in junk}, {300, 301}, {200}, set()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        if k < 4:
            left -= gone[k]
            assert docs.columns == columns and {r["doc_id"] for r in docs.select("doc_id").collect()} == left
    hand = {r["doc_id"]: r["ids_crc32"] for r in docs.collect()}
    text = spark.read.parquet(f"{sf}/out3").where("doc_id = 400").first()
    assert "hunter2222" not in text["text"] and "[SECRET]" in text["text"] and text["n_chars"] == len(text["text"])
    assert {r["doc_id"]: r["ids_crc32"] for r in corpus_pipeline.run(spark, sf).collect()} == hand and set(hand) == left
