"""The pipeline's stages one after the other on a small table with planted cases."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(12)
    clean = [(k, f"{text(40)}\n{text(60)}", ("en", "de")[k % 2], "s", 0) for k in range(40)]
    item = text(30)
    cases = [
        (100, "12 34 !!", "en", "s", 8),
        (101, None, "en", "s", 0),
        (102, f"{shared}\n{text(80)}", "en", "s", 0),
        (103, f"{shared}\n{text(80)}", "de", "s", 0),
        (104, clean[3][1], "de", "s", 0),
        (105, f"{text(20)} {item} {text(20)}", None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(clean + cases, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "packing":
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in d.collect()}
    everyone = {k for k, *_ in clean + cases}
    assert set(kept["language_id"]) == everyone - {100, 101}
    assert kept["line_dedup"][103]["text"].startswith(cases[3][1].split("\n")[1]) and shared in kept["line_dedup"][102]["text"]
    assert kept["line_dedup"][104]["text"] == "" and kept["line_dedup"][104]["n_chars"] == 0
    assert set(kept["near_dedup"]) == everyone - {100, 101}
    assert set(kept["decontamination"]) == everyone - {100, 101, 105}
    assert set(kept["packing"]) == set(kept["decontamination"])
    assert sorted(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["length"] for r in d.collect())
