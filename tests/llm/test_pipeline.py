import corpus_pipeline as C
from tidemark.llm import toxicity as T

from .conftest import prose


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = [(i, prose(i, 40 + i % 30), "en", f"s{i % 3}", 0) for i in range(300)]
    docs += [(1000 + i, prose(i, 40 + i % 30).upper(), "en", "s", 0) for i in range(10)]  # exact copies of 0 to 9
    near = prose(20, 60).split()
    near[-1] = "zz"
    docs += [(2000, " ".join(near), "en", "s", 0), (3000, f"{prose(7000, 30)} {prose(8000, 25)} {prose(7001, 30)}", "en", "s", 0)]
    docs += [(4000 + i, prose(9000 + i, 30) + " vvbad " + prose(9500 + i, 30), "en", "s", 0) for i in range(40)]
    labels = [(i, 1, 0) for i in range(300)] + [(4000 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(8000, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = at.columns, []
    for n, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{n}")
        at = spark.read.parquet(f"{tmp_path}/stage{n}")
        if n < 4:
            assert at.columns == columns
            kept.append({r.doc_id for r in at.select("doc_id").collect()})
    every = {r[0] for r in docs}
    assert every - kept[0] == {4000 + i for i in range(40)}
    assert kept[0] - kept[1] == set(range(10))
    assert kept[1] - kept[2] == {2000}
    assert kept[2] - kept[3] == {3000}
    assert {r.doc_id for r in at.collect()} == kept[3]
    run = C.run(spark, str(tmp_path))
    assert sorted(run.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(at.select("doc_id", "piece", "length", "ids_crc32").collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert T.Model().score("") < 0.5


def test_repeated_ids(spark, tmp_path):
    """Of repeated rows one passes both dedup stages; another text under the id of a copy stays."""
    near = prose(20, 60).split()
    near[-1] = "zz"
    docs = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (2, prose(3, 50)), (9, prose(2, 50)), (5, prose(20, 60)), (6, " ".join(near)), (6, prose(4, 50))]
    at = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for n, stage in enumerate((C.exact_stage, C.near_stage)):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        at = spark.read.parquet(f"{tmp_path}/stage{n}")
    want = [docs[0], docs[3], docs[4], docs[5], docs[7]]
    assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted(want)


def test_awkward_rows(spark, awkward, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns pass all stages, each with its defined result."""
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 90)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, at, str(tmp_path))
        if n < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/stage{n}")
        at = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in at.select("doc_id").collect()))
    real = [[i for null, i in k if not null] for k in kept]
    # texts 0 to 3 are one, 3 twice, and 4 is near it; 5 and 6 are empty; 8 and 9 are one; 12 is 11 with a word more
    assert real[0] == sorted([*range(17), 3])
    assert real[1] == [3, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16]
    assert real[2] == [3, 6, 7, 9, 10, 11, 13, 14, 15, 16]
    assert real[3] == [i for i in real[2] if i != 13]
    assert sorted(set(real[4])) == real[3] and all(sum(null for null, _ in k) == 2 for k in kept[:4])
