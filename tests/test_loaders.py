from karst.sources import tables


def test_dense_and_back(spark, tmp_path):
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, position array<double>")
    for name in ("e.parquet", "e.csv"):
        tables.save_embedding(df, f"{tmp_path}/{name}")
    csv = tables.load_dense(spark, f"{tmp_path}/e.csv", id_col="id").orderBy("id").collect()
    assert [(r.id, r.label, r.features) for r in csv] == [(1, None, [3.0, 4.0]), (2, None, [1.0, 2.0])]
    assert [r.position for r in spark.read.parquet(f"{tmp_path}/e.parquet").orderBy("id").collect()] == [[3.0, 4.0], [1.0, 2.0]]
    spark.createDataFrame([("a", 1, None, "x")], "label string, u int, v double, w string").write.parquet(f"{tmp_path}/t.parquet")
    r = tables.load_dense(spark, f"{tmp_path}/t.parquet", label_col="label").first()
    assert (r.label, r.features) == ("a", [1.0, None])


def test_libsvm(spark, tmp_path):
    (tmp_path / "x.svm").write_text("1 3:0.5 1:2 # note\n\n-1\n0 2:1e-3\n")
    rows = sorted(tables.load_libsvm(spark, f"{tmp_path}/x.svm").collect(), key=lambda r: -r.label)
    assert [(r.label, r.features["indices"], r.features["values"]) for r in rows] == [(1.0, [0, 2], [2.0, 0.5]), (0.0, [1], [0.001]), (-1.0, [], [])]
