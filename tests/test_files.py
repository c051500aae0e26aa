from orrery.sources import files
from orrery.streaming import degrees


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("a,b\n1,2\n2,2\n1,2\n")
    assert files.read_edges(spark, str(path)).count() == 3
    assert files.read_edges(spark, str(path), drop_loops=True).count() == 2
    nodes = tmp_path / "nodes.csv"
    nodes.write_text("views,mature,life_time,created_at,updated_at,numeric_id,dead_account,language,affiliate\n7,1,9,2020-01-02,2020-01-03,0,0,EN,1\n")
    assert round(files.read_nodes(spark, str(nodes)).first()["log_views"], 6) == 2.079442


def test_prediction_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, 1), (1, 0)], "pair_id long, predicted int")
    files.write_predictions(df, str(tmp_path / "out"), "pair_id", "predicted")
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert text == b"Id,Category\r\n1,0\r\n2,1\r\n"
    assert files.markdown_table(df.orderBy("pair_id")).splitlines()[2] == "| 1 | 0 |"


def test_template_is_joined_by_key(spark):
    template = spark.createDataFrame([(2,), (1,)], "id long")
    scored = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, p double")
    assert {r.id: r.p for r in files.fill_template(template, scored, "id", "p").collect()} == {1: 0.1, 2: 0.2}


def test_degree_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = degrees.degree_stream(degrees.edge_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("degree_now").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: (r.out_degree, r.in_degree) for r in spark.table("degree_now").collect()} == {1: (2, 0), 2: (0, 1), 3: (0, 1)}


def test_report_cache_and_ranges(spark, tmp_path):
    from orrery.sources import files

    df = spark.createDataFrame([(i, i / 4) for i in range(5)], "id long, x double")
    table = files.markdown_table(df, 3)
    assert table.splitlines()[-1] == "(2 rows more)" and table.splitlines()[2] == "| 0 | 0.0000 |"
    text = files.markdown_report("Title", [("Text", "words"), ("Figures", {"edges": 6797557, "share %": 0.485}), ("Table", df)])
    assert "- edges: 6,797,557" in text and "- share: 48.5%" in text and text.startswith("# Title\n\n## Text\n\nwords")
    files.write_text(spark, text, str(tmp_path / "report.md"))
    assert (tmp_path / "report.md").read_text() == text
    made = []
    build = lambda: (made.append(1), df)[1]
    for rebuild in (False, False, True):
        assert files.load_cached(spark, str(tmp_path / "graph"), build, rebuild).count() == 5
    assert len(made) == 2
    assert files.write_blend(df, str(tmp_path / "blend"), "id", "x") == (0.0, 1.0)
    back = files.read_inferred(spark, str(tmp_path / "blend"))
    assert back.dtypes == [("ID", "int"), ("Label", "double")]
    assert files.checked_range("transitivity", 0.0184, 0.017, 0.020) == 0.0184
    try:
        files.checked_range("transitivity", 0.5, 0.017, 0.020)
    except ValueError as error:
        assert "transitivity" in str(error)
    else:
        raise AssertionError("no error")
