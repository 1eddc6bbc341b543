import pytest
from pyspark.sql import functions as F

from tonelens.operators import metrics
from tonelens.operators.cleaning import prepare_corpus
from tonelens.sources import artifacts, corpus
from tonelens.sources.tables import read_table


def test_jsonl_scan(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text('{"headline": "A b", "is_sarcastic": 1, "article_link": "x"}\n\n{"headline": "a B!", "is_sarcastic": 0}\n{"headline": "ça", "is_sarcastic": null}\n', encoding="utf-8")
    df = corpus.with_position(corpus.read_jsonl(spark, str(path)), "row_id")
    assert df.count() == 3 and df.columns == ["headline", "is_sarcastic", "article_link", "row_id"]
    assert [(r.text, r.label) for r in prepare_corpus(df, "headline", "is_sarcastic", "row_id").collect()] == [("a b", 1)]
    path.write_text('{"headline": \n', encoding="utf-8")
    with pytest.raises(Exception):
        corpus.read_jsonl(spark, str(path)).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_split_round_trip(spark, tmp_path, fmt):
    rows = [("it's a \"quote\", yes", 1, "train"), ("b", 0, "val"), ("c", 1, "test")]
    df = spark.createDataFrame(rows, "text string, label int, split string")
    corpus.write_splits(df, str(tmp_path / "s"), fmt)
    back = corpus.read_splits(spark, str(tmp_path / "s"), fmt)
    assert {(r.text, r.label, s) for s, d in back.items() for r in d.collect()} == set(rows)
    corpus.write_splits(df.filter("split <> 'val'"), str(tmp_path / "t"), fmt)
    with pytest.raises(FileNotFoundError, match="val"):
        corpus.read_splits(spark, str(tmp_path / "t"), fmt)


def test_comparison_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.123456, 0.5, 0.5, 0.5, 0.5)], artifacts.COMPARISON_SCHEMA)
    artifacts.write_comparison(df, str(tmp_path / "c"))
    assert artifacts.read_comparison(spark, str(tmp_path / "c")).first().accuracy == 0.1235
    rows = spark.createDataFrame([("x", "Sincere", "Sarcastic", 0.5)], "text string, t string, p string, c double")
    report = metrics.evaluation_report(rows, "text", "t", "p", "c")
    artifacts.write_report(report, str(tmp_path / "r"))
    back = artifacts.read_report(spark, str(tmp_path / "r"), {"per_class": "label string, support long", "summary": "accuracy double"})
    assert back["per_class"].count() == 4 and back["summary"].first().accuracy == 0.0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in read_table(spark, str(tmp_path / "one")).filter(F.col("id") > 5)._jdf.queryExecution().executedPlan().toString()


def test_line_breaks_survive_in_result_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'two\nlines, "quoted"', 0.5), (2, "one", 0.25)], "id int, text string, c double")
    artifacts.write_table(rows, str(tmp_path / "e"))
    back = artifacts.read_table(spark, str(tmp_path / "e"), "id int, text string, c double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
