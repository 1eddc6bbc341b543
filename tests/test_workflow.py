import json

import pytest

from tonelens import workflow


def test_from_raw_lines_to_predictions(spark, tmp_path):
    raw = tmp_path / "raw.json"
    lines = []
    for i in range(300):
        mood = ["red alarm", "loud siren"][i % 2] if i % 4 == 0 else ["calm river", "green tree", "open field"][i % 3]
        tag = "".join("abcdefghij"[int(d)] for d in str(i))
        lines.append(json.dumps({"headline": f"{mood} {tag}", "is_sarcastic": int(i % 4 == 0), "article_link": "x"}))
    raw.write_text("\n".join(lines + [lines[0], json.dumps({"headline": "123", "is_sarcastic": 1})]) + "\n")
    splits, out = str(tmp_path / "splits"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        workflow.train(spark, splits, out)
    split = workflow.prepare(spark, str(raw), splits)
    assert dict(split.groupBy("split").count().collect()) == {"train": 210, "val": 45, "test": 45}
    workflow.train(spark, splits, out, folds=3, grid_c=[1.0], max_iter=30)
    rows = {r.model: r for r in workflow.compare(spark, out).collect()}
    assert rows["Naive Baseline"].recall == 0.0 and rows["TF-IDF + LR"].accuracy > 0.95
    new = spark.createDataFrame([(1, "RED alarm!"), (2, "A calm river"), (3, "http://x")], "row_id long, text string")
    external = spark.createDataFrame([(3, 0.25)], "row_id long, prob double")
    got = {r.row_id: r for r in workflow.predict(new, out, external).collect()}
    assert (got[1].polarity, got[1].model_used) == ("SARCASTIC", "TF-IDF + LR")
    assert got[2].polarity == "NOT SARCASTIC"
    assert (got[3].model_used, got[3].confidence_text, got[3].prob_4) == ("External", "75.0%", 0.25)
    curve = workflow.experiment(spark, out, str(tmp_path / "curve"), fractions=[0.5], grid_c=[1.0], max_iter=10)
    assert curve.count() == 2


def test_the_split_does_not_depend_on_the_layout(spark, tmp_path):
    lines = [json.dumps({"headline": f"headline {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} number {'x' * (i % 7)}", "is_sarcastic": i % 2}) for i in range(900)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "three").mkdir()
    for k in range(3):
        (tmp_path / "three" / f"{k}.json").write_text("\n".join(lines[300 * k : 300 * (k + 1)]) + "\n")
    found = []
    for name, size in (("one", "128m"), ("one", "4k"), ("three", "4k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        split = workflow.prepare(spark, str(tmp_path / name), str(tmp_path / f"out-{name}-{size}"))
        found.append(sorted((r.text, r.label, r.split) for r in split.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2]
