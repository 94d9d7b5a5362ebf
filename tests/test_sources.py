"""CSV encoding fallback (SRC1) and order-free content fingerprint (SRC3)."""

import os
import tempfile

from pyspark.sql import functions as F

from retensa.sources.tables import content_fingerprint, read_csv

from .conftest import SF_SMALL


def test_latin1_csv_is_reread(spark):
    d = tempfile.mkdtemp(prefix="retensa-csv-")
    path = os.path.join(d, "customers.csv")
    with open(path, "wb") as f:
        f.write("name,city\nJosé,Málaga\nRené,Zürich\n".encode("latin-1"))
    rows = read_csv(spark, path).collect()
    assert [r["name"] for r in rows] == ["José", "René"]
    assert rows[1]["city"] == "Zürich"
    assert rows == read_csv(spark, path, encoding="ISO-8859-1").collect()


def test_fingerprint_ignores_row_order_and_partitioning(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    a = content_fingerprint(li).first()
    b = content_fingerprint(li.repartition(7).orderBy("l_partkey")).first()
    assert a["fingerprint"] == b["fingerprint"] and a["n_rows"] == b["n_rows"]
    c = content_fingerprint(li.limit(li.count() - 1)).first()
    assert c["fingerprint"] != a["fingerprint"]


def test_json_summary_holds_run_parameters(spark):
    import json

    from retensa.operators import policy
    from retensa.plans import catalog  # noqa: F401
    from retensa.plans.registry import QUERIES
    doc = QUERIES["json_summary"](spark, SF_SMALL).first()
    (run,) = json.loads(doc["run_parameters"])
    assert run["decision_budget"] == policy.BUDGET and run["bootstrap_repetitions"] == policy.BOOTSTRAP
    assert 0 < run["candidate_pool_size"] <= run["pool_limit"]
    assert {r["baseline"] for r in json.loads(doc["pairwise_tests"])} == set(policy.ARMS[:3])
    assert len(json.loads(doc["arm_metrics"])) == 4


def test_summaries_are_small(spark):
    import pytest

    from retensa.sources.sinks import summary_json
    assert summary_json(spark.range(3), most=3).first()[0] == '[{"id":0},{"id":1},{"id":2}]'
    with pytest.raises(Exception, match="more than 3 rows"):
        summary_json(spark.range(4), most=3).collect()


def test_read_any_by_extension(spark, tmp_path):
    from retensa.sources.tables import read_any
    df = spark.range(4).withColumn("x", F.col("id") * 2)
    df.write.parquet(str(tmp_path / "a.parquet"))
    df.coalesce(1).write.option("header", "true").csv(str(tmp_path / "a.csv"))
    for name in ("a.parquet", "a.csv"):
        got = read_any(spark, str(tmp_path / name), **({"infer_schema": True} if name == "a.csv" else {}))
        assert sorted((r["id"], r["x"]) for r in got.collect()) == [(0, 0), (1, 2), (2, 4), (3, 6)]
