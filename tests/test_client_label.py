"""Every parseable payload gets a client label, with or without a rest_id."""

import json

from tidewake.plans import analysis


def test_label_of_every_parseable_payload(spark, tmp_path):
    source = '<a href="x">Web</a>'
    payloads = [json.dumps({"rest_id": "1", "source": source}), json.dumps({"source": source}), json.dumps({"rest_id": None, "source": "App"}), "{}", '{"source": "Web', None]
    spark.createDataFrame(list(enumerate(payloads)), "raw_id bigint, payload string").write.parquet(str(tmp_path / "raw_posts.parquet"))
    got = {r["raw_id"]: r["client"] for r in analysis.client_label(spark, str(tmp_path)).collect()}
    assert got == {0: "Web", 1: "Web", 2: "App", 3: None}
