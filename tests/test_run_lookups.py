import json

import pytest
from pyspark.sql import functions as F

from alertweave.operators import normalize
from alertweave.sources.documents import gate_documents


@pytest.mark.parametrize("ids", [[], ["a"], ["b", "a"], ["r10", "r9", "é", "", "r1"], [f"r{k}" for k in range(37, 0, -1)]])
def test_positions_are_those_of_a_plain_search(spark, ids):
    wanted = [*ids, "r", "zz", None]
    frame = spark.createDataFrame([(ids, one) for one in wanted], "ids array<string>, wanted string")
    order = normalize.order_by_id(F.transform("ids", lambda name: F.named_struct(F.lit("id"), name)))
    got = frame.select("wanted", normalize.position_of(F.col("wanted"), order).alias("at")).collect()
    assert [(row["wanted"], row["at"]) for row in got] == [(one, ids.index(one) if one in ids else None) for one in wanted]


def place(**artifact):
    return {"artifactLocation": artifact, "region": {"startLine": 3}}


def normalized(spark, result, **run):
    body = {"version": "2.1.0", "runs": [{"columnKind": "unicodeCodePoints", "tool": {"driver": {"name": "s", **run.pop("driver", {})}}, **run}]}
    body["runs"][0]["results"] = [{"ruleId": "x", "message": {"text": "m"}, **result}]
    frame = spark.createDataFrame([("r", "0" * 40, bytearray(json.dumps(body).encode()))], "repository_identity string, commit_sha string, content binary")
    row = normalize.normalize(gate_documents(frame.withColumn("raw_sarif_sha256", F.sha2("content", 256)))).first()
    return (row["fault"]["detail"] if row["fault"] else None), (row["primary_location"] or {"path": None})["path"]


def test_locations_that_point_at_their_run(spark):
    artifacts = [{"location": {"uri": "a.txt"}}, {"location": {"index": 0}}]
    at = lambda **artifact: {"locations": [{"physicalLocation": place(**artifact)}]}
    assert normalized(spark, at(index=0), artifacts=artifacts) == (None, "a.txt")
    assert normalized(spark, at(uri="own.txt", index=0), artifacts=artifacts) == (None, "own.txt")
    for index in (2, -1):
        assert normalized(spark, at(index=index), artifacts=artifacts)[0] == "artifact index is out of range"
    assert normalized(spark, at(index=0))[0] == "artifact index is out of range"
    assert normalized(spark, at(index=1), artifacts=artifacts)[0] == "artifactLocation requires uri or a valid index"
    assert normalized(spark, at(uri="a.txt", uriBaseId="B"))[0] == "unknown URI base"
    assert normalized(spark, {"locations": [{"id": 1}]})[0] == "location has no physicalLocation"
    borrowed = {"locations": [{"id": 1}], "relatedLocations": [{"id": 2, "physicalLocation": place(uri="no.txt")}, {"id": 1, "physicalLocation": place(index=0)}]}
    assert normalized(spark, borrowed, artifacts=artifacts) == (None, "a.txt")
    twice = {**borrowed, "relatedLocations": borrowed["relatedLocations"][1:] * 2}
    assert normalized(spark, twice, artifacts=artifacts)[0] == "duplicate related location id"
