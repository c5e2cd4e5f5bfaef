"""Canonical specifications: what has no order does not count, what has one does."""

import random

from pyspark.sql import functions as F

from alertweave.operators import audit, specifications

SCHEMA = (
    "id string, spec struct<steps array<string>, languages array<string>, "
    "packs array<struct<version:string, names:array<string>>>, env map<string,string>>"
)


def test_permuted_specifications_share_a_digest(spark):
    rng = random.Random(3)
    base = {"steps": ["b", "a", "a"], "languages": ["java", "go"], "env": {"x": "1", "y": None}}
    packs = [("1", ["p", "q"]), ("2", None), (None, [])]
    rows = []
    for _ in range(8):
        shuffled = [(version, names and rng.sample(names, len(names))) for version, names in rng.sample(packs, 3)]
        env = dict(rng.sample(sorted(base["env"].items()), 2))
        rows.append(("same", (base["steps"], rng.sample(base["languages"], 2) + ["go"], shuffled, env)))
    rows.append(("steps", (["a", "b", "a"], base["languages"], packs, base["env"])))
    rows.append(("value", (base["steps"], base["languages"], packs, {"x": "1", "y": "2"})))
    rows.append(("null", (base["steps"], base["languages"], [("1", ["p", "q"]), ("2", []), (None, [])], base["env"])))
    rows.append(("none", None))
    got = specifications.with_digest(spark.createDataFrame(rows, SCHEMA), "spec", {"steps"})
    digests = {}
    for row in got.collect():
        digests.setdefault(row.id, set()).add(row.digest)
    assert all(len(found) == 1 for found in digests.values())
    assert len(set.union(*digests.values())) == 5 and digests["none"] == {None}
    projects = got.select(F.lit("p").alias("project_id"), F.col("digest").alias("source_fingerprint"), "id")
    assert audit.identity_conflicts(projects.where("id = 'same'")).isEmpty()
    assert not audit.identity_conflicts(projects.where("id in ('same', 'steps')")).isEmpty()
