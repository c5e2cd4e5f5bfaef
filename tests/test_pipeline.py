"""Small documents and code through every stage, up to decisions and reports."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from alertweave.operators import evidence, normalize, report, triage
from alertweave.operators.context import check_context, resolve_policy
from alertweave.plans import pipeline
from alertweave.sources.documents import document_rejects, gate_documents
from alertweave.sources.source_files import text_sources

CODE = """class A {
  void foo(int x) throws E {
    if (x > 1) { bar(x); }
    Lock l = new Lock(); // baz(
    validate(l); helper
      (3);
    l.lock();
    return;
  }
  void bar(int z) { while (z>0) { z--; } }
  void helper(int q) {
     throw q;
  }
  void over(int a) { }
  void over(long a) { }
}
"""


def place(uri, line, **region):
    return {"physicalLocation": {"artifactLocation": {"uri": uri, "uriBaseId": "SRC"}, "region": {"startLine": line, **region}}}


def document(**changes):
    result = {
        "ruleId": "java/x",
        "message": {"text": "m"},
        "locations": [place("A.java", 3, endColumn=9)],
        "relatedLocations": [{"id": 1, "physicalLocation": {"artifactLocation": {"index": 0}, "region": {"startLine": 5}}}],
        "codeFlows": [{"threadFlows": [{"locations": [{"location": place("B.java", 1)}, {"location": {"id": 1}, "kinds": ["Sink"]}]}]}],
    }
    result.update(changes)
    run = {
        "columnKind": "utf16CodeUnits",
        "tool": {"driver": {"name": "T", "rules": [{"id": "java/x", "properties": {
            "tags": ["external/cwe/cwe-079", "b", 3], "security-severity": "7.5"}}]}},
        "artifacts": [{"location": {"uri": "C.java"}}],
        "originalUriBaseIds": {"SRC": {"uri": "s/", "uriBaseId": "ROOT"}, "ROOT": {"uri": "file:///srv/p/"}},
        "results": [result],
    }
    return {"version": "2.1.0", "runs": [run]}


def raw(spark, texts):
    rows = [(bytearray(text.encode()), "r", None) for text in texts]
    frame = spark.createDataFrame(rows, "content binary, repository_identity string, commit_sha string")
    return frame.withColumn("raw_sarif_sha256", F.sha2("content", 256))


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("r", "s/A.java", CODE), ("r", "s/B.java", "x\n" * 40)]
    return text_sources(spark.createDataFrame(rows, "repository_identity string, path string, text string"))


def test_rejects_keep_their_document(spark, sources):
    good = document()
    twin = document()
    twin["runs"][0]["results"].append(document(locations=[])["runs"][0]["results"][0])
    texts = {
        "ok": json.dumps(good),
        "twin": json.dumps(twin),
        "double key": '{"version":"2.1.0","version":"2.1.0","runs":[]}',
        "trailing": json.dumps(good) + " x",
        "index": json.dumps(document(ruleIndex=4)),
        "conflict": json.dumps(document(ruleId="other", ruleIndex=0)),
        "region": json.dumps(document(locations=[place("A.java", 0)])),
        "escape": json.dumps(document(locations=[place("..%2Fx", 1)])),
        "typed": json.dumps(document(locations=[place("A.java", "3")])),
        "base": json.dumps(document(locations=[{"physicalLocation": {"artifactLocation": {"uri": "a", "uriBaseId": "NO"}, "region": {"startLine": 1}}}])),
    }
    gated = gate_documents(raw(spark, texts.values()))
    normalized = normalize.normalize(gated, sources).cache()
    rejected = document_rejects(gated).unionByName(normalize.normalization_rejects(normalized))
    names = {r.raw_sarif_sha256: r for r in rejected.collect()}
    digest = {
        name: row.h
        for name, row in zip(texts, raw(spark, texts.values()).select(F.col("raw_sarif_sha256").alias("h")).collect())
    }
    assert set(names) == {digest[name] for name in texts if name != "ok"}
    assert names[digest["escape"]].error_code == "UNSAFE_SARIF_URI"
    assert names[digest["twin"]].result_index == 1
    kept = normalize.alerts(normalized).collect()
    assert [row.raw_sarif_sha256 for row in kept] == [digest["ok"]]
    alert = kept[0]
    assert alert.rule.cwe_ids == ["CWE-79"] and alert.rule.security_severity == 7.5
    assert alert.primary_location.path == "s/A.java" and alert.primary_location.end_line == 3
    steps = alert.paths[0].steps
    assert [step.step_kind for step in steps] == ["source", "sink"]
    assert [step.location.path for step in steps] == ["s/B.java", "C.java"]
    assert alert.paths[0].completeness == "complete"


def test_unknown_policies_fail():
    with pytest.raises(NotImplementedError):
        resolve_policy("adaptive_slice")
    with pytest.raises(ValueError):
        resolve_policy("other")


def output(role, resource, evidence_id, label):
    absent = {"status": "absent", "detail": "d", "evidence_ids": [evidence_id]}
    lifecycle = {name: absent for name in (
        "release_coverage", "ownership_transfer", "resource_escape", "callee_release_behavior", "lifecycle_contract")}
    if role == "judge":
        value = {"label": label, "raw_confidence": 0.850, "reasoning_summary": "r", "critical_evidence_ids": [evidence_id]}
    else:
        kind = "resource_acquisition" if resource else "path_feasible"
        value = {"claims": [{"kind": kind, "statement": "s", "status": "supported", "evidence_ids": [evidence_id]}]}
        if resource:
            value.update(lifecycle)
    if resource:
        value["resource_kind"] = "lock"
        if role == "analyst":
            value.update(
                acquisition_succeeds="yes", acquisition_condition="c", acquisition_evidence_ids=[evidence_id],
                feasible_unreleased_exit={"status": "absent", "exit_kind": None, "detail": "d", "evidence_ids": [evidence_id]},
            )
    return json.dumps(value)


def test_documents_to_reports(spark, sources):
    folder = tempfile.mkdtemp(prefix="alertweave-test-")
    texts = [json.dumps(document(ruleId="java/unreleased-lock")), json.dumps(document())]
    documents = raw(spark, texts)
    tables = pipeline.build_context_tables(spark, documents, sources, folder)
    contexts = {row.family: row for row in tables["context"].collect()}
    lock = contexts["resource_lock"]
    assert [(p.start_line, p.end_line, p.enclosing_symbol) for p in lock.source_slices] == [
        (2, 9, "foo"), (1, 6, None), (10, 10, "bar"), (11, 13, "helper")]
    assert [o.code for o in lock.omitted] == ["source_file_missing", "function_boundary_unresolved"]
    assert [g.location.start_line for g in lock.guards] == [3, 10]
    assert [g.location.start_line for g in lock.candidate_sanitizers] == [5]
    assert len(contexts["legacy_security"].source_slices) == 2
    assert check_context(tables["context"]).isEmpty()
    assert evidence.closure_faults(tables["evidence"], tables["edges"], tables["artifacts"]).isEmpty()
    found = {}
    for row in tables["evidence"].select("raw_sarif_sha256", "evidence_id", "type").collect():
        found.setdefault(row.raw_sarif_sha256, []).append(row)
    families = {row.raw_sarif_sha256: row.family for row in tables["context"].collect()}
    types = [row.type for key, rows in found.items() if families[key] == "resource_lock" for row in rows]
    assert {"resource_acquisition", "control_flow_exit", "exception_flow", "context_gap", "guard"} <= set(types)

    settings = triage.Settings(triage.Profile("replay.v1", "recorded"))
    schema = "request_sha256 string, raw_json string, response_sha256 string"
    recorded = []
    for expected in ("analyst", "rebuttal", "judge"):
        responses = spark.createDataFrame(recorded or [("", "", "")], schema)
        rows = triage.triage(tables["alerts"], tables["evidence"], responses, settings).collect()
        for row in rows:
            missing = row.missing_request
            assert (row.failure, missing.agent_role) == ("MODEL_REPLAY_MISS", expected)
            resource = row.family != "legacy_security"
            text = output(missing.agent_role, resource, found[row.raw_sarif_sha256][0].evidence_id, "TP")
            recorded.append((missing.request_sha256, text, "0" * 64))
    tables = pipeline.decide(spark, tables, spark.createDataFrame(recorded, schema), settings, folder)
    labels = {row.family: (row.label, row.policy_flags[-1]) for row in tables["decisions"].collect()}
    assert labels == {
        "resource_lock": ("NMC", "resource_context_incomplete"),
        "legacy_security": ("NMC", "tp_support_missing"),
    }
    assert triage.role_order_faults(tables["invocations"]).isEmpty()
    assert tables["rejects"].isEmpty()
    runs = documents.select(
        "raw_sarif_sha256", F.lit("run1").alias("run_id"), F.lit("p").alias("project_id"), F.lit("sarif").alias("input_mode"),
        F.lit(False).alias("real_codeql"), F.lit("0" * 64).alias("project_spec_sha256"),
        F.lit("1" * 64).alias("snapshot_identity"), F.create_map(F.lit("tool"), F.lit("1")).alias("tool_versions"),
    )
    reports = pipeline.publish(tables, runs, folder)
    assert report.report_faults(reports).isEmpty()
    assert report.orphan_faults(tables["alerts"], tables["context"], tables["triaged"]).isEmpty()
    lines = [json.loads(row.value) for row in spark.read.text(f"{folder}/report/decisions.jsonl").collect()]
    assert sorted(line["triage"]["final_decision"]["label"] for line in lines) == ["NMC", "NMC"]
    assert all(line["verification"]["status"] == "not_performed" for line in lines)


def test_callees_without_and_with_a_bound(spark, tmp_path):
    names = [f"step{k:02d}" for k in range(11)]
    calls = "\n".join(f"    {name}(1);" for name in names)
    helpers = "\n".join(f"  void {name}(int a) {{\n    use(a);\n  }}" for name in names)
    code = f"class A {{\n  void foo(int x) {{\n{calls}\n    l.lock();\n  }}\n{helpers}\n}}\n"
    rows = [("r", "s/A.java", code), ("r", "s/B.java", "x\n" * 40), ("r", "s/Never.java", code)]
    files = text_sources(spark.createDataFrame(rows, "repository_identity string, path string, text string"))
    texts = [json.dumps(document(ruleId="java/unreleased-lock", relatedLocations=[], codeFlows=[]))]

    def built(bound):
        options = pipeline.Options(callee_bound=bound)
        (row,) = pipeline.build_context_tables(spark, raw(spark, texts), files, str(tmp_path / str(bound)), options)["context"].collect()
        kept = [piece.enclosing_symbol for piece in row.source_slices]
        return [name for name in kept if name in names], [o.detail for o in row.omitted if o.code == "resource_context_bound"]

    assert built(None) == (names, [])
    kept, left_out = built(8)
    assert kept == names[:8] and len(left_out) == 3
    start = code.splitlines().index("  void step08(int a) {") + 1
    assert left_out[0] == f"step08, defined in lines {start} to {start + 2}, is over the bound of 8 called definitions"
