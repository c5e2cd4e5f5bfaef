"""Sources, audits and the stream on tiny hand-written frames."""

import json
import tempfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from alertweave.operators import audit, callables, experiment, triage
from alertweave.operators.evaluation import class_metrics, confusion_matrix, evaluation_rows
from alertweave.sinks.tables import inventory, write_checksums
from alertweave.sources import inputs
from alertweave.sources.documents import scan_documents
from alertweave.sources.source_files import classify_sources, scan_sources, text_sources
from alertweave.streaming import event_log
from alertweave.streaming.event_log import append_batch, append_stream, read_event_stream


def test_source_classes(spark):
    cases = {
        "ok.java": (b"\xef\xbb\xbfint a;\n", "ok"),
        "big.java": (b"a" * 40, "source_too_large"),
        "bin.java": (b"a\x00b", "binary_source"),
        "latin.java": (b"caf\xe9", "unsupported_encoding"),
    }
    rows = [("r", name, bytearray(data), len(data)) for name, (data, _) in cases.items()]
    frame = spark.createDataFrame(rows, "repository_identity string, path string, content binary, size bigint")
    got = {row.path: row for row in classify_sources(frame, maximum_bytes=32).collect()}
    assert {name: row.status for name, row in got.items()} == {name: status for name, (_, status) in cases.items()}
    assert got["ok.java"].text == "int a;\n"


def test_scans_and_checksums(spark):
    folder = Path(tempfile.mkdtemp(prefix="alertweave-test-"))
    (folder / "src").mkdir()
    (folder / "src" / "A.java").write_text("class A {}\n")
    (folder / "one.sarif").write_text("{}")
    assert [row.length for row in scan_documents(spark, str(folder)).collect()] == [2]
    assert [row.path for row in scan_sources(spark, str(folder / "src"), "r").collect()] == ["A.java"]
    target = tempfile.mkdtemp(prefix="alertweave-test-") + "/sums"
    write_checksums(inventory(spark, str(folder / "src")), target)
    rows = inputs.read_checksums(spark, target).collect()
    assert [(row.name, row.valid) for row in rows] == [("A.java", True)]


def test_overloads_are_reported_not_chosen(spark):
    text = "class A {\n void f(int a) { }\n void f(long a) { }\n void g() { f(1); }\n}\n}\n"
    files = text_sources(spark.createDataFrame([("r", "A.java", text)], "repository_identity string, path string, text string"))
    index = callables.index_callables(files)
    assert sorted((r.start_line, r.end_line, r.symbol) for r in index.collect()) == [(2, 2, "f"), (3, 3, "f"), (4, 4, "g")]
    definitions = callables.index_definitions(files, callables.smallest_callable_by_line(index))
    assert {r.name: r.definitions for r in definitions.collect()} == {"f": 2, "g": 1}


def test_strict_responses(spark):
    good = "ev_" + "a" * 64

    def outcome(value):
        raw = value if isinstance(value, str) else json.dumps(value)
        frame = spark.createDataFrame([(raw, [good])], "raw string, evidence_ids array<string>")
        check = triage.check_response(F.col("raw"), "security", "analyst")
        return frame.select(check.alias("c")).first().c.issues

    claim = {"kind": "path_feasible", "statement": "s", "status": "supported", "evidence_ids": [good]}
    assert outcome({"claims": [claim], "unknowns": []}) == []
    assert outcome({"claims": [claim], "more": 1})
    assert outcome({"claims": [{**claim, "statement": 5}]})
    assert outcome({"claims": [{**claim, "evidence_ids": []}]}) == ["claims"]
    assert outcome({"claims": [claim, claim]}) == ["duplicate claims"]
    assert outcome({"claims": [{**claim, "evidence_ids": ["ev_" + "b" * 64]}]})
    assert outcome('{"claims":[],"claims":[]}')
    assert outcome("[]")


def test_evaluation_counts(spark):
    auto = spark.createDataFrame([(1, "TP"), (2, "FP"), (3, "NMC"), (4, "TP")], "k int, label string")
    human = spark.createDataFrame([(1, "TP"), (2, "TP"), (3, "NMC"), (5, "FP")], "k int, label string")
    matrix = confusion_matrix(evaluation_rows(auto, human, ["k"]))
    assert {r.baseline_label: (r.TP, r.FP, r.NMC) for r in matrix.collect()} == {
        "TP": (1, 1, 0), "FP": (0, 0, 0), "NMC": (0, 0, 1)}
    metrics = {r.label: r for r in class_metrics(matrix).collect()}
    assert (metrics["TP"].precision, metrics["TP"].recall, metrics["FP"].f1) == (1.0, 0.5, 0.0)


def test_failed_case_adds_no_labels(spark):
    checked = spark.createDataFrame(
        [("a", "h1", "triage", 2, None), ("b", "h2", "triage", 1, None), ("c", "h3", "triage", 0, None), ("d", "h4", "audit_only", 9, None)],
        "case_id string, raw_sarif_sha256 string, mode string, result_count bigint, reason string",
    )
    decided = spark.createDataFrame([("h1", "TP"), ("h1", "NMC"), ("h2", "FP")], "raw_sarif_sha256 string, label string")
    rejects = spark.createDataFrame([("h2", "MODEL_FAILED")], "raw_sarif_sha256 string, error_code string")
    rows = {r.case_id: r for r in experiment.case_results(checked, decided, rejects).collect()}
    assert {name: row.status for name, row in rows.items()} == {
        "a": "completed", "b": "failed", "c": "completed", "d": "audit_only"}
    assert rows["b"].fp_count == 0 and rows["b"].error_code == "MODEL_FAILED"


def event(run, sequence, before, after):
    return {
        "run_id": run, "sequence": sequence, "event_type": "step", "from_state": before, "to_state": after,
        "project_spec_sha256": "a", "snapshot_identity": "b", "retry_count": 0, "occurred_at": "2024-01-01T00:00:00Z",
    }


def test_event_stream_and_chain(spark):
    folder = tempfile.mkdtemp(prefix="alertweave-test-")
    Path(folder, "in").mkdir()

    def run(name, events):
        Path(folder, "in", name).write_text("\n".join(json.dumps(e) for e in events))
        append_stream(read_event_stream(spark, f"{folder}/in"), folder, f"{folder}/cp").awaitTermination()

    def rejected():
        rows = spark.read.parquet(f"{folder}/rejected").collect()
        return sorted((r.run_id, r.sequence, r.fault) for r in rows)

    run("a.json", [
        event("r1", 0, None, "CREATED"), event("r1", 1, "CREATED", "PROJECT_VALIDATED"),
        event("r1", 3, "WORKSPACE_READY", "SOURCE_READY"), event("r2", 0, None, "JUDGED"), event("r3", 0, None, "CREATED"),
    ])
    first = [("r1", 3, "sequence is not contiguous"), ("r2", 0, "history must begin at CREATED")]
    assert rejected() == first
    run("b.json", [
        event("r1", 2, "PROJECT_VALIDATED", "WORKSPACE_READY"), event("r1", 1, "CREATED", "PROJECT_VALIDATED"),
        event("r3", 1, "PROJECT_VALIDATED", "WORKSPACE_READY"), event("r3", 2, "WORKSPACE_READY", "SOURCE_READY"),
        event("r4", 0, None, "CREATED"), event("r4", 0, None, "CREATED"),
    ])
    assert rejected() == sorted(first + [
        ("r1", 1, "sequence is already recorded"), ("r3", 1, "state chain is discontinuous"),
        ("r3", 2, "an event before it was rejected"), ("r4", 0, "sequence is repeated"), ("r4", 0, "sequence is repeated"),
    ])
    log = spark.read.parquet(f"{folder}/log")
    assert sorted((r.run_id, r.sequence) for r in log.collect()) == [("r1", 0), ("r1", 1), ("r1", 2), ("r3", 0)]
    assert audit.chain_faults(log).isEmpty()


def test_batches_run_again_and_states_in_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log, "FULL_EVERY", 2)
    from alertweave import fixed_values, schemas

    chain = ["CREATED"]
    while follow := [b for a, b in fixed_values.TRANSITIONS if a == chain[-1]]:
        chain.append(follow[0])
    columns = [field.split()[0] for field in schemas.WORKFLOW_EVENT.split(", ")]

    def frame(rows):
        rows = [[row.get(c) if c != "occurred_at" else datetime(2024, 1, 1) for c in columns] for row in rows]
        return spark.createDataFrame(rows, schemas.WORKFLOW_EVENT)

    folder = str(tmp_path)
    for number in range(5):
        new = [event("r", number, chain[number - 1] if number else None, chain[number])]
        new += [event(f"s{number}", 0, None, "CREATED")]
        for _ in range(2):
            append_batch(frame(new), folder, number)
    append_batch(frame([event("s0", 1, "CREATED", "PROJECT_VALIDATED")]), folder, 5)
    log = spark.read.parquet(f"{folder}/log")
    assert log.count() == 11 and audit.chain_faults(log).isEmpty()
    assert spark.read.parquet(f"{folder}/rejected").isEmpty()


def test_sliced_ordinal_equals_plain_order(spark):
    rows = [("u", f"2024-01-0{1 + i % 3} 0{i % 7}:00:00", i) for i in range(40)] + [("v", "2024-01-01 00:00:00", 99)]
    frame = spark.createDataFrame(rows, "k string, t string, e int").withColumn("t", F.to_timestamp("t"))
    got = {r.e: r.sequence for r in audit.sliced_ordinal(frame, "k", "t", "e", "day").collect()}
    ordered = sorted((t, e) for k, t, e in rows if k == "u")
    assert {e: n for n, (_, e) in enumerate(ordered)} | {99: 0} == got


def test_readers_keep_every_line(spark, tmp_path):
    import json

    from alertweave.sources import inputs

    good = {"id": "a", "source_root": None, "expected_result_count": 3, "mode": "triage"}
    lines = [json.dumps(good), json.dumps(good | {"unknown": 1}), "{broken", json.dumps(good | {"expected_result_count": "3"})]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    cases = inputs.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()
    assert sorted(row.valid for row in cases) == [False, False, False, True]
    (tmp_path / "truth").mkdir()
    truth = {"schema_version": "1.0", "case_id": "c", "sarif": {"run_index": 0, "result_index": 1}}
    (tmp_path / "truth" / "a.json").write_text(json.dumps(truth, indent=1))
    (tmp_path / "truth" / "b.json").write_text("[]")
    assert sorted(row.valid for row in inputs.read_ground_truth(spark, str(tmp_path / "truth")).collect()) == [False, True]
    decision = {
        "alert": {"raw_result_reference": {"raw_sarif_sha256": "a" * 64, "run_index": 0, "result_index": 1}},
        "triage": {"final_decision": {"label": "TP"}},
    }
    (tmp_path / "decisions.jsonl").write_text(json.dumps(decision) + "\nnot json\n" + json.dumps({"alert": {}}))
    decisions = inputs.read_decisions(spark, str(tmp_path / "decisions.jsonl")).collect()
    assert sorted((row.valid, row.label or "") for row in decisions) == [(False, ""), (False, ""), (True, "TP")]
    (tmp_path / "responses").mkdir()
    for name in ("1" * 64, "2" * 64):
        (tmp_path / "responses" / f"{name}.json").write_text('{"x": 1}' * (1 if name[0] == "1" else 40))
    bounded = inputs.read_responses(spark, str(tmp_path / "responses"), maximum_bytes=100).collect()
    assert sorted(row.raw_json for row in bounded) == ["", '{"x": 1}']
    supplements = inputs.read_supplements(spark, str(tmp_path / "responses"), maximum_bytes=100).collect()
    assert len(supplements) == 2 and sum("supplement exceeds the size bound" in row.issues for row in supplements) == 1


def test_large_files_are_hashed(spark, tmp_path):
    import hashlib

    from alertweave.sources import source_files

    text = "x" * 3_000_000
    (tmp_path / "big.txt").write_text(text)
    for bound, status in ((None, "ok"), (1000, "source_too_large")):
        (row,) = source_files.scan_sources(spark, str(tmp_path), "repo", maximum_bytes=bound).collect()
        assert (row.status, row.artifact_sha256) == (status, hashlib.sha256(text.encode()).hexdigest())
        assert (row.text == text) == (bound is None)


def test_repeated_documents_have_reject_rows(spark):
    from alertweave.sources.documents import repeated_documents, unique_documents

    rows = [("a", "r1", "c1"), ("a", "r1", "c1"), ("a", "r2", None), ("b", None, None), ("c", "r1", "c1"), ("c", "r0", "c1")]
    documents = spark.createDataFrame(rows, "raw_sarif_sha256 string, repository_identity string, commit_sha string")
    kept, left_out = unique_documents(documents), repeated_documents(documents)
    assert sorted(row.raw_sarif_sha256 for row in kept.collect()) == ["a", "b", "c"]
    assert kept.count() + left_out.count() == len(rows)
    assert sorted(row.raw_sarif_sha256 for row in left_out.collect()) == ["a", "a", "c"]
