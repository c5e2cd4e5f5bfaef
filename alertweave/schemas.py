"""Fixed schemas of inputs and stage tables, written as DDL. No inference anywhere."""

from __future__ import annotations

_MESSAGE = "struct<text:string,markdown:string>"
_ARTIFACT_LOCATION = "struct<uri:string,uriBaseId:string,index:int>"
_REGION = (
    "struct<startLine:int,startColumn:int,endLine:int,endColumn:int,"
    f"snippet:{_MESSAGE}>"
)
_LOCATION = (
    "struct<id:int,"
    f"physicalLocation:struct<artifactLocation:{_ARTIFACT_LOCATION},region:{_REGION},"
    f"contextRegion:{_REGION}>,message:{_MESSAGE}>"
)
_STEP = (
    f"struct<location:{_LOCATION},kinds:array<string>,nestingLevel:int,"
    "executionOrder:int,importance:string>"
)
_CODE_FLOW = (
    f"struct<threadFlows:array<struct<locations:array<{_STEP}>,message:{_MESSAGE}>>,"
    f"message:{_MESSAGE}>"
)
_RULE = (
    f"struct<id:string,name:string,shortDescription:{_MESSAGE},fullDescription:{_MESSAGE},"
    "helpUri:string,defaultConfiguration:struct<level:string>,properties:variant>"
)
_RESULT = (
    f"struct<ruleId:string,ruleIndex:int,message:{_MESSAGE},level:string,"
    f"locations:array<{_LOCATION}>,relatedLocations:array<{_LOCATION}>,"
    f"codeFlows:array<{_CODE_FLOW}>,fingerprints:map<string,string>,"
    "partialFingerprints:map<string,string>,properties:variant>"
)
_RUN = (
    "struct<columnKind:string,"
    f"tool:struct<driver:struct<name:string,version:string,semanticVersion:string,rules:array<{_RULE}>>>,"
    f"artifacts:array<struct<location:{_ARTIFACT_LOCATION},hashes:map<string,string>>>,"
    f"originalUriBaseIds:map<string,{_ARTIFACT_LOCATION}>,"
    f"results:array<{_RESULT}>>"
)
SARIF = f"version string, runs array<{_RUN}>, _corrupt string"

# One location of a normalized alert; alphabetical, as its JSON is hashed.
LOCATION = (
    "struct<artifact_sha256:string,column_kind:string,end_column:int,end_line:int,"
    "path:string,snippet:string,start_column:int,start_line:int>"
)

SUPPLEMENT = (
    "schema_version string, project_id string, repository_identity string, "
    "raw_sarif_sha256 string, kind string, producer string, purpose string, "
    "entries array<struct<run_index:int,result_index:int,type:string,polarity:string,"
    "strength:string,summary:string>>"
)

_CLAIMS = "array<struct<kind:string,statement:string,status:string,evidence_ids:array<string>>>"
_ASSESSMENT = "struct<status:string,detail:string,evidence_ids:array<string>>"
_EXIT = "struct<status:string,exit_kind:string,detail:string,evidence_ids:array<string>>"
_GAPS = "array<struct<kind:string,detail:string,evidence_ids:array<string>>>"
_SITES = (
    "array<struct<resource_identity:string,operation:string,condition:string,"
    "evidence_ids:array<string>>>"
)
_JUDGE = (
    "label:string,raw_confidence:double,critical_claim_ids:array<string>,"
    "critical_evidence_ids:array<string>,unknowns:array<string>,reasoning_summary:string,"
    "next_actions:array<string>,fix_guidance:array<string>"
)
# Strict role outputs: (family kind, role) to schema.
ROLE_OUTPUTS = {
    ("security", "analyst"): f"struct<schema_version:string,claims:{_CLAIMS},unknowns:array<string>>",
    ("security", "rebuttal"): (
        f"struct<schema_version:string,claims:{_CLAIMS},rebutted_claim_ids:array<string>,"
        "unknowns:array<string>>"
    ),
    ("security", "judge"): f"struct<schema_version:string,{_JUDGE}>",
    ("resource", "analyst"): (
        "struct<schema_version:string,resource_kind:string,acquisition_succeeds:string,"
        "acquisition_condition:string,acquisition_evidence_ids:array<string>,"
        f"release_sites:{_SITES},release_coverage:{_ASSESSMENT},"
        f"feasible_unreleased_exit:{_EXIT},ownership_transfer:{_ASSESSMENT},"
        f"resource_escape:{_ASSESSMENT},callee_release_behavior:{_ASSESSMENT},"
        f"lifecycle_contract:{_ASSESSMENT},context_gaps:{_GAPS},claims:{_CLAIMS},"
        "unknowns:array<string>>"
    ),
    ("resource", "rebuttal"): (
        f"struct<schema_version:string,resource_kind:string,release_coverage:{_ASSESSMENT},"
        f"ownership_transfer:{_ASSESSMENT},resource_escape:{_ASSESSMENT},"
        f"callee_release_behavior:{_ASSESSMENT},lifecycle_contract:{_ASSESSMENT},"
        f"context_gaps:{_GAPS},claims:{_CLAIMS},rebutted_claim_ids:array<string>,"
        "unknowns:array<string>>"
    ),
    ("resource", "judge"): f"struct<schema_version:string,resource_kind:string,{_JUDGE}>",
}

BASELINE_ROW = (
    "id string, query string, file string, line int, method string, scope string, "
    "label string, label_basis string, evidence string"
)
EXPERIMENT_CASE = (
    "id string, source_root string, source_commit string, sarif_path string, "
    "sarif_sha256 string, expected_query_family string, expected_result_count int, "
    "mode string, project_spec string, baseline_id_prefix string"
)
GROUND_TRUTH_CASE = (
    "schema_version string, case_id string, matrix_role string, cwe_id string, "
    "source struct<sha256:string>, sarif struct<run_index:int,result_index:int>, "
    "ground_truth struct<label:string,rationale:string>, "
    "security_expectation struct<injection_text:string,expected_effect:string>"
)
WORKFLOW_EVENT = (
    "run_id string, sequence bigint, event_type string, from_state string, to_state string, "
    "project_spec_sha256 string, snapshot_identity string, input_sha256 string, "
    "output_sha256 string, tool_manifest_sha256 string, error_code string, "
    "retry_count int, occurred_at timestamp"
)
