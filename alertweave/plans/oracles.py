"""Plain SQL for the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

from alertweave import fixed_values as fixed

# Lines of a document; a final line end does not open another line.
_LINES = """
lines AS (
  SELECT doc_id, source, lang, 'docs/' || doc_id || '.txt' AS path, text,
         unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no, len(parts) AS n_lines
  FROM (SELECT *, string_split(CASE WHEN right(text, 1) = chr(10)
                               THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts
        FROM documents)
)"""
_ENDED = "line || CASE WHEN line_no < n_lines OR right(text, 1) = chr(10) THEN chr(10) ELSE '' END"
_RULE = """
CASE WHEN regexp_matches(line, 'token|secret|password') THEN 'java/database-resource-leak'
     WHEN contains(line, ',') THEN 'java/unreleased-lock'
     WHEN contains(line, ' the ') OR contains(line, ' la ') THEN 'java/input-resource-leak'
     ELSE 'js/reflected-xss' END"""


def _family(rule: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{family}'" for name, family in fixed.QUERY_FAMILIES.items())
    return f"CASE {rule} {cases} ELSE 'legacy_security' END"


def _location(end_column: str, line_no: str, artifact: str) -> str:
    return f"""'{{"artifact_sha256":' || {artifact} || ',"column_kind":"unicodeCodePoints","end_column":' || ({end_column})
      || ',"end_line":' || ({line_no}) || ',"path":"' || path || '","snippet":null,"start_column":1,"start_line":' || ({line_no}) || '}}'"""


def _paths(artifact: str) -> str:
    """Per line: its location JSON, its step list JSON and the fingerprint of the path."""
    here = _location("length(line) + 1", "line_no", artifact)
    there = _location("length(previous) + 1", "line_no - 1", artifact)

    def step(location: str, kind: str) -> str:
        return f"""'{{"kinds":[],"location":' || {location} || ',"message":null,"step_kind":"{kind}"}}'"""

    return f"""
stepped AS (
  SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous FROM lines
),
pathed AS (
  SELECT *, {here} AS here,
    sha256('{fixed.PATH_DOMAIN}' || chr(0) || '[' ||
      CASE WHEN line_no = 1 THEN {step(here, "source")}
           ELSE {step(there, "source")} || ',' || {step(here, "sink")} END || ']') AS path_fingerprint
  FROM stepped
)"""


# Brace code of a document, line by line, and its callables.
_CODE = f"""
words AS (
  SELECT *, CASE WHEN regexp_extract(line, '[A-Za-z]+') = '' THEN 'w'
                 ELSE lower(regexp_extract(line, '[A-Za-z]+')) END AS word
  FROM lines
),
code AS (
  SELECT *,
    CASE WHEN regexp_matches(line, ',.*,') THEN 'void ' || word || '(int a) {{'
         WHEN contains(line, ',') THEN 'if (' || word || ' > 0) {{ validate(' || word || '); return; }}'
         WHEN contains(line, ' the ') OR contains(line, ' la ') THEN 'x.lock(); y = new Foo(); // if (no) {{ close('
         WHEN line LIKE '%.' THEN '}} finally {{ z.close(); }}'
         ELSE 'call' || line_no || '(' || word || ');' END AS code_line
  FROM words
),
kinds AS (
  SELECT *, CASE WHEN code_line LIKE 'void %' THEN 1 WHEN code_line LIKE '}} finally%' THEN -1 ELSE 0 END AS turn FROM code
),
nets AS (
  SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line_no) AS net FROM kinds
),
spans AS (
  SELECT a.path, a.doc_id, a.word AS symbol, a.line_no AS start_line, min(b.line_no) AS end_line
  FROM nets a JOIN nets b ON a.doc_id = b.doc_id AND b.line_no > a.line_no AND b.net < a.net
  WHERE a.turn = 1
  GROUP BY ALL
),
callables AS (
  SELECT * FROM spans
  WHERE symbol NOT IN ({", ".join(f"'{word}'" for word in fixed.CONTROL_KEYWORDS)})
    AND symbol NOT IN ('class', 'enum', 'interface', 'record')
),
innermost AS (
  SELECT n.path, n.line_no, arg_min(c, (c.end_line - c.start_line, c.start_line, c.symbol)) AS c
  FROM nets n JOIN callables c ON n.doc_id = c.doc_id AND n.line_no BETWEEN c.start_line AND c.end_line
  GROUP BY ALL
)"""

_AUTOMATIC = """
automatic AS (
  SELECT doc_id, source, CASE WHEN n_chars > 2000 THEN 'TP' WHEN lang = 'en' THEN 'FP' ELSE 'NMC' END AS label FROM documents
),
human AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'TP' WHEN quality = 1 THEN 'FP' ELSE 'NMC' END AS label FROM labels
),
aligned AS (
  SELECT coalesce(a.doc_id, h.doc_id) AS doc_id, a.label AS automatic_label, h.label AS baseline_label,
         a.label = h.label AS agreement
  FROM automatic a FULL OUTER JOIN human h ON a.doc_id = h.doc_id
)"""

_REQUESTED = "CASE WHEN last_type IN ('click', 'view') THEN 'TP' WHEN last_type = 'signup' THEN 'NMC' ELSE 'FP' END"


def _facts(names: dict[str, str]) -> str:
    columns = ", ".join(f"coalesce(bool_or({value}), false) AS {name}" for name, value in names.items())
    return f"""facts AS (
  SELECT *, {_REQUESTED} AS requested_label FROM (
    SELECT user_id, arg_max(event_type, event_id) AS last_type, {columns} FROM events GROUP BY user_id)
)"""


def _security_policy() -> str:
    facts = _facts({
        "considered": "value > 1",
        "unknowns": "event_type = 'error' AND value > 100",
        "unresolved": "event_type = 'view' AND value > 120",
        "high_tp": "event_type = 'click' AND value > 90",
        "high_fp": "event_type = 'purchase' AND value > 90",
        "rebuttal": "event_type = 'purchase' AND value > 60",
        "supported": "event_type = 'click' AND value > 60",
    })
    return f"""WITH {facts}, flagged AS (
  SELECT *, CASE
    WHEN requested_label = 'NMC' THEN 'judge_requested_nmc'
    WHEN NOT considered THEN 'critical_evidence_missing'
    WHEN unknowns OR unresolved THEN 'unknown_or_unresolved'
    WHEN high_tp AND high_fp THEN 'conflicting_high_strength_evidence'
    WHEN requested_label = 'TP' AND high_fp THEN 'high_strength_fp_blocks_tp'
    WHEN requested_label = 'FP' THEN CASE WHEN rebuttal THEN 'fp_decisive_rebuttal_present,judge_label_accepted' ELSE 'fp_missing_decisive_rebuttal' END
    WHEN supported THEN 'judge_label_accepted' ELSE 'tp_support_missing' END AS flag
  FROM facts)
SELECT user_id, requested_label,
  CASE WHEN flag LIKE '%judge_label_accepted' THEN requested_label ELSE 'NMC' END AS label,
  'auto_dismiss_disabled,' || flag AS flags FROM flagged"""


def _resource_policy() -> str:
    facts = _facts({
        "incomplete": "event_type = 'error' AND value > 130",
        "conflicting": "event_type = 'view' AND value > 130",
        "unknowns": "event_type = 'signup' AND value > 130",
        "unresolved": "event_type = 'signup' AND value > 120",
        "unknown_assessment": "event_type = 'error' AND value > 120",
        "acquired": "event_type = 'click' AND value > 30",
        "exit_confirmed": "event_type = 'click' AND value > 50",
        "owned": "event_type = 'purchase' AND value > 110",
        "tp_claims": "event_type = 'view' AND value > 60",
        "fp_basis": "event_type = 'purchase' AND value > 40",
        "fp_claim": "event_type = 'error' AND value > 40",
        "released": "event_type = 'purchase' AND value > 80",
    })
    return f"""WITH {facts}, flagged AS (
  SELECT *, CASE
    WHEN requested_label = 'NMC' THEN 'judge_requested_nmc'
    WHEN incomplete THEN 'resource_context_incomplete'
    WHEN conflicting THEN 'resource_evidence_conflict'
    WHEN unknowns OR unresolved OR unknown_assessment THEN 'unknown_or_unresolved'
    WHEN requested_label = 'TP' THEN CASE
      WHEN NOT acquired THEN 'resource_acquisition_missing'
      WHEN NOT exit_confirmed THEN 'resource_unreleased_exit_missing'
      WHEN owned THEN 'resource_evidence_conflict'
      WHEN NOT tp_claims THEN 'tp_support_missing'
      ELSE 'resource_tp_basis_confirmed,judge_label_accepted' END
    WHEN fp_basis AND fp_claim THEN CASE WHEN released THEN 'resource_release_coverage_confirmed' ELSE 'resource_ownership_confirmed' END || ',judge_label_accepted'
    ELSE 'resource_fp_basis_missing' END AS flag
  FROM facts)
SELECT user_id, requested_label,
  CASE WHEN flag LIKE '%judge_label_accepted' THEN requested_label ELSE 'NMC' END AS label,
  'auto_dismiss_disabled,' || flag AS flags FROM flagged"""


def _lexical() -> str:
    bare = "regexp_replace(code_line, '//.*$', '')"
    guard = fixed.GUARD_PATTERN
    sanitizer = fixed.SANITIZER_PATTERN
    return f"""WITH {_LINES}, {_CODE}
SELECT path, line_no, kind, trim(code_line) AS excerpt, length(code_line) + 1 AS end_column
FROM (
  SELECT *, 'guard' AS kind FROM code WHERE regexp_matches({bare}, '{guard}')
  UNION ALL
  SELECT *, 'sanitizer' AS kind FROM code WHERE regexp_matches({bare}, '{sanitizer}'))"""


def _lifecycle() -> str:
    parts = [
        f"SELECT path, '{kind}' AS type, line_no, trim(code_line) AS excerpt FROM code WHERE regexp_matches(code_line, '{pattern}')"
        for kind, pattern, _ in fixed.LIFECYCLE_FAMILIES
    ]
    return f"WITH {_LINES}, {_CODE} " + " UNION ALL ".join(parts)


def _redacted(text: str) -> str:
    inline = fixed.INLINE_SECRET_PATTERN
    return (
        f"regexp_replace(regexp_replace(regexp_replace({text}, '{fixed.BEARER_PATTERN}', 'Bearer [REDACTED]', 'g'), "
        f"'{inline}', '\\1[REDACTED]', 'g'), '{fixed.USERINFO_PATTERN}', '\\1[REDACTED]@', 'g')"
    )


_ESCAPED = (
    "replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
)

_STATES = "['CREATED','PROJECT_VALIDATED','WORKSPACE_READY','SOURCE_READY','SARIF_INGESTED','NORMALIZED','CONTEXT_READY']"
_TRANSITIONS = ", ".join(f"'{a}>{b}'" for a, b in fixed.TRANSITIONS)
_FAILURES = ", ".join(f"'{state}'" for state in fixed.FAILURE_STATES)
_EVENTS = f"""
states AS (
  SELECT user_id AS run_id, event_id AS sequence, ts,
    CASE event_type WHEN 'click' THEN 'CONTEXT_READY' WHEN 'view' THEN 'JUDGED' WHEN 'error' THEN 'MODEL_FAILED'
                    WHEN 'signup' THEN 'SARIF_INGESTED' ELSE 'SCANNED' END AS to_state
  FROM events
),
runs AS (
  SELECT run_id, arg_max(to_state, sequence) AS state, count(*) AS event_count, max(ts) AS last_at,
    bool_or(to_state = 'SCANNED') AS entered_scan, bool_or(to_state = 'SARIF_INGESTED') AS entered_ingest
  FROM states GROUP BY run_id
),
closed AS (
  SELECT *, CASE WHEN state IN ({_FAILURES}) THEN 'failed' WHEN state IN ('CONTEXT_READY', 'JUDGED') THEN 'completed' ELSE 'running' END AS status FROM runs
)"""
_CASES = f"""
found AS (SELECT sha256(source) AS raw_sarif_sha256, source, {_RULE} AS rule_id FROM lines),
per AS (SELECT source, count(*) AS result_count, bool_or({_family("rule_id")} <> 'resource_lock') AS unexpected FROM found GROUP BY source),
checked AS (
  SELECT source AS case_id, CASE WHEN source IN ('src0', 'src1') THEN 'triage' ELSE 'audit_only' END AS mode,
    CASE WHEN source = 'src7' THEN 0 ELSE result_count END AS result_count,
    CASE WHEN source = 'src7' THEN 'document hash does not match the manifest'
         WHEN source = 'src3' THEN 'result count does not match the manifest'
         WHEN source IN ('src0', 'src1') AND unexpected THEN 'unexpected query family' END AS reason
  FROM per
)"""
_SOURCES = f"""
WITH {_AUTOMATIC},
cases AS (
  SELECT source AS case_id, CASE WHEN source = 'src2' THEN 'audit_only' WHEN source = 'src5' THEN 'failed' ELSE 'completed' END AS status,
    count(*) AS alert_count,
    count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'NMC') AS nmc
  FROM automatic GROUP BY source
)"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0), 0.0)"


def _metrics() -> str:
    p, r = _ratio("hit", "predicted"), _ratio("hit", "support")
    return f"""WITH {_AUTOMATIC}, counted AS (
  SELECT l.label,
    count(*) FILTER (agreement IS NOT NULL AND baseline_label = l.label AND automatic_label = l.label) AS hit,
    count(*) FILTER (agreement IS NOT NULL AND automatic_label = l.label) AS predicted,
    count(*) FILTER (agreement IS NOT NULL AND baseline_label = l.label) AS support
  FROM aligned, (VALUES ('TP'), ('FP'), ('NMC')) l(label) GROUP BY l.label)
SELECT label, round({p}, 9) AS precision, round({r}, 9) AS recall,
  round({_ratio(f"2 * {p} * {r}", f"{p} + {r}")}, 9) AS f1, support FROM counted"""


_LIMITS = ",".join(f'"{text}"' for text in fixed.REPORT_LIMITATIONS)
_TREE = """
WITH keyed AS (
  SELECT source AS repository_identity, left(sha256(path), 4) AS leaf,
    path || chr(0) || sha256(text) || chr(0) || strlen(text) AS entry, strlen(text) AS size
  FROM (SELECT *, 'docs/' || doc_id || '.txt' AS path FROM documents)
),
leaves AS (
  SELECT repository_identity, leaf, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS entry,
    count(*) AS entries, sum(size) AS bytes, max(size) AS largest FROM keyed GROUP BY ALL
),
branches AS (
  SELECT repository_identity, left(leaf, 2) AS branch, sha256(string_agg(leaf || ':' || entry, chr(10) ORDER BY leaf)) AS entry,
    sum(entries) AS entries, sum(bytes) AS bytes, max(largest) AS largest FROM leaves GROUP BY ALL
)
SELECT repository_identity, sha256(string_agg(branch || ':' || entry, chr(10) ORDER BY branch)) AS tree_sha256,
  sum(entries)::BIGINT AS entries, sum(bytes)::BIGINT AS bytes, max(largest) AS largest, 1 AS depth,
  sum(entries) <= 100000 AND sum(bytes) <= 2147483648 AS within_limits
FROM branches GROUP BY repository_identity"""

_EVIDENCE_ID = """'ev_' || sha256('{"alert_fingerprint":"' || sha256(d.text) || '","artifact_sha256":"' || sha256('label-' || l.doc_id)
  || '","excerpt":null,"extractor":"evidence-supplement@1.0","location":null,"origin":"human","path_fingerprint":null,"polarity":"' || polarity
  || '","raw_result_reference":{"raw_sarif_sha256":"' || sha256(l.doc_id::VARCHAR) || '","result_index":' || l.doc_id || ',"run_index":0},"source_anchor":null,"strength":"' || strength
  || '","summary":"label of document ' || l.doc_id || '","type":"verification"}')"""


def _text(value: str) -> str:
    """A JSON string or null; the values here need no escapes."""
    return f"""coalesce('"' || ({value}) || '"', 'null')"""


def _order_place(path: str, first: str, last: str, artifact: str = "NULL", end_column: str = "NULL") -> str:
    return f"""'{{"artifact_sha256":' || {_text(artifact)} || ',"column_kind":"unicodeCodePoints","end_column":'
      || coalesce(({end_column})::VARCHAR, 'null') || ',"end_line":' || {last} || ',"path":"' || {path} || '","snippet":null,"start_column":1,"start_line":' || {first} || '}}'"""


def _lifecycle_summary(kind: str) -> str:
    return next(summary for name, _, summary in fixed.LIFECYCLE_FAMILIES if name == kind).replace("'", "''")


# Nodes of an alert per order: part and a, b give their order, id follows from all fields.
_ORDER_NODES = f"""
a AS (SELECT o_orderkey AS k, sha256(o_orderkey::VARCHAR) AS doc, sha256('alert ' || o_orderkey) AS fp, sha256('slice ' || o_orderkey) AS sl,
  o_orderpriority AS rid, 'src/' || o_orderstatus || '.java' AS path, o_custkey % 100 + 1 AS line, o_orderpriority LIKE '1%' AS res,
  sha256('[{{"run_index":0,"result_index":0,"alert_fingerprint":"' || fp || '","analysis_id":"' || fp || '"}}]') AS norm FROM orders),
l AS (SELECT l_orderkey AS k, 'src/' || l_linestatus || '.java' AS path, l_returnflag AS flag, l_partkey % 100 + 1 AS low,
  l_partkey % 100 + 1 + l_quantity::BIGINT AS high, l_suppkey % 150 + 1 AS line FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path, low, high) - 1 AS ord, 'slice_' || sha256(path || ':' || low || '-' || high) AS id
  FROM (SELECT DISTINCT k, path, low, high FROM l)),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path, line) - 1 AS ord, count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT DISTINCT k, path, line FROM l WHERE flag = 'R')),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path, line) - 1 AS ord FROM (SELECT DISTINCT k, path, line FROM l WHERE flag = 'A')),
points AS (SELECT k, 0 AS part, 0 AS ord, path, line FROM a UNION ALL SELECT k, 1, ord, path, line FROM p UNION ALL SELECT k, 2, ord, path, line FROM g),
held AS (SELECT points.k, part, points.ord, min(s.ord) AS first, arg_min(id, s.ord) || '-L' || any_value(line) AS first_anchor,
    arg_max(id, s.ord) || '-L' || any_value(line) AS last_anchor
  FROM points JOIN s ON s.k = points.k AND s.path = points.path AND line BETWEEN low AND high GROUP BY ALL),
fields AS (
  SELECT a.k, 0 AS part, 0 AS a, 0 AS b, NULL AS holder, norm AS artifact, NULL AS excerpt, '{fixed.NORMALIZER_VERSION}' AS extractor,
    {_order_place("path", "line", "line")} AS place, 'codeql' AS origin, NULL AS pf, 'neutral' AS polarity, last_anchor AS anchor, 'low' AS strength,
    'What the scanner''s rule ' || rid || ' says of itself.' AS summary, 'rule_semantics' AS type
  FROM a LEFT JOIN held ON held.k = a.k AND held.part = 0
  UNION ALL SELECT p.k, 1, p.ord, 0, NULL, norm, NULL, '{fixed.NORMALIZER_VERSION}', {_order_place("p.path", "p.line", "p.line")}, 'codeql',
    sha256(p.path || ':' || p.line), 'supports_tp', last_anchor, 'medium', 'The scanner''s path ' || p.ord || ' of 1 steps, as recorded.', 'data_flow'
  FROM p JOIN a ON a.k = p.k LEFT JOIN held ON held.k = p.k AND held.part = 1 AND held.ord = p.ord
  UNION ALL SELECT s.k, 2, s.ord, 0, NULL, sl, CASE WHEN res THEN CASE WHEN low % 3 = 0 THEN 'return x;' ELSE 'x = 1;' END END,
    CASE WHEN res THEN 'java-resource-context@1.0' ELSE 'java-context@1.0' END,
    {_order_place("s.path", "low", "high", "sha256(s.path)")}, 'repository', NULL, 'neutral', id || '-L' || low, 'low',
    'Source text chosen by fixed_window, quoted as data.', CASE WHEN res THEN 'resource_lifecycle' ELSE 'data_flow' END
  FROM s JOIN a ON a.k = s.k
  UNION ALL SELECT s.k, 2, s.ord, b, NULL, sl, 'return x;', 'java-resource-lexical@1.0',
    {_order_place("s.path", "low", "low", "sha256(s.path)", "10")}, 'repository', NULL, 'neutral', id || '-L' || low, 'low', seen, kind
  FROM s JOIN a ON a.k = s.k AND res AND low % 3 = 0, (VALUES (1, 'control_flow_exit', '{_lifecycle_summary("control_flow_exit")}'),
    (2, 'resource_escape', '{_lifecycle_summary("resource_escape")}')) AS words(b, kind, seen)
  UNION ALL SELECT k, 3, 0, 0, NULL, sl, NULL, 'java-resource-context@1.0', 'null', 'repository', NULL, 'neutral', NULL, 'high',
    'Left out of the context: file_missing: order ' || k, 'context_gap' FROM a WHERE res
  UNION ALL SELECT g.k, 4, g.ord, 0, held.first, sl, 'if (x)', 'java-lexical@1.0', {_order_place("g.path", "g.line", "g.line")}, 'repository',
    NULL, 'neutral', first_anchor, 'low', 'A word pattern of a guard; what it does is open.', 'guard'
  FROM g JOIN a ON a.k = g.k JOIN held ON held.k = g.k AND held.part = 2 AND held.ord = g.ord),
nodes AS (SELECT f.*, doc, 'ev_' || sha256('{{"alert_fingerprint":"' || fp || '","artifact_sha256":"' || artifact || '","excerpt":' || {_text("excerpt")}
  || ',"extractor":"' || extractor || '","location":' || place || ',"origin":"' || origin || '","path_fingerprint":' || {_text("pf")} || ',"polarity":"' || polarity
  || '","raw_result_reference":{{"raw_sarif_sha256":"' || doc || '","result_index":0,"run_index":0}},"source_anchor":' || {_text("anchor")}
  || ',"strength":"' || strength || '","summary":"' || summary || '","type":"' || type || '"}}') AS id
  FROM fields f JOIN a ON a.k = f.k)"""


ORACLES: dict[str, str] = {
    "lines_numbered": f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines",
    "source_scan": """
WITH framed AS (
  SELECT 'docs/' || doc_id || '.txt' AS path, lang,
    CASE WHEN lang = 'de' THEN '\\xEF\\xBB\\xBF'::BLOB || text::BLOB WHEN lang = 'es' THEN text::BLOB || '\\x00'::BLOB
         WHEN lang = 'fr' THEN text::BLOB || '\\xC3'::BLOB ELSE text::BLOB END AS content, text
  FROM (SELECT doc_id, lang, text AS raw, encode(text) AS text, text AS plain FROM documents)
),
sized AS (
  SELECT f.path, f.lang, f.content, d.text AS plain, octet_length(f.content) AS size
  FROM framed f JOIN documents d ON f.path = 'docs/' || d.doc_id || '.txt'
),
classed AS (
  SELECT *, CASE WHEN lang = 'es' THEN 'binary_source'
                 WHEN lang = 'fr' THEN 'unsupported_encoding' ELSE 'ok' END AS status FROM sized
)
SELECT path, sha256(content) AS artifact_sha256, size, status,
  CASE WHEN status = 'ok' THEN length(plain) END AS text_length FROM classed""",
    "strict_json": "SELECT event_id, event_type IN ('click', 'purchase') AND json_valid(props) AS accepted FROM events",
    "document_gate": """
SELECT source AS repository_identity,
  CASE source WHEN 'src1' THEN 'version is not 2.1.0' WHEN 'src2' THEN 'run with results requires columnKind'
              WHEN 'src3' THEN 'not strict JSON' WHEN 'src4' THEN 'unexpected JSON type' ELSE 'accepted' END AS reason,
  count(*) AS documents FROM documents GROUP BY ALL""",
    "repeated_documents": """
SELECT sha256(text) AS raw_sarif_sha256, min(source) AS repository_identity, count(*) - 1 AS rejected FROM documents GROUP BY 1""",
    "rule_resolve": """
WITH r AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_linenumber - 2 END AS i,
    CASE WHEN l_returnflag <> 'A' THEN 'r' || (floor(l_quantity)::INT % 4) END AS id FROM lineitem
)
SELECT l_orderkey, l_linenumber,
  CASE WHEN i < 0 THEN 'ruleIndex is negative' WHEN i > 2 THEN 'ruleIndex is out of range'
       WHEN id <> 'r' || i THEN 'ruleId and ruleIndex name different rules'
       WHEN id IS NULL AND i IS NULL THEN 'ruleId or ruleIndex is required' END AS reason,
  coalesce(id, CASE WHEN i BETWEEN 0 AND 2 THEN 'r' || i END) AS rule_id,
  CASE WHEN id IS NOT NULL THEN nullif(id, 'r3') WHEN i BETWEEN 0 AND 2 THEN 'r' || i END AS declared FROM r""",
    "checksums": """
SELECT sha256(text) AS sha256, CASE WHEN lang = 'fr' THEN '../' ELSE 'doc-' END || doc_id || '.txt' AS name,
  lang <> 'fr' AS valid FROM documents""",
    "duplicate_checksum_names": """
SELECT 'turn-' || turn || '.txt' AS name, count(*) AS count FROM conversations GROUP BY turn HAVING count(*) > 1""",
    "tree_identity": _TREE,
    "inventory": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
  CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unrecorded'
       WHEN l.toxic = 1 AND upper(d.text) <> d.text THEN 'changed' ELSE 'same' END AS status
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""",
    "sarif_alerts": f"""
WITH {_LINES}, {_paths("'\"' || sha256(text) || '\"'")}, ruled AS (SELECT *, {_RULE} AS rule_id FROM pathed)
SELECT source AS repository_identity, path, 0 AS run_index, line_no - 1 AS result_index, rule_id,
  {_family("rule_id")} AS family,
  CASE WHEN rule_id LIKE 'js/%' THEN 'CWE-79' ELSE 'CWE-772' END AS cwe,
  CASE WHEN rule_id LIKE 'js/%' THEN 'error' ELSE 'warning' END AS level,
  line_no AS start_line, line_no AS end_line, length(line) + 1 AS end_column, sha256(text) AS artifact_sha256,
  sha256('{fixed.ALERT_DOMAIN}' || chr(0) || '{{"fingerprints":{{}},"message":"line ' || line_no ||
    '","partial_fingerprints":{{}},"path_fingerprints":["' || path_fingerprint || '"],"primary_location":' || here ||
    ',"rule_id":"' || rule_id || '"}}') AS alert_fingerprint
FROM ruled""",
    "sarif_paths": f"""
WITH {_LINES}, {_paths("'null'")}
SELECT path, line_no - 1 AS result_index, 0 AS ordinal, CASE WHEN line_no = 1 THEN 1 ELSE 2 END AS n_steps,
  CASE WHEN line_no = 1 THEN 'partial' ELSE 'complete' END AS completeness,
  CASE WHEN line_no = 1 THEN 'source' ELSE 'source>sink' END AS kinds,
  greatest(1, line_no - 1) AS source_line, path_fingerprint FROM pathed""",
    "policy_facts": """
WITH l AS (SELECT *, (l_linenumber + l_orderkey) % 7 AS slot FROM lineitem), c AS (
  SELECT l_orderkey, 'c' || l_linenumber AS claim_id,
    ['source_controllable', 'path_feasible', 'sink_dangerous', 'exploit_succeeds', 'resource_acquisition', 'feasible_unreleased_exit', 'release_coverage'][slot + 1] AS kind,
    CASE WHEN l_returnflag <> 'R' THEN 'supported' WHEN l_quantity > 48 THEN 'unresolved' ELSE 'rebutted' END AS status,
    l_suppkey % 4 <> 0 AS analyst, ['e' || l_linenumber, 'e' || (floor(l_quantity)::INT % 9)] AS ids FROM l
), e AS (
  SELECT l_orderkey, 'e' || l_linenumber AS evidence_id,
    CASE slot WHEN 0 THEN 'source_control' WHEN 1 THEN 'data_flow' WHEN 2 THEN 'sink_semantics' WHEN 3 THEN 'verification'
      WHEN 5 THEN CASE WHEN l_partkey % 5 = 0 THEN 'context_gap' ELSE 'code_slice' END ELSE 'code_slice' END AS type,
    l_partkey % 3 <> 0 AS for_tp, l_partkey % 4 AS strength FROM l
), k AS (
  SELECT c.* FROM c JOIN orders ON o_orderkey = l_orderkey WHERE (o_orderkey + substr(claim_id, 2)::INT) % 4 <> 0
), cited AS (
  SELECT x.*, type, for_tp, strength FROM (SELECT l_orderkey, kind, status, analyst, unnest(ids) AS evidence_id FROM k) x JOIN e USING (l_orderkey, evidence_id)
), considered AS (
  SELECT l_orderkey, for_tp, strength FROM cited
  UNION ALL SELECT l_orderkey, for_tp, strength FROM e JOIN orders ON o_orderkey = l_orderkey WHERE evidence_id = 'e' || (o_custkey % 9)
), by_cited AS (
  SELECT l_orderkey, coalesce(bool_or(NOT analyst AND status = 'rebutted' AND NOT for_tp AND strength = 3), false) AS rebuttal,
    coalesce(bool_or(analyst AND status = 'supported' AND kind = 'exploit_succeeds' AND for_tp AND type = 'verification' AND strength = 3), false) AS verified,
    count(DISTINCT kind) FILTER (analyst AND status = 'supported' AND for_tp AND strength > 0 AND
      (kind, type) IN (('source_controllable', 'source_control'), ('path_feasible', 'data_flow'), ('sink_dangerous', 'sink_semantics'))) = 3 AS complete
  FROM cited GROUP BY l_orderkey
), by_considered AS (
  SELECT l_orderkey, true AS has_considered, bool_or(for_tp AND strength > 1) AS high_tp, bool_or(NOT for_tp AND strength > 1) AS high_fp FROM considered GROUP BY l_orderkey
), by_claim AS (
  SELECT l_orderkey, bool_or(status = 'unresolved') AS has_unresolved,
    count(DISTINCT kind) FILTER (status = 'supported' AND kind IN ('resource_acquisition', 'feasible_unreleased_exit')) = 2 AS tp_claims,
    bool_or(kind = 'release_coverage' AND status IN ('supported', 'rebutted')) AS fp_claim FROM k GROUP BY l_orderkey
), gaps AS (SELECT l_orderkey, bool_or(type = 'context_gap') AS context_gap FROM e GROUP BY l_orderkey), f AS (
  SELECT o_orderkey AS l_orderkey, o_orderpriority = '1-URGENT' AS unknowns,
    CASE o_orderstatus WHEN 'O' THEN 'TP' WHEN 'F' THEN 'FP' ELSE 'NMC' END AS requested_label,
    coalesce(has_unresolved, false) AS has_unresolved, coalesce(has_considered, false) AS has_considered,
    coalesce(high_tp, false) AS high_tp, coalesce(high_fp, false) AS high_fp, coalesce(rebuttal, false) AS decisive_rebuttal,
    coalesce(verified OR complete, false) AS tp_supported, coalesce(tp_claims, false) AS tp_claims,
    coalesce(fp_claim, false) AS fp_claim, coalesce(context_gap, false) AS context_gap
  FROM orders LEFT JOIN by_cited b ON b.l_orderkey = o_orderkey LEFT JOIN by_considered d ON d.l_orderkey = o_orderkey
    LEFT JOIN by_claim c ON c.l_orderkey = o_orderkey LEFT JOIN gaps g ON g.l_orderkey = o_orderkey
)
SELECT * EXCLUDE (unknowns), CASE
  WHEN requested_label = 'NMC' OR NOT has_considered OR unknowns OR has_unresolved OR (high_tp AND high_fp) THEN 'NMC'
  WHEN requested_label = 'TP' AND high_fp THEN 'NMC'
  WHEN requested_label = 'FP' THEN CASE WHEN decisive_rebuttal THEN 'FP' ELSE 'NMC' END
  WHEN tp_supported THEN 'TP' ELSE 'NMC' END AS label FROM f""",
    "run_references": f"""
WITH {_LINES}, r AS (
  SELECT doc_id, line_no - 1 AS i, n_lines AS n, ((line_no - 1) * 7) % n_lines AS rule FROM lines
), p AS (
  SELECT *, CASE i % 4 WHEN 0 THEN 'docs/sub/' || i WHEN 1 THEN 'docs/art-' || (n - 1 - i)
    WHEN 2 THEN 'sub/' || i ELSE 'docs/deep/art-' || (n - 1 - i) END || '.txt' AS path FROM r
)
SELECT 'doc ' || doc_id AS message, i AS result_index, 'r' || (n - rule) AS rule_id, 'n' || rule AS rule_name,
  CASE WHEN rule % 2 = 0 THEN 'error' ELSE 'warning' END AS level, path, i + 1 AS start_line,
  CASE WHEN i % 4 > 1 THEN path END AS related_path FROM p""",
    "analysis_ids": f"""
SELECT doc_id, 'analysis-' || sha256('{{"commit_sha":"' || sha1(doc_id::VARCHAR) || '","normalizer_version":"{fixed.NORMALIZER_VERSION}","raw_sarif_sha256":"'
  || sha256(text) || '","repository_identity":"' || source || '"}}') AS analysis_id FROM documents""",
    "rule_families": f"""
WITH r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'java/unreleased-lock' WHEN l_returnflag = 'R' THEN 'java/input-resource-leak'
  WHEN l_linestatus = 'F' THEN 'java/unreleased-lock2' ELSE 'java/database-resource-leak' END AS rule_id FROM lineitem)
SELECT rule_id, {_family("rule_id")} AS family,
  CASE {_family("rule_id")} WHEN 'legacy_security' THEN NULL ELSE split_part({_family("rule_id")}, '_', 2) END AS resource_kind,
  count(*) AS alerts FROM r GROUP BY ALL""",
    "cwe_tags": """
SELECT p_partkey, CASE WHEN p_size = length(p_name) THEN 'CWE-' || p_size
  WHEN p_size < length(p_name) THEN 'CWE-' || p_size || ',CWE-' || length(p_name)
  ELSE 'CWE-' || length(p_name) || ',CWE-' || p_size END AS cwe FROM part""",
    "uri_canonical": """
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS uri FROM pages)
SELECT page_id,
  CASE WHEN uri = '' OR regexp_matches(uri, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN 'invalid URI'
       WHEN regexp_matches(uri, '[?#].') THEN 'query or fragment is not allowed' END AS reason,
  CASE WHEN uri = '' THEN '' ELSE array_to_string(list_filter(string_split(regexp_replace(uri, '[?#].*$', ''), '/'), lambda p: p NOT IN ('', '.')), '/') END AS path
FROM u""",
    "uri_relative": """
WITH u AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, url LIKE 'https://%' AS secure,
    array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', ''), '/'), lambda p: p <> ''), '/') AS rest
  FROM pages
),
m AS (SELECT *, CASE WHEN NOT secure THEN NULL WHEN rest = 'en' THEN '' WHEN rest LIKE 'en/%' THEN substr(rest, 4) END AS path FROM u)
SELECT page_id, CASE WHEN path IS NULL THEN 'outside its declared source base'
                     WHEN path = '' THEN 'resolves to the source root, not a file' END AS reason,
  CASE WHEN path <> '' THEN path END AS path FROM m""",
    "uri_reject_counts": "SELECT 'scheme is not allowed' AS reason, count(*) AS pages FROM pages WHERE regexp_matches(url, '^https?:')",
    "base_chain": f"""
WITH {_LINES}, sized AS (SELECT doc_id, lang, max(n_lines) AS n FROM lines GROUP BY ALL)
SELECT doc_id,
  CASE WHEN n > 64 THEN 'URI base chain is too deep' WHEN lang = 'fr' AND n = 64 THEN 'URI base chain is too deep'
       WHEN lang = 'fr' THEN 'URI base chain is cyclic' END AS reason,
  CASE WHEN n <= 64 AND lang <> 'fr' THEN array_to_string(list_concat(['root'], list_transform(range(2, n + 1), lambda i: 'd' || i)), '/') END AS path
FROM sized""",
    "provenance": """
SELECT l.doc_id AS result_index, 'provenance does not match its document' AS detail
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1 OR d.doc_id IS NULL""",
    "fixed_window": f"""
WITH {_LINES}, ended AS (SELECT path, doc_id, line_no, n_lines, {_ENDED} AS content FROM lines),
windows AS (
  SELECT a.path, a.line_no, greatest(1, a.line_no - 5) AS start_line, least(a.n_lines, a.line_no + 5) AS end_line,
    string_agg(b.content, '' ORDER BY b.line_no) AS content
  FROM ended a JOIN ended b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 5 AND a.line_no + 5 GROUP BY ALL
)
SELECT path, line_no, start_line, end_line, sha256(content) AS content_sha256, (strlen(content) + 3) // 4 AS tokens FROM windows""",
    "coordinates": f"""
WITH {_LINES}
SELECT path, line_no, CASE WHEN length(line) < 39 THEN 'start column 40' ELSE 'end column 60' END
  || ' lies behind a line of ' || length(line) || ' utf16CodeUnits' AS coordinate_error
FROM lines WHERE length(line) < 59""",
    "token_estimate": "SELECT doc_id, (strlen(text) + 3) // 4 AS tokens FROM documents",
    "budget_pack": f"""
WITH RECURSIVE {_LINES},
sizes AS (SELECT doc_id, line_no, n_lines, (strlen({_ENDED}) + 3) // 4 AS tokens FROM lines),
packed AS (
  SELECT doc_id, 0 AS line_no, 20::BIGINT AS total, [] :: BIGINT[] AS kept, 0 AS dropped, -1::BIGINT AS first_remaining
  FROM sizes WHERE line_no = 1
  UNION ALL
  SELECT p.doc_id, s.line_no,
    CASE WHEN p.total + s.tokens <= 500 THEN p.total + s.tokens ELSE p.total END,
    CASE WHEN p.total + s.tokens <= 500 THEN list_append(p.kept, s.line_no) ELSE p.kept END,
    p.dropped + CASE WHEN p.total + s.tokens <= 500 THEN 0 ELSE 1 END,
    CASE WHEN p.first_remaining = -1 AND p.total + s.tokens > 500 THEN 500 - p.total ELSE p.first_remaining END
  FROM packed p JOIN sizes s ON s.doc_id = p.doc_id AND s.line_no = p.line_no + 1
)
SELECT p.doc_id, p.total, array_to_string(p.kept, ',') AS kept_lines, p.dropped, p.first_remaining
FROM packed p JOIN (SELECT doc_id, max(n_lines) AS n FROM sizes GROUP BY doc_id) m ON p.doc_id = m.doc_id AND p.line_no = m.n""",
    "context_slices": f"""
WITH {_LINES}, ended AS (SELECT path, doc_id, text, line_no, n_lines, {_ENDED} AS content FROM lines),
refs AS (
  SELECT path, doc_id, text, line_no, n_lines, line_no AS spot, 0 AS ord, 'primary' AS kind FROM ended
  UNION ALL SELECT path, doc_id, text, line_no, n_lines, greatest(1, line_no - 1), 1, 'source' FROM ended
  UNION ALL SELECT path, doc_id, text, line_no, n_lines, line_no, 2, 'sink' FROM ended WHERE line_no > 1
),
ranges AS (
  SELECT path, doc_id, text, line_no, greatest(1, spot - 5) AS start_line, least(n_lines, spot + 5) AS end_line,
    min(ord) AS ord, string_agg(kind, ',' ORDER BY ord) AS reference_kinds
  FROM refs GROUP BY path, doc_id, text, line_no, greatest(1, spot - 5), least(n_lines, spot + 5)
),
texts AS (
  SELECT w.doc_id, w.start_line, w.end_line, sha256(string_agg(b.content, '' ORDER BY b.line_no)) AS content_sha256
  FROM (SELECT DISTINCT doc_id, start_line, end_line FROM ranges) w
  JOIN ended b ON b.doc_id = w.doc_id AND b.line_no BETWEEN w.start_line AND w.end_line GROUP BY ALL
)
SELECT r.path, r.line_no - 1 AS result_index, row_number() OVER (PARTITION BY r.doc_id, r.line_no ORDER BY r.ord) - 1 AS slice_ord,
  r.start_line, r.end_line, r.reference_kinds,
  'slice_' || sha256('{{"artifact_sha256":"' || sha256(r.text) || '","content_sha256":"' || t.content_sha256 || '","end_line":' || r.end_line
    || ',"path":"' || r.path || '","selection":"fixed_window","start_line":' || r.start_line || '}}') AS slice_id
FROM ranges r JOIN texts t USING (doc_id, start_line, end_line)""",
    "callable_index": f"WITH {_LINES}, {_CODE} SELECT path, start_line, end_line, symbol FROM callables",
    "source_index_pruned": f"""
WITH {_LINES}, {_CODE}
SELECT path, start_line, end_line, symbol FROM callables
WHERE path IN (SELECT 'docs/' || doc_id || '.txt' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "enclosing_callable": f"""
WITH {_LINES}, {_CODE}
SELECT path, line_no, c.start_line AS callable_start, c.end_line AS callable_end, c.symbol AS callable_symbol FROM innermost""",
    "callee_definitions": f"""
WITH {_LINES}, {_CODE},
names AS (
  SELECT path, line_no, unnest(regexp_extract_all(regexp_replace(code_line, '//.*$', ''), '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS name FROM code
),
ranges AS (
  SELECT DISTINCT n.path, n.name, i.c.start_line AS s, i.c.end_line AS e
  FROM names n JOIN innermost i ON n.path = i.path AND n.line_no = i.line_no AND i.c.symbol = n.name
)
SELECT path, name, count(*) AS definitions, arg_min(s, (s, e)) AS callable_start, arg_min(e, (s, e)) AS callable_end FROM ranges GROUP BY path, name""",
    "callees_ranked": f"""
WITH {_LINES}, words AS (
  SELECT doc_id, line_no, name, count(*) AS c FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]+')) AS name FROM lines) GROUP BY ALL HAVING count(*) = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY name) AS rank, count(*) OVER (PARTITION BY doc_id, line_no) AS singles FROM words
)
SELECT doc_id, line_no, name, rank, singles FROM ranked""",
    "lexical_candidates": _lexical(),
    "lexical_families": _lifecycle(),
    "omission_dedupe": f"""
WITH {_LINES}, noted AS (
  SELECT doc_id, CASE WHEN length(line) > 200 THEN 'source_too_large' ELSE 'coordinate_out_of_bounds' END AS code,
    'first letter ' || substr(line, 1, 1) AS detail, min(line_no) AS first_line FROM lines GROUP BY ALL
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS ord, code, detail FROM noted""",
    "evidence_ids": f"""
WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'supports_tp' WHEN quality = 1 THEN 'supports_fp' ELSE 'neutral' END AS polarity,
  CASE WHEN toxic = 1 THEN 'decisive' WHEN quality = 1 THEN 'high' ELSE 'low' END AS strength FROM labels)
SELECT l.doc_id AS result_index, {_EVIDENCE_ID} AS evidence_id, 'verification' AS type, polarity, strength, 'human' AS origin,
  'label of document ' || l.doc_id AS summary FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang IS DISTINCT FROM 'fr'""",
    "supplement_rejects": """
SELECT sha256('label-' || l.doc_id) AS supplement_sha256, l.doc_id AS result_index, 'POLICY_REJECTED' AS error_code,
  'supplement cites an unavailable occurrence' AS detail
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang IS DISTINCT FROM 'fr' WHERE d.doc_id IS NULL""",
    "evidence_nodes": f"""
WITH {_ORDER_NODES}
SELECT doc AS raw_sarif_sha256, row_number() OVER (PARTITION BY k ORDER BY part, a, b) - 1 AS item_ord, id AS evidence_id, type,
  anchor AS source_anchor, summary FROM nodes""",
    "evidence_edges": f"""
WITH {_ORDER_NODES}, rule AS (SELECT k, id FROM nodes WHERE part = 0),
own AS (SELECT * FROM nodes WHERE part = 2 AND b = 0),
links AS (
  SELECT n.k, n.part, n.a, 0 AS b, n.id, rule.id AS target FROM nodes n JOIN rule ON rule.k = n.k WHERE n.part IN (1, 3)
  UNION ALL SELECT n.k, n.part, n.a, n.b, n.id, own.id FROM nodes n JOIN own ON own.k = n.k AND own.a = n.a WHERE n.part = 2 AND n.b > 0
  UNION ALL SELECT own.k, 2, own.a, 9, own.id, coalesce(path.id, rule.id)
    FROM own JOIN rule ON rule.k = own.k JOIN s ON s.k = own.k AND s.ord = own.a
    LEFT JOIN p ON p.k = own.k AND low % 2 = 0 AND p.ord = low % p.n
    LEFT JOIN nodes path ON path.k = own.k AND path.part = 1 AND path.a = p.ord
  UNION ALL SELECT n.k, 4, n.a, 0, n.id, own.id FROM nodes n JOIN own ON own.k = n.k AND own.a = n.holder WHERE n.part = 4)
SELECT doc AS raw_sarif_sha256, row_number() OVER (PARTITION BY k ORDER BY part, a, b) - 1 AS edge_ord, links.id AS source_evidence_id,
  'depends_on' AS relation, target AS target_evidence_id FROM links JOIN a USING (k)""",
    "closure_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "closure_orders": """
SELECT 'line' AS side, l_returnflag AS kind, count(*) AS "references" FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL
UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 25) GROUP BY ALL""",
    "dot_lines": """
WITH n AS (SELECT 0 AS run_index, n_nationkey AS ord, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)
SELECT 1 AS part, run_index, ord, '  "ev_' || sha256(name) || '" [label="' || name || '\\"x\\"\\nev_' || left(sha256(name), 12) || '"];' AS line FROM n
UNION ALL SELECT 2, 0, n_nationkey, '  "ev_' || sha256(n_name) || '" -> "ev_' || sha256(r_name) || '" [label="depends_on"];'
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL VALUES (0, 0, 0, 'digraph evidence {'), (0, 0, 1, '  rankdir=LR;'), (3, 0, 0, '}')""",
    "redact_documents": f"""
SELECT doc_id, sha256({_redacted("text")}) AS redacted_sha256, {_redacted("text")} <> text AS changed FROM documents""",
    "redact_conversations": f"""
WITH c AS (SELECT conv_id, turn, role, {_redacted("text || ' Authorization: Bearer ab.' || conv_id || ' https://u:p@host/x password=' || turn")} AS note FROM conversations)
SELECT conv_id, turn, sha256('{{"api_token":"[REDACTED]","note":' || to_json(note)::VARCHAR || ',"parts":[' || to_json(note)::VARCHAR || ',"' || role || '"]}}') AS payload_sha256 FROM c""",
    "request_lookup": """
WITH r AS (SELECT sha256(text) AS h, min(d.doc_id) AS answered_by FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT doc_id, answered_by FROM documents JOIN r ON sha256(text) = h""",
    "request_miss": """
SELECT doc_id, sha256(text) AS request_sha256 FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "request_hashes": """
SELECT doc_id, sha256('{"agent_role":"analyst","profile":{"data_policy":"offline_only","id":"replay.v1","maximum_output_tokens":8192,"model_id":"recorded-model","provider":"replay","schema_version":"1.0","temperature":0.0},"response_schema":"security-analyst","system_prompt":"analyst instructions","user_payload":{"target":{"alert_fingerprint":"'
  || sha256(text) || '"},"untrusted_code_data":{"evidence_items":["' || lang || '"]}}}') AS request_sha256 FROM documents""",
    "analyst_responses": """
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'not a strict object of the response schema'
  WHEN lang = 'de' THEN 'cites evidence outside the exact alert occurrence'
  WHEN lang = 'fr' THEN 'analyst cannot author rebutted claims' ELSE 'accepted' END AS outcome FROM documents""",
    "claim_ids": """
SELECT doc_id, 'cl_' || sha256('{"evidence_ids":["ev_' || sha256(doc_id::VARCHAR) || '"],"kind":"sink_dangerous","produced_by":"analyst","schema_version":"1.0","statement":"document '
  || doc_id || '","status":"' || CASE WHEN toxic = 1 THEN 'supported' ELSE 'unresolved' END || '"}') AS claim_id FROM labels""",
    "first_valid_attempt": """
SELECT conv_id, count(*) AS attempts, min(turn) FILTER (role = 'assistant' AND length(text) > 400) AS turn,
  arg_min(length(text), turn) FILTER (role = 'assistant' AND length(text) > 400) AS size FROM conversations GROUP BY conv_id""",
    "role_order": """
WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'rebuttal' ELSE 'judge' END AS role, length(text) > 200 AS ok FROM conversations),
g AS (SELECT conv_id, count(*) AS calls, coalesce(string_agg(role, ',' ORDER BY turn) FILTER (ok), '') AS roles FROM c GROUP BY conv_id)
SELECT conv_id, calls FROM g WHERE roles <> 'analyst,rebuttal,judge' OR calls NOT BETWEEN 3 AND 6""",
    "invocation_counts": """
SELECT CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'rebuttal' ELSE 'judge' END AS agent_role,
  CASE WHEN length(text) > 200 THEN 'accepted' ELSE 'invalid' END AS status, count(*) AS count FROM conversations GROUP BY ALL""",
    "reference_subset": f"""
WITH {_LINES}, parts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no < n_lines) AS rest, max(line) FILTER (line_no = n_lines) AS final FROM lines GROUP BY doc_id
)
SELECT doc_id, list_has_all(regexp_extract_all(coalesce(rest, ''), '[a-z]+'), regexp_extract_all(final, '[a-z]+')) AS closed FROM parts""",
    "policy_security": _security_policy(),
    "policy_resource": _resource_policy(),
    "profile_gate": """
SELECT c_name AS project_id, 'POLICY_REJECTED' AS error_code,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'profile does not match the runtime profile' ELSE 'source-upload policy does not match the profile' END AS detail
FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""",
    "eval_rows": f"WITH {_AUTOMATIC} SELECT * FROM aligned",
    "confusion": f"""
WITH {_AUTOMATIC}
SELECT l.label AS baseline_label, count(*) FILTER (agreement IS NOT NULL AND baseline_label = l.label AND automatic_label = 'TP') AS "TP",
  count(*) FILTER (agreement IS NOT NULL AND baseline_label = l.label AND automatic_label = 'FP') AS "FP",
  count(*) FILTER (agreement IS NOT NULL AND baseline_label = l.label AND automatic_label = 'NMC') AS "NMC"
FROM aligned, (VALUES ('TP'), ('FP'), ('NMC')) l(label) GROUP BY l.label""",
    "class_metrics": _metrics(),
    "evaluation_rates": f"""
WITH {_AUTOMATIC}, c AS (
  SELECT count(*) FILTER (agreement IS NOT NULL) AS aligned_count, count(*) FILTER (automatic_label IS NULL) AS missing_automatic,
    count(*) FILTER (baseline_label IS NULL) AS missing_baseline, count(*) FILTER (agreement) AS agreed,
    {", ".join(f'count(*) FILTER (agreement IS NOT NULL AND automatic_label = {chr(39)}{x}{chr(39)}) AS "automatic_{x}"' for x in fixed.LABELS)},
    {", ".join(f'count(*) FILTER (baseline_label = {chr(39)}{x}{chr(39)}) AS "baseline_{x}"' for x in fixed.LABELS)}
  FROM aligned)
SELECT * EXCLUDE (agreed), round({_ratio("agreed", "aligned_count")}, 9) AS agreement,
  round({_ratio('"automatic_TP" + "automatic_FP"', "aligned_count")}, 9) AS determined_rate,
  round({_ratio('"automatic_NMC"', "aligned_count")}, 9) AS nmc_rate FROM c""",
    "legacy_bind": """
WITH s AS (
  SELECT s_suppkey, s_acctbal, chr(65 + n_regionkey) AS prefix, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
m AS (SELECT *, CASE WHEN r_name = 'EUROPE' THEN 'no exact binding for the prefix'
  WHEN s_acctbal > 9000 OR s_acctbal < 0 THEN 'cross-check disagrees with the bound occurrence' END AS reason FROM s)
SELECT CASE WHEN reason IS NULL THEN s_suppkey::VARCHAR ELSE prefix || '-' || s_suppkey END AS item,
  CASE WHEN reason IS NULL THEN CASE WHEN s_acctbal > 5000 THEN 'TP' ELSE 'FP' END END AS label, reason FROM m""",
    "label_counts": f"""
WITH {_AUTOMATIC} SELECT source, count(*) AS alert_count, count(*) FILTER (label = 'TP') AS tp_count,
  count(*) FILTER (label = 'FP') AS fp_count, count(*) FILTER (label = 'NMC') AS nmc_count FROM automatic GROUP BY source""",
    "dup_occurrences": "SELECT sha256(text) AS text_sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "rule_counts": f"WITH {_LINES} SELECT sha256(source) AS raw_sarif_sha256, {_RULE} AS rule_id, count(*) AS result_count FROM lines GROUP BY ALL",
    "preflight_cases": f"WITH {_LINES}, {_CASES} SELECT case_id, mode, result_count, reason FROM checked",
    "call_forecast": f"""
WITH {_LINES}, {_CASES} SELECT coalesce(sum(result_count) FILTER (mode = 'triage'), 0)::BIGINT AS triage_alert_count,
  coalesce(3 * sum(result_count) FILTER (mode = 'triage'), 0)::BIGINT AS minimum_model_calls,
  coalesce(6 * sum(result_count) FILTER (mode = 'triage'), 0)::BIGINT AS maximum_model_calls FROM checked""",
    "case_results": f"""{_SOURCES}
SELECT case_id, status, alert_count, CASE WHEN status = 'completed' THEN tp ELSE 0 END AS tp_count,
  CASE WHEN status = 'completed' THEN fp ELSE 0 END AS fp_count, CASE WHEN status = 'completed' THEN nmc ELSE 0 END AS nmc_count,
  0 AS invocation_count, CASE WHEN status = 'failed' THEN 'MODEL_RESPONSE_INVALID' END AS error_code FROM cases""",
    "experiment_summary": f"""{_SOURCES},
t AS (SELECT bool_or(status = 'failed') AS bad, sum(alert_count) FILTER (status <> 'audit_only') AS total,
  sum(alert_count) FILTER (status = 'completed') AS decided, sum(tp) FILTER (status = 'completed') AS tp,
  sum(fp) FILTER (status = 'completed') AS fp, sum(nmc) FILTER (status = 'completed') AS nmc FROM cases)
SELECT 0 AS ord, '- Status: `' || CASE WHEN bad THEN 'incomplete' ELSE 'completed' END || '`' AS value FROM t
UNION ALL SELECT 1, '- Alerts: ' || decided || '/' || total FROM t
UNION ALL SELECT 2, '- Decisions: TP ' || tp || ' / FP ' || fp || ' / NMC ' || nmc FROM t
UNION ALL SELECT 3, '- Model calls: 0' UNION ALL SELECT 4, 'Labels are second opinions; no alert is closed by this run.'""",
    "before_after": """
SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)""",
    "history_target": """
WITH hits AS (SELECT source, n_chars FROM documents WHERE lang = 'en' AND doc_id = 1),
c AS (SELECT count(*) FILTER (source = 'src1') AS before_targets, count(*) FILTER (source = 'src2') AS after_targets,
  min(CASE WHEN source = 'src1' THEN CASE WHEN n_chars > 2000 THEN 'TP' ELSE 'NMC' END END) AS before_label FROM hits)
SELECT CASE WHEN before_targets = 1 AND after_targets = 0 THEN 'confirmed' ELSE 'rejected' END AS status, *,
  (SELECT count(*) FROM documents WHERE source = 'src1') AS before_count, (SELECT count(*) FROM documents WHERE source = 'src2') AS after_count,
  (SELECT count(*) FROM documents WHERE source = 'src3') AS full_before_count, (SELECT count(*) FROM documents WHERE source = 'src4') AS full_after_count FROM c""",
    "ground_truth": """
SELECT coalesce(d.doc_id, l.doc_id) AS result_index, CASE WHEN l.doc_id IS NOT NULL THEN 'case-' || l.doc_id END AS case_id,
  CASE WHEN l.doc_id IS NULL THEN 'report without a case' WHEN d.doc_id IS NULL THEN 'case without a report'
       WHEN d.lang = 'de' THEN 'CWE differs'
       WHEN CASE WHEN d.n_chars > 5000 THEN 'TP' ELSE 'NMC' END <> CASE WHEN l.toxic = 1 THEN 'TP' ELSE 'NMC' END THEN 'label differs'
       WHEN l.quality = 0 AND NOT contains(d.text, ' the ') THEN 'injection text is absent from its slice' END AS reason
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""",
    "specification_digest": """
WITH lines AS (SELECT l_orderkey AS project_id, array_agg(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey::VARCHAR) AS steps,
  list_sort(list_distinct(array_agg(l_returnflag))) AS languages,
  array_agg(DISTINCT '{"name":"' || l_returnflag || '","version":"' || l_linestatus || '"}') AS packs FROM lineitem GROUP BY 1),
quoted AS (SELECT *, '["' || array_to_string(languages, '","') || '"]' AS l, '["' || array_to_string(steps, '","') || '"]' AS s,
  '[' || array_to_string(list_sort(packs), ',') || ']' AS p FROM lines)
SELECT project_id, sha256('{"languages":' || l || ',"packs":' || p || ',"source":null,"steps":' || s || '}') AS digest FROM quoted""",
    "chain_append": f"""
WITH e AS (
  SELECT l_orderkey AS run_id, l_linenumber - 1 AS sequence,
    CASE WHEN l_linenumber > 1 THEN CASE WHEN l_tax > 0.07 THEN 'CREATED' ELSE {_STATES}[l_linenumber - 1] END END AS from_state,
    CASE WHEN l_returnflag = 'R' AND l_linenumber > 4 THEN 'MODEL_FAILED' ELSE {_STATES}[l_linenumber] END AS to_state FROM lineitem
),
l AS (SELECT run_id, max(sequence) AS last, arg_max(to_state, (sequence, to_state)) AS state FROM e WHERE sequence <= 2 GROUP BY run_id),
g AS (SELECT run_id, sequence, count(*) AS copies, min((coalesce(from_state, ''), to_state)) AS event FROM e WHERE sequence >= 2 GROUP BY ALL),
n AS (SELECT g.run_id, sequence, copies, nullif(event[1], '') AS from_state, event[2] AS to_state, coalesce(sequence <= last, false) AS late
  FROM g LEFT JOIN l ON l.run_id = g.run_id),
b AS (SELECT run_id, sequence, to_state FROM n WHERE NOT late UNION ALL SELECT run_id, last, state FROM l),
f AS (SELECT n.*, CASE WHEN late THEN NULL WHEN copies > 1 THEN 'sequence is repeated' WHEN b.to_state IS NULL THEN 'sequence is not contiguous'
  WHEN n.from_state IS DISTINCT FROM b.to_state THEN 'state chain is discontinuous'
  WHEN NOT (b.to_state || '>' || n.to_state IN ({_TRANSITIONS}) OR (n.to_state IN ({_FAILURES}) AND b.to_state NOT IN ({_FAILURES}))) THEN 'invalid transition' END AS own
  FROM n LEFT JOIN b ON b.run_id = n.run_id AND b.sequence = n.sequence - 1),
broken AS (SELECT run_id, min(sequence) AS broken_at FROM f WHERE own IS NOT NULL GROUP BY run_id)
SELECT e.run_id, e.sequence, CASE WHEN late THEN 'sequence is already recorded' WHEN own IS NOT NULL THEN own
  WHEN e.sequence > broken_at THEN 'an event before it was rejected' END AS fault
FROM e JOIN f ON f.run_id = e.run_id AND f.sequence = e.sequence LEFT JOIN broken ON broken.run_id = e.run_id""",
    "state_chain": f"""
WITH e AS (
  SELECT l_orderkey AS run_id, l_linenumber - 1 AS sequence,
    CASE WHEN l_linenumber > 1 THEN CASE WHEN l_tax > 0.07 THEN 'CREATED' ELSE {_STATES}[l_linenumber - 1] END END AS from_state,
    CASE WHEN l_returnflag = 'R' AND l_linenumber > 4 THEN 'MODEL_FAILED' ELSE {_STATES}[l_linenumber] END AS to_state FROM lineitem
),
n AS (SELECT run_id, sequence, count(*) AS copies, min((coalesce(from_state, ''), to_state)) AS event FROM e GROUP BY ALL),
p AS (SELECT n.run_id, n.sequence, n.copies, nullif(n.event[1], '') AS from_state, n.event[2] AS to_state, q.event[2] AS previous
  FROM n LEFT JOIN n q ON q.run_id = n.run_id AND q.sequence = n.sequence - 1),
f AS (SELECT run_id, sequence, CASE WHEN copies > 1 THEN 'sequence is repeated'
  WHEN sequence = 0 AND to_state <> 'CREATED' THEN 'history must begin at CREATED'
  WHEN sequence > 0 AND previous IS NULL THEN 'sequence is not contiguous'
  WHEN sequence > 0 AND from_state IS DISTINCT FROM previous THEN 'state chain is discontinuous'
  WHEN sequence > 0 AND NOT (previous || '>' || to_state IN ({_TRANSITIONS}) OR (to_state IN ({_FAILURES}) AND previous NOT IN ({_FAILURES}))) THEN 'invalid transition' END AS fault FROM p)
SELECT run_id, sequence, fault FROM f WHERE fault IS NOT NULL""",
    "event_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events",
    "terminal_state": f"WITH {_EVENTS} SELECT run_id, state, status, event_count, entered_scan, entered_ingest FROM closed",
    "run_manifests": f"""
WITH {_EVENTS}, a AS (SELECT n_chars % 150 AS run_id, count(*) AS c, sum(strlen(text)) AS b FROM documents GROUP BY 1)
SELECT closed.run_id, state, status, event_count, coalesce(c, 0) AS artifact_count, coalesce(b, 0)::BIGINT AS artifact_bytes, status <> 'running' AS done
FROM closed LEFT JOIN a ON a.run_id = closed.run_id""",
    "run_faults": f"""
WITH {_EVENTS}, m AS (SELECT c_custkey AS run_id, c_mktsegment = 'BUILDING' AS scan, CASE WHEN c_acctbal > 0 THEN 'JUDGED' ELSE 'MODEL_FAILED' END AS declared FROM customer),
f AS (SELECT m.run_id, CASE WHEN r.run_id IS NULL THEN 'run has no events' WHEN r.state <> declared THEN 'state is not the final event state'
  WHEN NOT scan AND entered_scan THEN 'document runs cannot enter the scan branch'
  WHEN scan AND entered_ingest THEN 'scan runs cannot enter the ingest branch'
  WHEN last_at > TIMESTAMP '2024-01-29 00:00:00' THEN 'updated before its last event' END AS fault FROM m LEFT JOIN runs r ON r.run_id = m.run_id)
SELECT run_id, fault FROM f WHERE fault IS NOT NULL""",
    "artifact_paths": """
WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '^m\\.', '../') AS relative_path FROM pages)
SELECT relative_path, 'unsafe path' AS fault FROM p WHERE relative_path LIKE '../%'
UNION ALL SELECT relative_path, 'path is not unique' FROM p GROUP BY relative_path HAVING count(*) > 1""",
    "version_conflict": """
SELECT user_id AS run_id, event_type AS name, min(props) AS lowest_version, max(props) AS highest_version FROM events GROUP BY ALL HAVING min(props) <> max(props)""",
    "identity_conflict": """
SELECT p_name AS project_id, min(sha256(p_brand || '/' || p_type)) AS lowest_source_fingerprint, max(sha256(p_brand || '/' || p_type)) AS highest_source_fingerprint
FROM part GROUP BY p_name HAVING count(DISTINCT p_brand || '/' || p_type) > 1""",
    "constraints": """
SELECT 'pk_orders' AS constraint_name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'uq_lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'fk_nation_region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'fk_orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'fk_lineitem_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'fk_documents_labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'ck_lineitem_discount', count(*) FROM lineitem WHERE NOT l_discount <= 0.09
UNION ALL SELECT 'ck_lineitem_quantity', count(*) FROM lineitem WHERE NOT l_quantity > 0
UNION ALL SELECT 'ck_customer_balance', count(*) FROM customer WHERE NOT c_acctbal >= 0""",
    "report_jsonl": f"""
WITH {_AUTOMATIC}
SELECT a.doc_id, '{{"alert":{{"result_index":' || a.doc_id || ',"run_index":0}},"final_decision":{{"auto_dismiss":false,"label":"' || a.label
  || '","requested_label":' || coalesce('"' || h.label || '"', 'null') || '}},"human_label":null,"limitations":[{_LIMITS}],"repository_identity":"'
  || source || '","schema_version":"1.0"}}' AS value FROM automatic a LEFT JOIN human h ON a.doc_id = h.doc_id""",
    "html_escape": f"""
WITH b AS (SELECT 'page-' || page_id AS item, html AS body FROM pages UNION ALL SELECT 'doc-' || doc_id, text FROM documents)
SELECT item, sha256({_ESCAPED}) AS escaped_sha256, length({_ESCAPED}) AS escaped_length FROM b""",
    "report_unknowns": """
WITH w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[a-z]+') AS words FROM documents),
l AS (SELECT doc_id, list_concat(list_concat(words, list_filter(words, lambda x: length(x) > 6)), list_concat([lang], list_concat(list_reverse(words), ['Left out of the context: ' || source || ': ' || lang]))) AS items FROM w)
SELECT doc_id, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), '|') AS unknowns FROM l""",
    "rejects": """
SELECT sha256(text) AS raw_sarif_sha256, 'ingest' AS stage, 'INVALID_SARIF' AS error_code, 'token=[REDACTED] rest' AS detail, 'INVALID_SARIF' AS terminal_state FROM documents
UNION ALL SELECT sha256(doc_id::VARCHAR), 'triage', 'MODEL_RESPONSE_INVALID', 'no secret here', 'MODEL_FAILED' FROM labels""",
}
