"""DuckDB SQL of the queries that SQL can express.

The others rest on hashes that DuckDB lacks, on dynamic programming, or on trained models; the tests
hold those against plain code.
"""

from __future__ import annotations

from alertweave.llm import decontamination, license_scan, quality_rules
from alertweave.llm.shared import UPPER

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_BLANK = r"[\x20\x09-\x0D]"


def _licenses() -> str:
    word = license_scan.WORD
    templates = ", ".join(f"({at}, '{label}', '{text}')" for at, (label, text) in enumerate(license_scan.TEMPLATES))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        here = " AND ".join(f"words[i + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split(" ")))
        places.append(
            f"SELECT doc_id, i AS start, '{label}' AS label FROM"
            f" (SELECT doc_id, words, unnest(range(len(words))) AS i FROM d) WHERE {here}"
        )
    union = " UNION ALL ".join(places)
    return f"""
WITH d AS (SELECT doc_id, {_LOWER} AS lower_text, regexp_extract_all({_LOWER}, '{word}') AS words FROM documents),
places AS ({union}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
),
templates AS (
  SELECT number, label, list_distinct(regexp_extract_all(lower(notice), '{word}')) AS wanted,
    ceil({license_scan.REACH} * len(regexp_extract_all(lower(notice), '{word}')))::BIGINT AS reach
  FROM (VALUES {templates}) AS t(number, label, notice)
),
held AS (
  SELECT doc_id, label, wanted, reach, words FROM d, templates
  WHERE len(list_intersect(list_distinct(words), wanted)) >= ceil({license_scan.THRESHOLD} * len(wanted) - 1e-9)
),
blocks AS (SELECT doc_id, label, wanted, list_intersect(list_distinct(words[i + 1 : i + reach]), wanted) AS said
  FROM (SELECT *, unnest(range(len(words))) AS i FROM held)),
met AS (
  SELECT doc_id, label, len(said) / len(wanted) AS share FROM blocks
  WHERE len(said) >= ceil({license_scan.THRESHOLD} * len(wanted) - 1e-9)
),
shares AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN shares s ON s.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id"""


def _quality() -> str:
    rules = quality_rules.RULES
    grid = ", ".join(
        f"({at}, {level}, {cut!r}::DOUBLE)"
        for at, rule in enumerate(rules)
        for level, cut in enumerate(quality_rules.grid(rule))
    )
    values = ["n_symbols / n", "capitals / chars", "marks / chars", "n_dup_lines / greatest(n_lines, 1)"]
    values += ["n_repeat_words / n", "digits / chars", "word_chars / n"]
    measures = " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, {at} AS rule, ({value})::DOUBLE AS value FROM counted"
        for at, value in enumerate(values)
    )
    risk = quality_rules.RISK / len(rules)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
),
marked AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(3) AS r(k) WHERE times > 1 GROUP BY doc_id
),
plain AS (
  SELECT d.doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(text, '[[:punct:]]')) AS marks,
    len(regexp_extract_all(text, '[0-9]')) AS digits
  FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id
),
counted AS (
  SELECT *, greatest(n_words, 1) AS n, greatest(word_chars, 1) AS chars,
    n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM plain
),
measures AS ({measures}),
known AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, level, cutoff)),
rejected AS (
  SELECT stratum, m.rule, level, any_value(cutoff) AS cutoff, count(*) FILTER (good) AS n_good,
    count(*) FILTER (good AND value > cutoff) AS lost, count(*) FILTER (NOT good AND value > cutoff) AS caught
  FROM measures m JOIN known k ON k.doc_id = m.doc_id JOIN grid g ON g.rule = m.rule
  WHERE NOT base_failed GROUP BY stratum, m.rule, level
),
tested AS (
  SELECT *, lost < n_good * {risk!r} AND list_sum(list_transform(range(lost + 1), lambda j:
      exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({risk!r}) + (n_good - j) * ln(1 - {risk!r})))
    ) <= {quality_rules.ERROR} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM rejected)) AS refuted,
    caught - {quality_rules.CLEAN_WEIGHT} * lost AS gain FROM rejected
),
certified AS (
  SELECT *, bool_and(refuted) OVER (PARTITION BY stratum, rule ORDER BY level) AS sound FROM tested
),
chosen AS (
  SELECT stratum, rule, arg_max(cutoff, (gain, -level)) AS cutoff FROM certified
  WHERE sound AND caught > 0 AND gain > 0 GROUP BY stratum, rule
),
beyond AS (
  SELECT DISTINCT doc_id FROM measures m JOIN chosen c ON c.stratum = m.stratum AND c.rule = m.rule WHERE value > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM counted"""


def _decontamination() -> str:
    word, window = license_scan.WORD, decontamination.WINDOW
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{word}') AS words FROM documents),
i AS (SELECT item_id, words, least(len(words), {window}) AS width
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{word}') AS words FROM benchmark)),
windows AS (
  SELECT DISTINCT item_id, width, array_to_string(words[start : start + width - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS start FROM i WHERE width > 0)
),
places AS (
  SELECT doc_id, start, width, array_to_string(words[start : start + width - 1], ' ') AS said
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS start
    FROM d, (SELECT DISTINCT width FROM windows) WHERE len(words) >= width)
),
found AS (SELECT doc_id, start, p.width, item_id FROM places p JOIN windows w ON w.said = p.said AND w.width = p.width),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + width)) AS place FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {"op5_quality_rules": _quality(), "op10_license_scan": _licenses(), "op11_decontamination": _decontamination()}
