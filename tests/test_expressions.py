import hashlib
import json

from pyspark.sql import functions as F

from alertweave.functions import expressions as E
from alertweave.functions.uri import canonicalize_uri


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("v")).first().v


def test_lines_keep_every_terminator(spark):
    text = "a\nb\r\nc\rd\x0be\x1cf g"
    assert one(spark, text, E.split_lines) == text.splitlines(keepends=True)
    assert one(spark, "x\n", E.split_lines) == ["x\n"]
    assert one(spark, "", E.split_lines) == []


def test_token_estimate(spark):
    assert [one(spark, t, E.token_estimate) for t in ("", "a", "abcd", "abcde", "é" * 4)] == [0, 1, 1, 2, 2]


def test_column_length_counts_utf16_units(spark):
    kind = F.lit("utf16CodeUnits")
    assert one(spark, "a\U0001f600b", lambda t: E.column_length(t, kind)) == 4
    assert one(spark, "a\U0001f600b", lambda t: E.column_length(t, F.lit("unicodeCodePoints"))) == 3


def test_blanking_keeps_length_and_newlines(spark):
    text = 'a // c\n"s\\"x" /* b\n*/ \'q\' """t\n" """ z "open'
    blank = one(spark, text, E.blank_comments_and_literals)
    assert len(blank) == len(text)
    assert blank.split() == ["a", "z"]
    assert blank.count("\n") == text.count("\n")


def test_redaction(spark):
    cases = {
        "Bearer abc.def": "Bearer [REDACTED]",
        "token = x1, next": "token = [REDACTED], next",
        "see https://u:p@host/x": "see https://[REDACTED]@host/x",
        "API-Key:secretvalue;rest": "API-Key:[REDACTED];rest",
        "nothing here": "nothing here",
    }
    for text, wanted in cases.items():
        assert one(spark, text, E.redact) == wanted


def test_html_escape(spark):
    assert one(spark, "<a href='x'>&\"", E.html_escape) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


def test_canonical_json_matches_python(spark):
    text = 'é"\\\n'
    value = {"a": None, "b": [text], "c": 1}
    wanted = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    build = lambda t: E.canonical_json(
        E.struct_of(c=F.lit(1), b=F.array(t), a=F.lit(None).cast("string"))
    )
    assert one(spark, text, build) == wanted
    assert one(spark, text, lambda t: E.sha256(build(t))) == hashlib.sha256(wanted.encode()).hexdigest()


def test_uris(spark):
    rejected = {
        "": "invalid URI",
        "a%zz": "invalid URI",
        "http://x/y": "scheme is not allowed",
        "a?b": "query or fragment is not allowed",
        "//host/x": "remote authority is not allowed",
        "%ff": "not valid UTF-8",
        "a%00b": "control character",
        "../x": "parent traversal",
        "a%2F..%2Fb": "parent traversal",
        "x/a:b": "unsafe colon",
    }
    accepted = {
        "src/A.java": ("posix", False, ["src", "A.java"]),
        "C:\\src\\Win.java": ("windows", True, ["src", "Win.java"]),
        "file:///srv/x": ("posix", True, ["srv", "x"]),
        "%C3%A9+x": ("posix", False, ["é+x"]),
    }
    frame = spark.createDataFrame([(u,) for u in [*rejected, *accepted]], "u string")
    rows = {r.u: r.p for r in frame.select("u", canonicalize_uri(F.col("u")).alias("p")).collect()}
    for uri, reason in rejected.items():
        assert rows[uri].reason == reason, uri
    for uri, wanted in accepted.items():
        got = rows[uri]
        assert got.reason is None
        assert (got.flavor, got.absolute, got.parts) == wanted


def test_lines_are_split_without_taking_each_apart(spark):
    """Lines keep every kind of end, CR LF is one; no pattern is matched against whole lines, which took most of a query."""
    texts = {
        "": [], "a": ["a"], "\n": ["\n"], "\r\n": ["\r\n"], "\n\r": ["\n", "\r"], "a\r\r\n\nb": ["a\r", "\r\n", "\n", "b"],
        "a b \x85": ["a ", "b ", "\x85"], "x\x0by\x0cz\x1c\x1d\x1e\x1f": ["x\x0b", "y\x0c", "z\x1c", "\x1d", "\x1e", "\x1f"],
    }
    frame = spark.createDataFrame([(text, lines) for text, lines in texts.items()] + [(None, None)], "text string, want array<string>")
    got = frame.select("want", E.split_lines(F.col("text")).alias("got"))
    assert all(row.got == row.want for row in got.collect())
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_blanks_of_plain_and_odd_texts_alike(spark):
    """Texts that only have newlines are cut at those, all others by the pattern; both as Python cuts them."""
    texts = ["", "\n", "a", "a\n", "a\n\nb", "\n\na", "a\r\nb\r", "a\x1cb\n", "\u2028", "x\x85\n", None, "é\n\tß"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").select(
        "text",
        E.split_lines(F.col("text")).alias("ended"),
        E.split_lines(F.col("text"), keep_ends=False).alias("bare"),
        E.strip_newline(F.col("text")).alias("cut"),
        (E.has_text(F.col("text")) == (E.strip(F.col("text")) != "")).alias("alike"),
        E.blank_comments_and_literals(F.col("text")).alias("blank"),
    )
    for row in rows.collect():
        if row.text is None:
            assert list(row) == [None] * 6
            continue
        assert row.ended == row.text.splitlines(keepends=True) and row.bare == row.text.splitlines()
        assert row.cut == row.text.rstrip("\r\n") and row.alike and row.blank == row.text


def test_texts_without_marks_are_not_matched(spark):
    """The patterns for odd terminators and for tokens to blank stand behind a test of the whole text."""
    frame = spark.createDataFrame([("a b\nc",)], "text string")
    for column, pattern in ((E.split_lines(F.col("text")), "split(lambda"), (E.blank_comments_and_literals(F.col("text")), "regexp_extract_all(")):
        plan = frame.select(column)._jdf.queryExecution().analyzed().toString()
        assert "CASE WHEN RLIKE(" in plan and plan.index("RLIKE(") < plan.index(pattern)


def test_plain_uris_take_the_short_way_to_the_same(spark):
    """A URI without a scheme, a drive or an escape is cut into parts and is not matched part by part; one with a
    needless escape of the same text takes the long way."""
    texts = ["a", "a/b.txt", "/a//b/./c-d_e", "..", "a/../b", "./", "/", ".", "a/..b", "A/.../b"]
    frame = spark.createDataFrame([(text, text.replace("a", "%61") + "%2F") for text in texts], "short string, long string")
    rows = frame.select(canonicalize_uri(F.col("short")).alias("short"), canonicalize_uri(F.col("long")).alias("long"))
    for row in rows.collect():
        assert row.short == row.long
    plan = frame.select(canonicalize_uri(F.col("short")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("RLIKE(short") < plan.index("regexp_extract(")
    odd = spark.createDataFrame([("//host/x",), ("a:b",), ("",), (None,), ("a\n",)], "u string")
    assert [r.u.reason for r in odd.select(canonicalize_uri(F.col("u")).alias("u")).collect()] == [
        "remote authority is not allowed", "scheme is not allowed", "invalid URI", "invalid URI", None,
    ]
