"""The driver's tables in the shapes the operators read.

Documents are source files of the repository their ``source`` names, and each also gives one
SARIF document with a result per line. Everything is derived in the row, one file at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import record, sha256, strip_newline
from alertweave.sources.source_files import file_lines, text_sources


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, spread over the cores when their files give fewer splits than that.

    Large inputs arrive in enough splits and are left alone; a small one in a single row group
    would otherwise put all parsing into one task.
    """
    frame = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def document_path() -> Column:
    return F.format_string("docs/%d.txt", "doc_id")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files."""
    return text_sources(
        documents(spark, folder).select(
            F.col("source").alias("repository_identity"), document_path().alias("path"), "text"
        )
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document line, without its line end: ``doc_id, source, lang, line_no, line``."""
    return (
        documents(spark, folder)
        .select("doc_id", "source", "lang", F.posexplode(file_lines()).alias("at", "raw"))
        .select(
            "doc_id",
            "source",
            "lang",
            (F.col("at") + 1).alias("line_no"),
            strip_newline(F.col("raw")).alias("line"),
        )
    )


def rule_of_line(line: Column) -> Column:
    """A lexical rule per line, so that all families appear."""
    return (
        F.when(line.rlike("token|secret|password"), "java/database-resource-leak")
        .when(line.contains(","), "java/unreleased-lock")
        .when(line.contains(" the ") | line.contains(" la "), "java/input-resource-leak")
        .otherwise("js/reflected-xss")
    )


def sarif_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One SARIF document per source document, as bytes with hash, repository and commit."""
    kinds = list(fixed.QUERY_FAMILIES) + ["js/reflected-xss"]
    rules = F.array(
        *[
            record(
                id=F.lit(name),
                defaultConfiguration=record(level=F.lit("error" if "js/" in name else "warning")),
                properties=record(
                    tags=F.array(
                        F.lit("external/cwe/cwe-079" if "js/" in name else "external/cwe/cwe-0772"),
                        F.lit("security"),
                    )
                ),
            )
            for name in kinds
        ]
    )
    name = F.format_string("%d.txt", "doc_id")

    def location(line_no: Column, end_column: Column) -> Column:
        return record(
            physicalLocation=record(
                artifactLocation=record(uri=name, uriBaseId=F.lit("DOCS"), index=F.lit(0)),
                region=record(startLine=line_no, startColumn=F.lit(1), endColumn=end_column),
            )
        )

    def result(line: Column, at: Column) -> Column:
        width = F.length(line) + 1
        before = F.get("lines", at - 1)
        steps = F.when(
            at > 0,
            F.array(
                record(location=location(at, F.length(before) + 1)),
                record(location=location(at + 1, width)),
            ),
        ).otherwise(F.array(record(location=location(at + 1, width))))
        return record(
            ruleId=rule_of_line(line),
            message=record(text=F.format_string("line %d", at + 1)),
            locations=F.array(location(at + 1, width)),
            codeFlows=F.array(record(threadFlows=F.array(record(locations=steps)))),
        )

    body = record(
        version=F.lit("2.1.0"),
        runs=F.array(
            record(
                columnKind=F.lit("unicodeCodePoints"),
                tool=record(driver=record(name=F.lit("scanner"), rules=rules)),
                artifacts=F.array(
                    record(
                        location=record(uri=name, uriBaseId=F.lit("DOCS")),
                        hashes=F.create_map(F.lit("sha-256"), sha256(F.col("text"))),
                    )
                ),
                originalUriBaseIds=F.create_map(F.lit("DOCS"), record(uri=F.lit("docs/"))),
                results=F.transform("lines", result),
            )
        ),
    )
    return (
        documents(spark, folder)
        .select(
            "doc_id",
            F.col("source").alias("repository_identity"),
            "text",
            F.transform(file_lines(), strip_newline).alias("lines"),
        )
        .select(
            "repository_identity",
            F.sha1(F.col("doc_id").cast("string")).alias("commit_sha"),
            F.to_json(body).cast("binary").alias("content"),
        )
        .withColumn("raw_sarif_sha256", F.sha2("content", 256))
    )


def sarif_references(spark: SparkSession, folder: str) -> DataFrame:
    """One SARIF document per source document with a result, a rule and an artifact per line.

    Results name their rules by id, by index and by both, and their places in four ways: by uri, by
    artifact index, by a related location, and by a related location that has an artifact index.
    """
    size = F.size("lines")

    def rule(line: Column, at: Column) -> Column:
        return record(
            id=F.format_string("r%d", size - at),
            name=F.concat(F.lit("n"), at.cast("string")),
            defaultConfiguration=record(level=F.when(at % 2 == 0, "error").otherwise("warning")),
        )

    def artifact(line: Column, at: Column) -> Column:
        return record(location=record(uri=F.format_string("art-%d.txt", at), uriBaseId=F.lit("DOCS")))

    def place(at: Column) -> Column:
        """The uri, the base and the artifact index, each where the result's way has one."""
        way, sub = at % 4, F.format_string("sub/%d.txt", at)
        return record(
            artifactLocation=record(
                uri=F.when(way.isin(0, 2), sub),
                uriBaseId=F.when(way == 0, "DOCS").when(way == 3, "DEEP"),
                index=F.when(way.isin(1, 3), size - 1 - at),
            ),
            region=record(startLine=at + 1),
        )

    def result(line: Column, at: Column) -> Column:
        own, chosen = at % 4 < 2, (at * 7) % size
        return record(
            ruleId=F.when(at % 3 != 1, F.format_string("r%d", size - chosen)),
            ruleIndex=F.when(at % 3 != 0, chosen),
            message=record(text=F.format_string("doc %d", "doc_id")),
            locations=F.array(record(id=F.lit(5), physicalLocation=F.when(own, place(at)))),
            relatedLocations=F.when(~own, F.array(record(id=F.lit(5), physicalLocation=place(at)))),
        )

    body = record(
        version=F.lit("2.1.0"),
        runs=F.array(
            record(
                columnKind=F.lit("unicodeCodePoints"),
                tool=record(driver=record(name=F.lit("scanner"), rules=F.transform("lines", rule))),
                artifacts=F.transform("lines", artifact),
                originalUriBaseIds=F.create_map(
                    F.lit("DOCS"), record(uri=F.lit("docs/"), uriBaseId=F.lit(None).cast("string")),
                    F.lit("DEEP"), record(uri=F.lit("deep/"), uriBaseId=F.lit("DOCS")),
                ),
                results=F.transform("lines", result),
            )
        ),
    )
    return (
        documents(spark, folder)
        .select(
            "doc_id",
            F.col("source").alias("repository_identity"),
            F.transform(file_lines(), strip_newline).alias("lines"),
        )
        .select(
            "repository_identity",
            F.sha1(F.col("doc_id").cast("string")).alias("commit_sha"),
            F.to_json(body).cast("binary").alias("content"),
        )
        .withColumn("raw_sarif_sha256", F.sha2("content", 256))
    )


def first_word(line: Column) -> Column:
    word = F.lower(F.regexp_extract(line, "[A-Za-z]+", 0))
    return F.when(word == "", "w").otherwise(word)


def code_line(line: Column, line_no: Column) -> Column:
    """A line of brace code that keeps the shape of the prose line."""
    word = first_word(line)
    return (
        F.when(line.rlike(",.*,"), F.concat(F.lit("void "), word, F.lit("(int a) {")))
        .when(
            line.contains(","),
            F.concat(F.lit("if ("), word, F.lit(" > 0) { validate("), word, F.lit("); return; }")),
        )
        .when(
            line.contains(" the ") | line.contains(" la "),
            F.lit("x.lock(); y = new Foo(); // if (no) { close("),
        )
        .when(line.endswith("."), F.lit("} finally { z.close(); }"))
        .otherwise(F.concat(F.lit("call"), line_no.cast("string"), F.lit("("), word, F.lit(");")))
    )


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents turned into brace code, line by line."""
    code = F.array_join(
        F.transform(
            F.transform(file_lines(), strip_newline), lambda line, at: code_line(line, at + 1)
        ),
        "\n",
    )
    return text_sources(
        documents(spark, folder).select(
            F.col("source").alias("repository_identity"), document_path().alias("path"), code.alias("text")
        )
    )


def automatic_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label per document from its length and language; the automatic side of evaluation."""
    return table(spark, folder, "documents").select(
        "doc_id",
        "source",
        F.when(F.col("n_chars") > 2000, "TP").when(F.col("lang") == "en", "FP").otherwise("NMC").alias("label"),
    )


def human_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "TP").when(F.col("quality") == 1, "FP").otherwise("NMC").alias("label"),
    )
