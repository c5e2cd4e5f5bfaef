from pyspark.sql import functions as F

from alertweave.llm import shared


def test_likely_first_holds_the_first_and_few_more(spark):
    rows = spark.range(30_000).withColumn("order", shared.seeded(4, F.col("id")))
    for wanted in (1, 500, 20_000):
        let_through = rows.filter(shared.likely_first(F.col("order"), wanted, 30_000))
        first = [row.id for row in rows.orderBy("order", "id").limit(wanted).collect()]
        assert [row.id for row in let_through.orderBy("order", "id").limit(wanted).collect()] == first
        assert let_through.count() <= min(30_000, 5 * wanted + 200)


def test_ranks_within_groups_over_shards(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("s"))
    ranked = shared.rank_within(rows, "g", "s", [F.col("id")], "rank").collect()
    for group in range(3):
        ordered = sorted((row.s, row.id) for row in ranked if row.g == group)
        assert [row.id for row in sorted(ranked, key=lambda r: r["rank"]) if row.g == group] == [i for _, i in ordered]
        assert sorted(row["rank"] for row in ranked if row.g == group) == list(range(len(ordered)))


def test_word_counts(spark):
    texts = [None, "", " \t\n", "a b", "a b", "x\x0by\x0cz\r1"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    assert [row[0] for row in frame.select(shared.word_count(F.col("text"))).collect()] == [0, 0, 0, 2, 1, 4]
