from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, most_counted


def test_the_most_counted_are_chosen_whole_steps_first(spark):
    rows = [(i, 1 + i // 100) for i in range(4000)]
    counts = spark.createDataFrame(rows, "token bigint, n bigint").repartition(7)
    scratch = Scratch(spark, "test")
    for most in (50, 1000, 1234, 3999):
        found = {r["token"]: r["n"] for r in most_counted(counts, "n", most, scratch, f"counts_{most}").collect()}
        assert 0.8 * most <= len(found) <= 1.1 * most
        # whatever is counted clearly more often than something chosen is chosen as well
        assert all(i in found for i, n in rows if n > 1.05 * min(found.values()))
    assert most_counted(counts, "n", 4000, scratch, "all").count() == 4000
    assert most_counted(counts.filter(F.lit(False)), "n", 10, scratch, "none").count() == 0
