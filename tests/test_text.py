from pyspark.sql import functions as F

from tessera.functions import text as T


def test_word_chunks_split_a_text_once(spark):
    words = [f"w{i}" for i in range(1001)]
    rows = [(0, "\n" + " \t".join(words) + " "), (1, " \n"), (2, ""), (3, None), (4, "a b"), (5, "a b c d")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", T.word_chunks(F.col("t"), 2).alias("c"))
    assert {r.k: r.c for r in df.collect()} == {0: [" ".join(words[i : i + 2]) for i in range(0, 1001, 2)], 1: [], 2: [], 3: [], 4: ["a b"], 5: ["a b", "c d"]}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
