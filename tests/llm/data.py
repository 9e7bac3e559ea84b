"""Small tables that hold what every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, digest string, component_id int, sequence_id string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))


def rows() -> list[tuple]:
    texts = ["a b c d e f", None, "", " ", "a b c d e f", "one", "Ärger  über\tzwei\nZeilen\n\n", LONG, "x" * 3000, "日本語 テキスト", "a b c d e f", "<|endoftext|> </s> <0x41>", None]
    out = [(i, t, "en", "s", 1, True, "d", 1, "q") for i, t in enumerate(texts)]
    return [*out, (None, "no identifier", None, None, None, None, None, None, None), (3, " ", "en", "s", 1, False, "d", 2, "q")]


def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
