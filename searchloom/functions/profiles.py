"""How families of embedding models want queries and documents shaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and templates (query, titled document, untitled document).
PROFILES = {
    "qwen3": ("Instruct: {instruction}\nQuery: {query}", "{title}\n\n{content}", "{content}"),
    "nemotron3": ("query: {query}", "passage: {title}\n\n{content}", "passage: {content}"),
    "plain": ("{query}", "{title}\n\n{content}", "{content}"),
}
# What a model's name implies; the first that it contains wins.
NAME_RULES = [("nemotron", "nemotron3"), ("qwen", "qwen3")]
DEFAULT = "qwen3"


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, *templates) for name, templates in PROFILES.items()],
        "profile string, query_template string, doc_template string, doc_template_untitled string",
    )
