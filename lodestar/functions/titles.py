"""Candidates for a title in a longer text, as a table function: one row to many, in a lateral join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Neighbouring words of the longest candidate.
WORDS = 3


@udtf(returnType="place int, candidate string")
class TitleCandidates:
    """All runs of up to so many neighbouring words of a text, in lower case: longer ones first at each word, each candidate once.
    A null or empty text has none."""

    def eval(self, text: str, words: int):
        parts = (text or "").lower().split()
        seen = set()
        for i in range(len(parts)):
            for n in range(min(words, len(parts) - i), 0, -1):
                candidate = " ".join(parts[i : i + n])
                if candidate not in seen:
                    seen.add(candidate)
                    yield len(seen), candidate


def candidates(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``key``, ``place`` (from 1) and ``candidate`` for each row of ``df``; ``catalog.fuzzy_titles`` takes them as titles."""
    spark: SparkSession = df.sparkSession
    spark.udtf.register("title_candidates", TitleCandidates)
    return spark.sql(f"select t.key as `{key}`, c.place, c.candidate from {{rows}} t, lateral title_candidates(t.text, {int(words)}) c", rows=df.selectExpr(f"`{key}` as key", f"`{text}` as text"))
