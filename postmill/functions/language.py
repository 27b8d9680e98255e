"""Language identification, row by row.

A detector is anything with `detect(column) -> column`. Two are built in: counts of
frequent words as a plain expression, and a character-trigram profile learned by a Spark
aggregation (see operators/language.py). Both read a text where it lies: no explode, join
or shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postmill.functions.binding import bind
from postmill.functions.trigrams import BUCKETS, trigram_buckets

UNKNOWN = "unknown"

STOP_WORDS = {
    "de": "der die das und ist nicht mit für auf ein eine den von zu im sich auch wird sind bei".split(),
    "en": "the of and to in is that it for was with as on by this are be at from or".split(),
    "es": "el los las del una por con para que es en se al como más pero su y no muy".split(),
    "fr": "le la les des un une et est que qui dans pour sur pas avec du au ce sont elle".split(),
}

# Weights are thousandths of a natural logarithm, so sums are exact.
SCALE = 1000
MAX_LANGUAGES = 256


def _best(scored: Column) -> Column:
    """Highest (score, lang); ties go to the later name."""
    return F.array_max(scored)


class StopWordDetector:
    """Counts of frequent words. Texts without any of them are 'unknown'."""

    def __init__(self, words: dict[str, list[str]] | None = None):
        self.words = words or STOP_WORDS

    def _scores(self, text: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))

        def hits(found: Column, words: list[str]) -> Column:
            return F.size(F.filter(found, lambda token: token.isin(words)))

        def count_all(found: Column) -> Column:
            return F.array(*[
                F.struct(hits(found, words).alias("score"), F.lit(lang).alias("lang"))
                for lang, words in sorted(self.words.items())
            ])

        return bind(tokens, count_all)

    def detect(self, text: Column) -> Column:
        best = _best(self._scores(text))
        return bind(best, lambda b: F.when(b["score"] > 0, b["lang"]).otherwise(F.lit(UNKNOWN)))

    def detect_with_confidence(self, text: Column) -> Column:
        """struct(lang, confidence): the share of all hits the language has."""

        def judge(scored: Column) -> Column:
            best = _best(scored)
            total = F.aggregate(scored, F.lit(0), lambda acc, s: acc + s["score"])
            return F.struct(
                F.when(best["score"] > 0, best["lang"]).otherwise(F.lit(UNKNOWN)).alias("lang"),
                F.when(total > 0, best["score"] / total).otherwise(F.lit(0.0)).alias("confidence"),
            )

        return bind(self._scores(text), judge)


class ProfileDetector:
    """Naive Bayes over hashed trigrams; every text that is not blank gets a label.

    The weights are BUCKETS integers per language, whatever amount of text they were
    learned from, so what travels to the workers has a fixed bound. Texts are scored in
    Arrow batches where they lie.
    """

    def __init__(self, weights: dict[str, list[int]], priors: dict[str, int] | None = None):
        self.languages = sorted(weights)
        self.weights = np.array([weights[lang] for lang in self.languages], dtype=np.int64)
        self.priors = np.array([(priors or {}).get(lang, 0) for lang in self.languages], dtype=np.int64)

    @classmethod
    def from_table(cls, profile: DataFrame) -> ProfileDetector:
        """Take in a profile table; its size is bounded and checked."""
        bound = MAX_LANGUAGES * (BUCKETS + 2)
        rows = profile.select("lang", "kind", "bucket", "weight").limit(bound + 1).toPandas()
        if len(rows) > bound:
            raise ValueError(f"a profile holds at most {MAX_LANGUAGES} languages")
        if rows.empty:
            raise ValueError("the profile is empty")
        unseen = rows[rows.kind == "unseen"].set_index("lang").weight
        weights = {}
        for lang, grams in rows[rows.kind == "gram"].groupby("lang"):
            weights[lang] = np.full(BUCKETS, unseen[lang])
            weights[lang][grams.bucket] = grams.weight
        return cls(weights, rows[rows.kind == "prior"].set_index("lang").weight.to_dict())

    @classmethod
    def load(cls, spark, path: str) -> ProfileDetector:
        try:
            return cls.from_table(spark.read.parquet(path))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"no language profile at {path}") from error
            raise

    def _judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not text.strip():
            return UNKNOWN, 0.0
        scores = self.priors + self.weights[:, trigram_buckets(text)].sum(axis=1)
        best = scores.max()
        winner = len(scores) - 1 - int(np.argmax(scores[::-1]))
        return self.languages[winner], float(1 / np.exp((scores - best) / SCALE).sum())

    def _judged(self, texts: pa.Array) -> pa.StructArray:
        """(lang, confidence) of each text; texts become Python objects one by one."""
        langs, shares = [], []
        for text in texts:
            lang, share = self._judge(text.as_py())
            langs.append(lang)
            shares.append(share)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["lang", "confidence"])

    def detect(self, text: Column) -> Column:
        judged = self._judged

        @F.arrow_udf("string")
        def detect(texts: pa.Array) -> pa.Array:
            return judged(texts).field("lang")

        return detect(text)

    def detect_with_confidence(self, text: Column) -> Column:
        """struct(lang, confidence): the posterior of the best language."""
        judged = self._judged

        @F.arrow_udf("lang string, confidence double")
        def detect(texts: pa.Array) -> pa.Array:
            return judged(texts)

        return detect(text)
