"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

The features of a text are densities of a fixed and of a learned lexicon, how near lexicon
words stand to a second person, and rates of capitals, punctuation and obfuscation; they are
computed over the whole text in one pass inside the scan's tasks. The learned lexicon, the
trees and the calibration are fitted on at most `FIT_ROWS` labelled rows, those with the
least hash of their id, so that bound is the only one; the rows to score stay where they are
read.

A null text is an empty one and gets a score like any other. Labelled ids that occur several
times with different labels count as toxic. Without labelled rows every score is 0.0, with
labels of one kind only every score is that label. Existing columns of the output's names are
replaced; other columns pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import fresh

# Bound of the sample that the model is fitted on, of which every fourth row calibrates.
FIT_ROWS = 16_384
LEXICON_WORDS = 512
LEXICON_SUPPORT = 6
LEXICON_LOG_ODDS = 1.5
TREES, DEPTH, BINS, STEP = 20, 3, 48, 0.3
NEAR_WORDS = 4
# Part of the score that is the trees' own probability: it orders texts that the
# calibration's steps would tie.
TIE_SHARE = 1e-3

INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb loser losers trash garbage scum filth filthy pathetic "
    "worthless disgusting clown clowns fool fools ugly hate kill die shut vermin pig pigs bastard bastards jerk jerks "
    "crap damn bitch slut whore freak freaks creep retard imbecile dimwit cretin".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu toi vous votre vos du dich dir dein deine euch usted ustedes tú ti tus".split()
)
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = "\"'`.,;:!?()[]{}<>|*#%&$~^_-+=/\\…«»“”„’‘¡¿"
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_MARKS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"[^\w\s]{2,}")
_DIGITS = re.compile(r"\d")
N_FEATURES = 16


def text_features(text: str, learned: dict[str, float]) -> list[float]:
    """The dense features of one text; all are rates or logarithms, so length does not set them."""
    words = [word.strip(_EDGE) for word in text.lower().split()]
    n, chars = max(1, len(words)), max(1, len(text))
    known = learned.keys() | INSULTS
    at = [i for i, word in enumerate(words) if word in known]
    fixed = sum(words[i] in INSULTS for i in at)
    weights = [learned.get(words[i], 0.0) for i in at]
    masked = [word for word in words if word and not word.isalpha() and any(c.isalpha() for c in word)]
    unmasked = sum(word.translate(_UNMASK) in known or "".join(filter(str.isalpha, word)) in known for word in masked)
    near = sum(
        any(word in SECOND_PERSON for word in words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1]) for i in at
    )
    you = sum(word in SECOND_PERSON for word in words)
    return [
        math.log1p(len(words)),
        100 * fixed / n,
        math.log1p(fixed),
        100 * sum(weights) / n,
        max(weights, default=0.0),
        math.log1p(len(at)),
        near / max(1, len(at)),
        100 * you / n,
        len(_CAPITALS.findall(text)) / chars,
        len(_SHOUTED.findall(text)) / n,
        text.count("!") / n,
        text.count("?") / n,
        len(_MARKS.findall(text)) / chars,
        len(_RUNS.findall(text)) / n,
        len(masked) / n + len(_DIGITS.findall(text)) / chars,
        100 * unmasked / n,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float


def _featured(docs: DataFrame, lexicon: dict[str, float], text: str, output: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([text_features(t or "", own) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(output, array_to_vector(features(F.col(text).cast("string"))))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words of rows (text, label) that toxic rows hold far more often than others, with the
    logarithm of the odds. Counts are combined before they are shuffled; at most
    `LEXICON_WORDS` words come to the driver."""
    totals = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    toxic, rows = totals["toxic"] or 0, totals["rows"]
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\s\p{Punct}]+"))
    counts = (
        sample.select(F.explode(words).alias("word"), "label")
        .filter(F.length("word") > 2)
        .groupBy("word")
        .agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all"))
        .filter(F.col("bad") >= LEXICON_SUPPORT)
    )
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log(
        (F.col("all") - F.col("bad") + 0.5) / (rows - toxic + 1.0)
    )
    best = (
        counts.select("word", F.round(odds, 6).alias("weight"))
        .filter(F.col("weight") >= LEXICON_LOG_ODDS)
        .orderBy(F.desc("weight"), "word")
        .limit(LEXICON_WORDS)
    )
    return {row["word"]: row["weight"] for row in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of (doc_id, text) and (doc_id, toxic)."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("double")).alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(fit_rows)
    )
    # At most fit_rows rows of three numbers: the bound that allows the broadcast.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    calibrates = F.pmod("place", F.lit(4)) == 0
    lexicon = learn_lexicon(rows.filter(~calibrates))
    sample = _featured(rows, lexicon, "text", "features").select("features", "label", calibrates.alias("calibrates"))
    sample = sample.persist()
    try:
        fit_part, rest = sample.filter(~F.col("calibrates")), sample.filter("calibrates")
        kinds = {r["label"]: r["count"] for r in fit_part.groupBy("label").count().collect()}
        if len(kinds) < 2:
            return ToxicityModel(lexicon, None, None, float(max(kinds, default=0.0)))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=7).fit(fit_part)
        raw = trees.transform(rest).select(vector_to_array("probability")[1].alias("features"), "label")
        calibration = IsotonicRegression().fit(raw) if raw.take(1) else None
        return ToxicityModel(lexicon, trees, calibration, 0.0)
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "score") -> DataFrame:
    """All rows with a score from 0 to 1 in column `output`."""
    if model.trees is None:
        return docs.withColumn(output, F.lit(model.constant))
    names = [fresh(docs, f"_toxicity_{x}") for x in ("features", "raw", "probability", "prediction", "tree", "step")]
    features, raw, probability, prediction, tree, step = names
    trees = model.trees.copy()
    for setter, name in (
        (trees.setFeaturesCol, features), (trees.setRawPredictionCol, raw),
        (trees.setProbabilityCol, probability), (trees.setPredictionCol, prediction),
    ):
        setter(name)
    scored = trees.transform(_featured(docs, model.lexicon, text, features))
    scored = scored.withColumn(tree, vector_to_array(probability)[1])
    value = F.col(tree)
    if model.calibration is not None:
        steps = model.calibration.copy().setFeaturesCol(tree).setPredictionCol(step)
        scored = steps.transform(scored)
        value = F.col(step) * (1 - TIE_SHARE) + value * TIE_SHARE
    return scored.withColumn(output, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).drop(*names)
