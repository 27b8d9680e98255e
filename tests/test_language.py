"""Language detectors."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill import ProfileDetector, StopWordDetector
from postmill.functions.trigrams import BUCKETS
from postmill.operators.language import _count_trigrams, language_filter, language_profile

EN = "We keep the tools in the shed behind the house, and nobody has asked for them since last spring."
FR = "Nous avons rangé les outils derrière la maison, et personne ne les a demandés depuis le printemps."

# Public-domain openings: Austen, Melville; Hugo, Flaubert; Cervantes; Kafka, Goethe.
SAMPLES = [
    ("en", "It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a"
           " wife. However little known the feelings or views of such a man may be on his first entering a neighbourhood,"
           " this truth is so well fixed in the minds of the surrounding families"),
    ("en", "Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, and nothing"
           " particular to interest me on shore, I thought I would sail about a little and see the watery part of the world."),
    ("fr", "Nous étions à l'étude, quand le proviseur entra, suivi d'un nouveau habillé en bourgeois et d'un garçon de classe"
           " qui portait un grand pupitre. Ceux qui dormaient se réveillèrent, et chacun se leva comme surpris dans son travail."),
    ("fr", "En 1815, M. Charles-François-Bienvenu Myriel était évêque de Digne. C'était un vieillard d'environ soixante-quinze"
           " ans; il occupait le siège de Digne depuis 1806, dans une petite ville des Alpes"),
    ("es", "En un lugar de la Mancha, de cuyo nombre no quiero acordarme, no ha mucho tiempo que vivía un hidalgo de los de"
           " lanza en astillero, adarga antigua, rocín flaco y galgo corredor. Una olla de algo más vaca que carnero"),
    ("de", "Als Gregor Samsa eines Morgens aus unruhigen Träumen erwachte, fand er sich in seinem Bett zu einem ungeheueren"
           " Ungeziefer verwandelt. Er lag auf seinem panzerartig harten Rücken und sah, wenn er den Kopf ein wenig hob"),
]


@pytest.fixture(scope="module")
def profile(spark):
    return language_profile(spark.createDataFrame(SAMPLES, "lang string, text string")).cache()


def judged(spark, detector, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = df.select("n", detector.detect(F.col("t")).alias("lang"), detector.detect_with_confidence(F.col("t")).alias("c"))
    return [(r.lang, r.c.lang, r.c.confidence) for r in found.orderBy("n").collect()]


def test_profile_detector(spark, profile):
    got = judged(spark, ProfileDetector.from_table(profile), ["The weather was fair", "", "   ", EN, FR, "12 ??", None])
    assert [g[0] for g in got] == ["en", "unknown", "unknown", "en", "fr", "fr", "unknown"]
    assert [g[1] for g in got] == [g[0] for g in got]
    assert [got[i][2] for i in (1, 2, 6)] == [0.0] * 3
    assert got[3][2] >= 0.8 and got[4][2] >= 0.8


def test_profile_round_trip_and_missing_profile(spark, profile, tmp_path):
    profile.write.parquet(str(tmp_path / "profile"))
    loaded = ProfileDetector.load(spark, str(tmp_path / "profile"))
    assert judged(spark, loaded, [FR])[0][0] == "fr"
    with pytest.raises(FileNotFoundError):
        ProfileDetector.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        ProfileDetector.from_table(profile.limit(0))


def test_stop_word_detector(spark):
    got = judged(spark, StopWordDetector(), ["the end of the day", "le chat dans les rues", "", "xyz", "THE le", None])
    assert [g[0] for g in got[:5]] == ["en", "fr", "unknown", "unknown", "fr"]
    assert [g[1] for g in got[:5]] == [g[0] for g in got[:5]]
    assert [g[2] for g in got[:5]] == [1.0, 1.0, 0.0, 0.0, 0.5]


def test_user_function_as_detector(spark):
    class Custom:
        def detect(self, text):
            @F.pandas_udf("string")
            def shout(texts: pd.Series) -> pd.Series:
                return texts.str.upper()

            return shout(text)

    df = spark.createDataFrame([("fr",), ("en",)], "t string").withColumn("l", Custom().detect(F.col("t")))
    assert [r.t for r in language_filter(df, "l", "Fr").collect()] == ["fr"]
    assert language_filter(df, "l", "").count() == 0


def traced(function):
    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_texts_of_a_batch_are_taken_one_by_one():
    """What counting and judging hold beside their batch does not grow with the batch."""
    detector = ProfileDetector({"a": [0] * BUCKETS, "b": [1] * BUCKETS})
    held = {}
    for n in (100, 1000):
        texts = pa.array([f"word{i} " * 800 for i in range(n - 1)] + [None])
        batch = pa.RecordBatch.from_arrays([texts, pa.array(["a"] * n)], ["text", "lang"])
        counted = []
        held[n] = traced(lambda: counted.extend(_count_trigrams(iter([batch])))), traced(lambda: detector._judged(texts))
        assert [c.column("lang")[0].as_py() for c in counted] == ["a"]
        assert detector._judged(texts).to_pylist()[-1] == {"lang": "unknown", "confidence": 0.0}
    text_bytes = 900 * 800 * 6
    assert all(large - small < text_bytes / 4 for small, large in zip(held[100], held[1000], strict=True))
