"""Models loaded in workers, and detectors and analysers over whole tables, on both boards."""

import os

import pytest
from boards import job_html, results_html, store_a, store_b
from pyspark.sql import functions as F
from test_board_a import AS_OF, make_store

from postmill import BoardASearch, BoardBSearch, StopWordDetector
from postmill.functions.enrichment import rule_analyser
from postmill.functions.models import ModelDetector, model_analyser
from postmill.plans.board_a import run_board_a
from postmill.plans.board_b import run_board_b


def counting_detector(folder):
    def load():
        with open(os.path.join(folder, f"load-{os.getpid()}"), "a") as file:
            file.write("x")
        return lambda texts: [("fr" if " le " in f" {t} " else "en", 0.75) for t in texts]

    return ModelDetector(load)


def counting_analyser(folder):
    def load():
        with open(os.path.join(folder, f"load-{os.getpid()}"), "a") as file:
            file.write("x")
        return lambda texts: [
            {"required_studies": "S", "technologies_required": [t[:3]], "experience_years_needed": 2, "salary_offered": 5, "token_cost": len(t)}
            for t in texts
        ]

    return model_analyser(load)


class TableDetector:
    """A detector that joins: texts meet a table of languages by their first word."""

    def __init__(self, table):
        self.table = table

    def detect_rows(self, df, text, output):
        word = F.lower(F.substring_index(F.trim(text), " ", 1))
        joined = df.withColumn("_word", word).join(F.broadcast(self.table.toDF("_word", output)), "_word", "left")
        return joined.withColumn(output, F.coalesce(output, F.lit("unknown"))).drop("_word")


class TableAnalyser:
    def analyse_rows(self, df, description, output):
        return df.repartition(3).withColumn(output, rule_analyser(F.col(description)))


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    detector = counting_detector(str(tmp_path))
    texts = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "le mot").when(F.col("id") % 5 == 0, " ").otherwise("a word").alias("t"))
    for _ in range(3):
        rows = texts.repartition(16).select("id", detector.detect("t").alias("lang"), detector.detect_with_confidence("t").alias("c")).collect()
        assert {(r.lang, r.c.lang, r.c.confidence) for r in rows} == {("fr", "fr", 0.75), ("en", "en", 0.75), ("unknown", "unknown", 0.0)}
    loads = [p.read_text() for p in tmp_path.iterdir()]
    assert loads and set(loads) == {"x"}  # 48 tasks and more, one load a process


@pytest.mark.parametrize("kind", ["model", "table"])
def test_both_boards_take_both_kinds(spark, tmp_path, kind):
    words = spark.createDataFrame([("the", "en"), ("le", "fr")], "word string, lang string")
    detector = TableDetector(words) if kind == "table" else counting_detector(str(tmp_path))
    analyser = TableAnalyser() if kind == "table" else counting_analyser(str(tmp_path))

    search_pages, details = make_store(0, positions=1, pages=3)
    search = BoardASearch(positions="a", desired_language="en", use_analysis=True)
    pages = store_a(spark, search, search_pages, details)
    run = run_board_a(pages, search, AS_OF, detector, analyser=analyser)
    want = run_board_a(pages, search, AS_OF, StopWordDetector(), analyser=rule_analyser)
    places = lambda r: sorted((x.page, x.card, x.job_id) for x in r.postings.collect())
    assert places(run) == places(want) and run.postings.count() > 3

    search_b = BoardBSearch(positions="p", desired_language="en", use_analysis=True)
    result = {
        "displayTitle": "the job", "company": "c", "formattedLocation": "l", "pubDate": 1, "jobkey": "k1", "indeedApplyEnabled": True,
        "jobSeekerMatchSummaryModel": {"sortedMisMatchingEntityDisplayText": ["x"]},
    }
    store = store_b(spark, search_b, {0: results_html([result])}, {"k1": job_html("the engineer has 3 years and a PhD")})
    got = run_board_b(store, search_b, AS_OF, detector, analyser).postings.collect()
    assert [(r.job_id, r.description_lang) for r in got] == [("k1", "en")]
    assert got[0].required_studies == ("PhD" if kind == "table" else "S")
