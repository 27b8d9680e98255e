"""The gate, the merge and analysers of both kinds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.functions.enrichment import ANALYSIS_TYPE, rule_analyser
from postmill.operators.enrich import FIELDS_A, FIELDS_B, analysed_rows, enrich, enrich_gate
from postmill.operators.technologies import technologies_in


@pytest.fixture
def postings(spark):
    rows = [("1", "EN", "5 years, PhD, Java, salary 30k"), ("2", "fr", "9 years, PhD"), ("3", None, "8 years"), ("4", "en", None)]
    df = spark.createDataFrame(rows, "job_id string, description_lang string, description string")
    return df.withColumns({
        "required_studies": F.lit("old"), "technologies_required": F.array(F.lit("old")),
        "experience_years_needed": F.lit(-1), "salary_offered": F.lit(-1),
    })


def test_rules_behind_the_gate(spark, postings):
    gate = enrich_gate("en", True, F.col("description_lang"))
    rows = {r.job_id: r for r in enrich(postings, rule_analyser, gate, FIELDS_A).collect()}
    assert (rows["1"].required_studies, rows["1"].technologies_required, rows["1"].experience_years_needed,
            rows["1"].salary_offered, rows["1"].token_cost) == ("PhD", ["Java"], 5, 30000, 0)
    for key in ("2", "3"):
        assert (rows[key].required_studies, rows[key].salary_offered) == ("old", -1)
    only_two = {r.job_id: r for r in enrich(postings, rule_analyser, gate, FIELDS_B).collect()}["1"]
    assert (only_two.technologies_required, only_two.salary_offered) == (["old"], -1)


def test_function_sees_only_gated_rows(spark, postings):
    @F.pandas_udf(ANALYSIS_TYPE)
    def analyser(texts: pd.Series) -> pd.DataFrame:
        if texts.fillna("").str.contains("9 years").any():
            raise ValueError("a row outside the gate")
        n = len(texts)
        return pd.DataFrame({
            "required_studies": ["s"] * n, "technologies_required": [["t"]] * n, "experience_years_needed": [1] * n,
            "salary_offered": [2] * n, "token_cost": [10] * n,
        })

    gate = enrich_gate("en", True, F.col("description_lang"))
    rows = {r.job_id: r for r in enrich(postings, analyser, gate, FIELDS_A).collect()}
    assert [rows[k].token_cost for k in "1234"] == [10, 0, 0, 10]
    assert [rows[k].required_studies for k in "1234"] == ["s", "old", "old", "s"]


def test_gate_settings(spark, postings):
    assert postings.filter(enrich_gate("", False, F.col("description_lang"))).count() == 0
    with pytest.raises(ValueError):
        enrich_gate("", True, F.col("description_lang"))


def test_postings_without_a_usable_answer(spark):
    rows = spark.createDataFrame(
        [("1", "A degree in law", "en"), ("2", "broken", "en"), ("3", "broken", "fr")],
        "job_id string, description string, description_lang string",
    ).withColumns({
        "required_studies": F.lit(""), "technologies_required": F.array().cast("array<string>"),
        "experience_years_needed": F.lit(0), "salary_offered": F.lit(0),
    })

    def analyser(text):
        return F.when(text != "broken", rule_analyser(text))

    good, bad = analysed_rows(rows, analyser, enrich_gate("en", True, F.col("description_lang")), FIELDS_A)
    assert sorted(r.job_id for r in good.collect()) == ["1", "3"]
    assert [(r.job_id, r.reason) for r in bad.collect()] == [("2", "no usable analysis")]


@pytest.mark.parametrize("limit_bytes", [10**9, 0])
def test_a_dictionary_of_any_size_is_a_table(spark, limit_bytes):
    many = [(f"Tool{i} Kit",) for i in range(2000)] + [(f"Lib{i}",) for i in range(2000)]
    names = spark.createDataFrame([("Apache Spark",), ("spark",), ("C++",), (".NET Core",), ("C",), ("++",), (None,), *many], "name string")
    rows = [
        (1, "We use apache  SPARK, c++ and .net core."), (2, "Tool7 kit, lib9; tool8, kit"), (3, None), (4, ""), (5, "nothing here"),
        (5, "nothing here"), (6, "spark " * 5000 + "apache"),
    ]
    df = spark.createDataFrame(rows, "id int, description string").withColumn("technologies_required", F.lit("old"))
    got = technologies_in(df, names, limit_bytes=limit_bytes).collect()
    want = {1: [".NET Core", "Apache Spark", "C++", "spark"], 2: ["Lib9", "Tool7 Kit", "Tool8 Kit"], 3: [], 4: [], 5: [], 6: ["spark"]}
    assert len(got) == 7 and {r.id: r.technologies_required for r in got} == want
    assert {tuple(r.technologies_required) for r in technologies_in(df, names.limit(0)).collect()} == {()}
