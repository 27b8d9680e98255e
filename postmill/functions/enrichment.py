"""Attributes of a posting out of its description or out of an analyser's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.binding import bind

ANALYSIS_TYPE = (
    "struct<required_studies:string,technologies_required:array<string>,"
    "experience_years_needed:int,salary_offered:int,token_cost:int>"
)

# Technology names the built-in rules know, spelled as they are reported.
TECHNOLOGIES = [
    "Angular", "Ansible", "AWS", "Azure", "Bash", "C", "C#", "C++", "Cassandra", "CSS", "Django",
    "Docker", "Elasticsearch", "Flask", "GCP", "Git", "Go", "GraphQL", "Hadoop", "HTML", "Java",
    "JavaScript", "Jenkins", "Kafka", "Kotlin", "Kubernetes", "Linux", "MongoDB", "MySQL",
    ".NET", "Node.js", "NumPy", "Oracle", "pandas", "Perl", "PHP", "PostgreSQL", "Python",
    "PyTorch", "R", "React", "Redis", "Ruby", "Rust", "Scala", "Spark", "Spring", "SQL", "Swift",
    "TensorFlow", "Terraform", "TypeScript", "Vue",
]

_YEARS = r"(?i)(?<![\d.,])(\d{1,2})\s*(?:\+|(?:-|–|to)\s*\d{1,2})?\s*(?:years?|yrs?)\b"
_SALARY = (
    r"(?i)(?:salary|salaire|compensation|pay)\D{0,40}?(\d{1,3}(?:[ ,.]\d{3})+|\d+)\s*(k\b)?"
)
_STUDIES = [
    ("PhD", r"(?i)\b(?:ph\.?\s?d|doctorate|doctoral)\b"),
    ("Master", r"(?i)\b(?:master(?:'s|s)?|m\.?sc)\b"),
    ("Bachelor", r"(?i)\b(?:bachelor(?:'s|s)?|b\.?sc|licence)\b"),
]


def request_text(description: Column, technologies: bool = True, salary: bool = True) -> Column:
    """The instruction and the description, for an external analyser."""
    instruction = fixed.REQUEST_BASE
    instruction += fixed.REQUEST_TECHNOLOGIES if technologies else ""
    instruction += fixed.REQUEST_SALARY if salary else ""
    instruction += fixed.REQUEST_DEFAULTS
    instruction += fixed.REQUEST_DEFAULT_TECHNOLOGIES if technologies else ""
    instruction += fixed.REQUEST_DEFAULT_SALARY if salary else ""
    return F.concat_ws("\n", F.lit(instruction), description)


def parse_response(response: Column, token_cost: Column, technologies: bool = True, salary: bool = True) -> Column:
    """An analyser's JSON answer as a struct; null when a wanted field is missing.

    A field that was not asked for takes its empty value, whatever the answer says.
    """
    answer = F.from_json(
        response,
        "required_studies string, technologies_required array<string>,"
        " experience_years_needed int, salary_offered int",
    )
    wanted_techs = answer["technologies_required"] if technologies else F.array().cast("array<string>")
    wanted_salary = answer["salary_offered"] if salary else F.lit(0)
    complete = (
        answer["required_studies"].isNotNull()
        & answer["experience_years_needed"].isNotNull()
        & wanted_techs.isNotNull()
        & wanted_salary.isNotNull()
    )
    return F.when(
        complete,
        F.struct(
            answer["required_studies"].alias("required_studies"),
            wanted_techs.alias("technologies_required"),
            answer["experience_years_needed"].alias("experience_years_needed"),
            wanted_salary.alias("salary_offered"),
            token_cost.cast("int").alias("token_cost"),
        ),
    )


def reasoning_strip(output: Column) -> Column:
    """Technologies out of free model output; an empty array when it cannot be read.

    Drops the reasoning block and code fences, halves doubled braces and reads the
    widest braced part. Halving also breaks nested objects; those give an empty array.
    """
    text = F.regexp_replace(output, r"(?Us)<think>.*?</think>\s*", "")
    text = F.regexp_replace(text, r"(?Us)\A```json\s*|\s*```\n?\z", "")
    text = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.try_variant_get(F.try_parse_json(body), "$.technologies", "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def years_of_experience(description: Column) -> Column:
    """The smallest stated number of years, 0 when none is stated."""
    years = F.regexp_extract_all(description, F.lit(_YEARS), F.lit(1))
    return F.coalesce(F.array_min(F.transform(years, lambda y: y.cast("int"))), F.lit(0))


def required_studies(description: Column) -> Column:
    """The highest degree named."""
    found = F.lit(fixed.STUDIES_NOT_SPECIFIED)
    for name, pattern in reversed(_STUDIES):
        found = F.when(description.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def annual_salary(description: Column) -> Column:
    """The first amount after a salary word; the lower bound of a range; 0 when none."""
    digits = F.regexp_replace(F.regexp_extract(description, _SALARY, 1), r"\D", "").try_cast("long")
    thousands = F.regexp_extract(description, _SALARY, 2) != ""
    amount = digits * F.when(thousands, 1000).otherwise(1)
    return F.coalesce(F.when(amount <= 2_147_483_647, amount), F.lit(0)).cast("int")


def words_of(text: Column) -> Column:
    """Lower-case words as dictionary names are made of: 'c++', '.net', 'node.js'."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(r"(\.?[\p{L}\p{N}](?:[\p{L}\p{N}+#]|\.(?=[\p{L}\p{N}]))*)"), F.lit(1)
    )


def technologies(description: Column, names: list[str] | None = None) -> Column:
    """Sorted distinct dictionary names found as words. The names are part of the plan; a large
    dictionary, or one with names of several words, is a table for `technologies_in`."""
    names = TECHNOLOGIES if names is None else names
    words = words_of(description)
    spelled = F.array(*[F.lit(n) for n in sorted(names)])
    known = F.array_intersect(words, F.array(*[F.lit(n.lower()) for n in names]))
    return bind(known, lambda k: F.filter(spelled, lambda n: F.array_contains(k, F.lower(n))))




def rule_analyser(description: Column, technologies_wanted: bool = True, salary_wanted: bool = True) -> Column:
    """The built-in analyser: same struct an external one returns, no tokens spent."""
    techs = technologies(description) if technologies_wanted else F.array().cast("array<string>")
    salary = annual_salary(description) if salary_wanted else F.lit(0)
    return F.struct(
        required_studies(description).alias("required_studies"),
        techs.alias("technologies_required"),
        years_of_experience(description).alias("experience_years_needed"),
        salary.alias("salary_offered"),
        F.lit(0).alias("token_cost"),
    )
