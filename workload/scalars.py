"""Dates, enrichment and other columns derived row by row."""

from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions import dates, enrichment
from postmill.operators import enrich
from postmill.operators.filters import posting_predicates as apply_predicates
from workload.registry import SQL_MILLIS, millis, query, utc

AS_OF = "2024-03-10 12:00:00"
_N = "(event_id % 97)"


@query(
    f"""SELECT event_id, age, {SQL_MILLIS.format('posted')} AS posted FROM (SELECT event_id, age,
    CASE event_id % 6 WHEN 0 THEN t0 - to_hours(event_id % 97) WHEN 1 THEN t0 - to_days(event_id % 97)
    WHEN 2 THEN t0 WHEN 3 THEN NULL WHEN 4 THEN t0 ELSE t0 - to_days(30) END AS posted
    FROM (SELECT event_id, TIMESTAMP '{AS_OF}' AS t0, CASE event_id % 6
    WHEN 0 THEN {_N} || ' hours ago' WHEN 1 THEN {_N} || ' days ago' WHEN 2 THEN {_N} || ' weeks ago'
    WHEN 3 THEN 'yesterday' WHEN 4 THEN '' ELSE '30+ days ago' END AS age FROM events))"""
)
def relative_age(t):
    n, kind = (F.col("event_id") % 97).cast("string"), F.col("event_id") % 6
    age = (
        F.when(kind == 0, F.concat(n, F.lit(" hours ago"))).when(kind == 1, F.concat(n, F.lit(" days ago")))
        .when(kind == 2, F.concat(n, F.lit(" weeks ago"))).when(kind == 3, F.lit("yesterday"))
        .when(kind == 4, F.lit("")).otherwise(F.lit("30+ days ago"))
    )
    aged = t.events.select("event_id", age.alias("age"))
    return aged.withColumn("posted", millis(dates.relative_age(F.col("age"), AS_OF)))


@query(f"SELECT event_id, {SQL_MILLIS.format('ts')} AS posted FROM events")
def epoch_millis(t):
    ms = F.unix_millis(utc("ts"))
    return t.events.select("event_id", millis(dates.epoch_millis(ms)).alias("posted"))


@query("SELECT event_id, strftime(ts, '%d of %B %Y') AS shown FROM events")
def date_display(t):
    return t.events.select("event_id", dates.date_display(F.col("ts")).alias("shown"))


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY
    AND o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def posting_predicates(t):
    postings = t.orders.select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("posted_time"),
        F.col("o_orderpriority").alias("seniority_level"), F.col("o_orderstatus").alias("location"),
    )
    as_of = F.lit("1998-06-01").cast("timestamp_ntz")
    found = apply_predicates(
        postings, as_of, max_age_days=30, seniority=["1-URGENT", "2-HIGH"], locations=["O"]
    )
    return found.select("o_orderkey", "o_orderpriority")


@query(
    """SELECT doc_id, lang, lower(lang) = 'en' AS gated FROM documents"""
)
def enrich_gate(t):
    return t.documents.select("doc_id", "lang", enrich.enrich_gate("EN", True, F.col("lang")).alias("gated"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_INSTRUCTION = fixed.REQUEST_BASE + fixed.REQUEST_SALARY + fixed.REQUEST_DEFAULTS + fixed.REQUEST_DEFAULT_SALARY


@query(
    f"""SELECT conv_id, turn, '{_quoted(_INSTRUCTION)}' || chr(10) || text AS request,
    '{_quoted(fixed.REQUEST_BASE + fixed.REQUEST_DEFAULTS)}' || chr(10) || text AS shortest FROM conversations"""
)
def enrich_request(t):
    text = F.col("text")
    return t.conversations.select(
        "conv_id", "turn",
        enrichment.request_text(text, technologies=False).alias("request"),
        enrichment.request_text(text, technologies=False, salary=False).alias("shortest"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS required_studies,
    CASE WHEN p_partkey % 11 <> 0 THEN p_name || ', ' || p_brand END AS technologies,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS years,
    CASE WHEN p_partkey % 11 <> 0 THEN 0 END AS salary,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size * 3 END AS token_cost FROM part"""
)
def enrich_parse(t):
    studies = F.when(F.col("p_partkey") % 11 != 0, F.col("p_type"))
    answer = F.to_json(
        F.struct(
            studies.alias("required_studies"), F.array("p_name", "p_brand").alias("technologies_required"),
            F.col("p_size").alias("experience_years_needed"), F.lit(99).alias("salary_offered"),
        )
    )
    parsed = t.part.select(
        "p_partkey", enrichment.parse_response(answer, F.col("p_size") * 3, salary=False).alias("a")
    )
    return parsed.select(
        "p_partkey", "a.required_studies", F.array_join("a.technologies_required", ", ").alias("technologies"),
        F.col("a.experience_years_needed").alias("years"), F.col("a.salary_offered").alias("salary"), "a.token_cost",
    )


@query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role || ', Go' WHEN 1 THEN role WHEN 2 THEN '' ELSE '' END
    AS technologies FROM conversations"""
)
def reasoning_strip(t):
    thought = F.concat(F.lit("<think>"), "text", F.lit("\n{</think>\n "))
    one = F.concat(F.lit('{"technologies":["'), "role", F.lit('"'))
    kind = F.col("turn") % 4
    output = (
        F.when(kind == 0, F.concat(thought, one, F.lit(', "Go"]} and that is all')))
        .when(kind == 1, F.concat(thought, F.lit("```json\n{"), one, F.lit("]}}\n```")))
        .when(kind == 2, F.concat(one, F.lit('],"more":{"k":1}}')))
        .otherwise(thought)
    )
    stripped = enrichment.reasoning_strip(output)
    return t.conversations.select("conv_id", "turn", F.array_join(stripped, ", ").alias("technologies"))


_DESCRIBED = """'We need ' || p_size || '+ years of Java, C++ and ' || p_name || '. ' ||
    CASE WHEN p_partkey % 3 = 0 THEN 'Master''s or bachelor degree. ' ELSE '' END ||
    CASE WHEN p_partkey % 2 = 0 THEN 'Salary: ' || (p_size * 1000) || ' - 99000 EUR' ELSE 'Fair pay' END"""


def described(part):
    key, size = F.col("p_partkey"), F.col("p_size")
    return F.concat(
        F.lit("We need "), size, F.lit("+ years of Java, C++ and "), F.col("p_name"), F.lit(". "),
        F.when(key % 3 == 0, F.lit("Master's or bachelor degree. ")).otherwise(F.lit("")),
        F.when(key % 2 == 0, F.concat(F.lit("Salary: "), size * 1000, F.lit(" - 99000 EUR"))).otherwise("Fair pay"),
    )


@query(
    """SELECT p_partkey, p_size AS years, CASE WHEN p_partkey % 3 = 0 THEN 'Master' ELSE 'Not specified' END AS studies,
    'C++, Java' AS technologies, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 ELSE 0 END AS salary FROM part"""
)
def attribute_rules(t):
    rules = enrichment.rule_analyser(described(t.part))
    return t.part.select("p_partkey", rules.alias("a")).select(
        "p_partkey", F.col("a.experience_years_needed").alias("years"),
        F.col("a.required_studies").alias("studies"),
        F.array_join("a.technologies_required", ", ").alias("technologies"),
        F.col("a.salary_offered").alias("salary"),
    )


@query(
    f"""SELECT doc_id, lang,
    coalesce(CAST(list_min(list_transform(regexp_extract_all(text,
        '(?i)(?:^|[^\\d.,])(\\d{{1,2}})\\s*(?:\\+|(?:-|–|to)\\s*\\d{{1,2}})?\\s*(?:years?|yrs?)\\b', 1),
        lambda y: CAST(y AS INTEGER))) AS INTEGER), 0) AS years FROM documents""",
    name="attribute_rules_years",
)
def years_in_documents(t):
    return t.documents.select("doc_id", "lang", enrichment.years_of_experience(F.col("text")).alias("years"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS experience_years_needed,
    CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Master' ELSE 'Not specified' END ELSE 'kept' END
    AS required_studies, -1 AS salary_offered, 0 AS token_cost FROM part"""
)
def enrich_merge(t):
    postings = t.part.select(
        "p_partkey", "p_size", described(t.part).alias("description"), F.lit("kept").alias("required_studies"),
        F.lit(-1).alias("experience_years_needed"), F.lit(-1).alias("salary_offered"),
    )
    filled = enrich.enrich(postings, enrichment.rule_analyser, F.col("p_size") % 2 == 0, enrich.FIELDS_B)
    return filled.drop("p_size", "description")
