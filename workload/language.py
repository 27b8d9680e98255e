"""Language identification over the documents."""

from pyspark.sql import functions as F

from postmill.functions.enrichment import words_of
from postmill.functions.language import SCALE, STOP_WORDS, ProfileDetector, StopWordDetector
from postmill.functions.trigrams import BASE, BUCKETS
from postmill.operators import language as ops
from postmill.operators.technologies import technologies_in
from workload.registry import query

_LANGS = sorted(STOP_WORDS)


def sql_stop_word_scores(text: str) -> str:
    """One column per language: hits among its words."""
    def words(lang):
        return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS[lang]) + "]"

    tokens = rf"regexp_extract_all(lower({text}), '\p{{L}}+')"
    return ", ".join(
        f"len(list_filter({tokens}, lambda w: list_contains({words(lang)}, w))) AS s_{lang}" for lang in _LANGS
    )


def sql_stop_word_lang() -> str:
    """The best of those columns; later names win ties."""
    best = "greatest(" + ", ".join(f"s_{lang}" for lang in _LANGS) + ")"
    cases = " ".join(f"WHEN s_{lang} = {best} THEN '{lang}'" for lang in reversed(_LANGS))
    return f"CASE WHEN {best} = 0 THEN 'unknown' {cases} END"


_SCORED = f"(SELECT doc_id, {sql_stop_word_scores('text')} FROM documents)"
_TOTAL = " + ".join(f"s_{lang}" for lang in _LANGS)
_BEST = "greatest(" + ", ".join(f"s_{lang}" for lang in _LANGS) + ")"


@query(f"SELECT doc_id, {sql_stop_word_lang()} AS detected FROM {_SCORED}")
def detect_language_stop_words(t):
    return t.documents.select("doc_id", StopWordDetector().detect(F.col("text")).alias("detected"))


@query(
    f"""SELECT doc_id, {sql_stop_word_lang()} AS detected,
    CASE WHEN {_TOTAL} = 0 THEN 0 ELSE round({_BEST} / ({_TOTAL}), 6) END AS confidence FROM {_SCORED}"""
)
def detect_with_confidence_stop_words(t):
    found = StopWordDetector().detect_with_confidence(F.col("text"))
    return t.documents.select("doc_id", found.alias("f")).select(
        "doc_id", F.col("f.lang").alias("detected"), F.round("f.confidence", 6).alias("confidence")
    )


@query(f"SELECT doc_id FROM (SELECT doc_id, {sql_stop_word_lang()} AS detected FROM {_SCORED}) WHERE detected = 'fr'")
def language_filter(t):
    detected = t.documents.select("doc_id", StopWordDetector().detect(F.col("text")).alias("detected"))
    return ops.language_filter(detected, "detected", "FR").select("doc_id")


_PROFILE = f"""
WITH points AS (
    SELECT doc_id, lang, text,
        list_transform(string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', ''),
                       lambda c: unicode(c)) AS u
    FROM documents),
grams AS (
    SELECT doc_id, lang, CAST(((u[i] * {BASE} + u[i + 1]) * {BASE} + u[i + 2]) % {BUCKETS} AS INTEGER) AS bucket
    FROM (SELECT doc_id, lang, u, unnest(range(1, len(u) - 1)) AS i FROM points)),
counted AS (SELECT lang, bucket, count(*) AS n FROM grams GROUP BY lang, bucket),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY lang),
texts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
profile AS (
    SELECT c.lang, 'gram' AS kind, bucket, c.n,
        CAST(round(ln((c.n + 1) / (t.n + {BUCKETS})) * {SCALE}) AS INTEGER) AS weight
    FROM counted c JOIN totals t ON c.lang = t.lang
    UNION ALL
    SELECT lang, 'unseen', -1, n, CAST(round(ln(1 / (n + {BUCKETS})) * {SCALE}) AS INTEGER) FROM totals
    UNION ALL
    SELECT lang, 'prior', -1, n,
        CAST(round(ln(n / (SELECT sum(n) FROM texts)) * {SCALE}) AS INTEGER) FROM texts)
"""

_SCORES = f"""{_PROFILE},
bags AS (SELECT doc_id, bucket, count(*) AS n FROM grams GROUP BY doc_id, bucket),
sums AS (
    SELECT b.doc_id, u.lang, sum(b.n * coalesce(g.weight, u.weight)) AS s
    FROM bags b CROSS JOIN (SELECT * FROM profile WHERE kind = 'unseen') u
    LEFT JOIN profile g ON g.kind = 'gram' AND g.lang = u.lang AND g.bucket = b.bucket
    GROUP BY b.doc_id, u.lang),
scores AS (
    SELECT d.doc_id, p.lang, p.weight + coalesce(s.s, 0) AS score
    FROM documents d CROSS JOIN (SELECT * FROM profile WHERE kind = 'prior') p
    LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.lang = p.lang),
best AS (SELECT doc_id, max(score) AS score FROM scores GROUP BY doc_id),
judged AS (
    SELECT d.doc_id,
        CASE WHEN trim(d.text) = '' THEN 'unknown' ELSE max(s.lang) FILTER (s.score = b.score) END AS detected,
        CASE WHEN trim(d.text) = '' THEN 0.0
             ELSE round(1 / sum(exp(CAST(s.score - b.score AS DOUBLE) / {SCALE})), 6) END AS confidence
    FROM documents d JOIN scores s ON s.doc_id = d.doc_id JOIN best b ON b.doc_id = d.doc_id
    GROUP BY d.doc_id, d.text)
"""


@query(_PROFILE + "SELECT * FROM profile")
def language_profile(t):
    return ops.language_profile(t.documents)


@query(_SCORES + "SELECT doc_id, detected FROM judged")
def detect_language(t):
    detector = ProfileDetector.from_table(ops.language_profile(t.documents))
    return t.documents.select("doc_id", detector.detect(F.col("text")).alias("detected"))


@query(_SCORES + "SELECT doc_id, detected, confidence FROM judged")
def detect_with_confidence(t):
    detector = ProfileDetector.from_table(ops.language_profile(t.documents))
    found = detector.detect_with_confidence(F.col("text"))
    return t.documents.select("doc_id", found.alias("f")).select(
        "doc_id", F.col("f.lang").alias("detected"), F.round("f.confidence", 6).alias("confidence")
    )


_SQL_NAME_WORDS = r"regexp_extract_all(lower(text), '(\.?[\p{L}\p{N}](?:[\p{L}\p{N}+#]|\.[\p{L}\p{N}])*)', 1)"


@query(
    rf"""WITH d AS (SELECT doc_id, {_SQL_NAME_WORDS} AS words FROM documents),
    names AS (SELECT DISTINCT array_to_string(words[1:2], ' ') AS name FROM d WHERE len(words) > 0),
    runs AS (SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS name FROM d)
    SELECT doc_id, CAST(count(n.name) AS INTEGER) AS n_names, md5(coalesce(string_agg(n.name, '|' ORDER BY n.name), '')) AS found
    FROM d LEFT JOIN (SELECT DISTINCT r.doc_id, r.name FROM runs r JOIN names USING (name)) n USING (doc_id) GROUP BY doc_id"""
)
def technologies_table(t):
    """The first two words of every document are a dictionary, looked up in all documents."""
    words = words_of(F.col("text"))
    names = t.documents.select(F.array_join(F.slice(words, 1, 2), " ").alias("name")).filter("name <> ''").distinct()
    found = technologies_in(t.documents.select("doc_id", "text"), names, "text", "names")
    return found.select("doc_id", F.size("names").alias("n_names"), F.md5(F.array_join("names", "|").cast("binary")).alias("found"))
