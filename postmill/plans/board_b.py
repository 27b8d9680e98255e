"""Board B from search settings to postings: one pass, no quotas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import runtime
from postmill.config import BoardBSearch
from postmill.functions.enrichment import rule_analyser
from postmill.operators.embedded import embedded_detail, embedded_results, page_results, posting_from_json
from postmill.operators.enrich import FIELDS_B, analysed_rows, enrich_gate
from postmill.operators.filters import quarantine_split
from postmill.operators.language import with_language
from postmill.plans.run import Run
from postmill.schema import conform
from postmill.sources.frontier import search_frontier_b, with_search_url_b
from postmill.sources.page_store import extract_for


def run_board_b(
    pages: DataFrame,
    search: BoardBSearch,
    as_of: datetime | str,
    detector,
    analyser=None,
    phrases: DataFrame | None = None,
    hot_min_rows: int = runtime.HOT_MIN_ROWS,
) -> Run:
    """Postings of the stored search pages of every phrase, with their details.

    Phrases come from the search settings, or from a table (position_no, position) of any
    length.
    """
    if phrases is None:
        frontier = search_frontier_b(pages.sparkSession, search)
    else:
        frontier = runtime.cut_lineage(with_search_url_b(phrases, search))
    # Search and detail pages have addresses of their own, so each pass reads its part.
    listings = pages.filter(F.startswith("url", F.lit(f"{search.base_url}/jobs?")))
    searched = runtime.cut_lineage(extract_for(frontier, listings, "url", page_results))
    results, unreadable = embedded_results(searched)
    results = results.drop("url")
    postings = posting_from_json(results, as_of, search.base_url)
    usable = postings.filter(F.col("reason").isNull()).drop("reason")
    usable = runtime.cut_lineage(with_language(usable, detector, "title", "title_lang"))

    wanted = runtime.cut_lineage(usable.select("url").distinct())
    described = pages.filter(F.startswith("url", F.lit(f"{search.base_url}/viewjob?")))
    details = runtime.cut_lineage(extract_for(wanted, described, "url", _detail_text))
    readable, no_text = quarantine_split(details, {"no readable detail": F.col("description").isNotNull()})
    readable = with_language(readable, detector, "description", "description_lang")
    hot = runtime.hot_keys(usable, "url", usable.count(), hot_min_rows)
    joined = runtime.skew_join(usable, readable, "url", hot)

    joined = joined.withColumns({
        "experience_years_needed": F.lit(None).cast("int"),
        "required_studies": F.lit(None).cast("string"),
    })
    gate = enrich_gate(search.desired_language, search.use_analysis, F.col("description_lang"))
    unanswered = []
    if search.use_analysis:
        analyse = analyser or (lambda text: rule_analyser(text, False, False))
        joined, failing = analysed_rows(joined, analyse, gate, FIELDS_B)
        unanswered.append(failing)
    else:
        joined = joined.withColumn("token_cost", F.lit(0))

    quarantined = _reasons(
        _without(frontier, searched, "no search page"),
        unreadable,
        postings.filter(F.col("reason").isNotNull()),
        no_text,
        _without(wanted, details, "no detail page"),
        *unanswered,
    )
    postings = conform(joined, ["position_no", "position", "card", "token_cost"])
    return Run(postings, quarantined)


def _without(asked: DataFrame, answered: DataFrame, reason: str) -> DataFrame:
    """Addresses that no page with content answered; both tables are written, html is not read."""
    return asked.join(answered.select("url").distinct(), "url", "left_anti").withColumn("reason", F.lit(reason))


def _detail_text(pages: DataFrame) -> DataFrame:
    return pages.select("url", embedded_detail(F.col("html")).alias("description"))


def _reasons(*tables: DataFrame) -> DataFrame:
    result = None
    for table in tables:
        table = table.select("url", "reason")
        result = table if result is None else result.unionByName(table)
    return result
