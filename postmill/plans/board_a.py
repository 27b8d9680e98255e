"""Board A from search settings to new postings.

Pages are parsed in one pass over all positions, and what can be decided per card or per
detail page is decided there. Only the part that depends on what was kept before walks
over the positions in order, on a narrow table; the driver sees counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill import runtime
from postmill.config import BoardASearch
from postmill.operators import metrics
from postmill.operators.cards import card_explode, card_postings, detail_fields, page_cards
from postmill.operators.enrich import FIELDS_A, analysed_rows, enrich_gate
from postmill.operators.filters import quarantine_split, valid_link_filter
from postmill.operators.greedy import greedy_dedup
from postmill.operators.joins import ID_KEY, PAIR_KEY, anti_join_prior, identity_keys
from postmill.operators.language import language_filter, with_language
from postmill.operators.quota import BLOCK, failed_page_reached, pages_used, short_position_used
from postmill.plans.run import Run, quarantine_union
from postmill.schema import conform
from postmill.sources.frontier import search_frontier_a, with_search_url_a
from postmill.sources.page_store import extract_for

# Pages of each position that are parsed up front; a position that goes on is extended.
FIRST_PAGES = 32

_WHERE = ["position_no", "position", "page", "card"]


def run_board_a(
    pages: DataFrame,
    search: BoardASearch,
    as_of: datetime | str,
    detector,
    prior: DataFrame | None = None,
    analyser=None,
    first_pages: int = FIRST_PAGES,
    hot_min_rows: int = runtime.HOT_MIN_ROWS,
) -> Run:
    """New postings of one run over stored pages (url, html).

    `prior` are the postings kept by earlier runs: they block, but do not count towards
    the quotas. `detector` has `detect(column)`; `analyser` maps a description column to
    the analysis struct and is needed when the search uses analysis.

    Quarantined are cards that cannot be read, the search page that ended a position because
    it is not stored, and cards of used pages whose detail page is not stored.
    """
    if search.use_analysis and analyser is None:
        raise ValueError("an analyser is needed when use_analysis is enabled")
    job = _BoardA(pages, search, as_of, detector, prior, hot_min_rows)
    kept, progress = job.walk(first_pages)
    postings = conform(kept.join(job.details, "job_id"), [*_WHERE, "description"])
    quarantined = quarantine_union(job.quarantined, *job.absent(kept, progress))
    if search.use_analysis:
        gate = enrich_gate(search.desired_language, True, F.col("description_lang"))
        postings, unanswered = analysed_rows(postings, analyser, gate, FIELDS_A)
        quarantined = quarantine_union(quarantined, unanswered.drop("description"))
    else:
        postings = postings.withColumn("token_cost", F.lit(0))
    return Run(postings.drop("description"), quarantined, progress)


class _BoardA:
    def __init__(self, pages, search, as_of, detector, prior, hot_min_rows):
        self.spark = pages.sparkSession
        self.pages = pages
        self.search = search
        self.as_of = as_of
        self.detector = detector
        self.prior = prior
        self.hot_min_rows = hot_min_rows
        self.details = None
        self.quarantined = None
        self.lacking = None
        self.stops = []

    def gather(self, first_page: int, last_page: int, from_position: int = 0):
        """(page status, candidate cards) of a range of pages, both written.

        Candidates are partitioned by position, so each step of the walk reads its own.
        """
        frontier = search_frontier_a(self.spark, self.search, first_page, last_page)
        frontier = frontier.filter(F.col("position_no") >= from_position)
        listings = self.pages.filter(F.startswith("url", F.lit(fixed.BOARD_A_SEARCH_URL)))
        searched = runtime.cut_lineage(extract_for(frontier, listings, "url", page_cards))
        found = searched.select("position_no", "page", F.lit(False).alias("failed"))
        status = runtime.cut_lineage(
            frontier.drop("url").join(found, ["position_no", "page"], "left")
            .withColumn("failed", F.coalesce(F.col("failed"), F.lit(True)))
        )

        listed = searched.select("position_no", "position", "page", "cards")
        cards = card_postings(valid_link_filter(card_explode(listed)), self.as_of)
        usable, failing = quarantine_split(cards, {"age without a number": F.col("posted_time").isNotNull()})
        self.quarantined = failing if self.quarantined is None else self.quarantined.unionByName(failing)

        titled = with_language(usable, self.detector, "title", "title_lang")
        titled, rows = runtime.cut_and_count(language_filter(titled, "title_lang", self.search.language))
        if self.prior is not None:
            titled, rows = runtime.cut_and_count(anti_join_prior(titled, self.prior, rows, self.hot_min_rows))

        details, lacking = self.read_details(titled.select("job_id").distinct())
        hot = runtime.hot_keys(titled, "job_id", rows, self.hot_min_rows)
        order = F.shiftleft(F.col("page").cast("long"), 31) + F.col("card")
        keyed = titled.withColumns({**identity_keys(), "_order": order})
        candidates = runtime.split_by_membership(keyed, details.select("job_id"), "job_id", hot, keep_members=True)
        without = runtime.split_by_membership(keyed, lacking, "job_id", hot, keep_members=True)
        self.lacking = without if self.lacking is None else self.lacking.unionByName(without)
        return status, runtime.written_table(candidates, "position_no")

    def read_details(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(detail fields in the desired language, one row per id; ids without a stored page);
        html stays where it is."""
        prefix = fixed.BOARD_A_DETAIL_URL
        stored = self.pages.filter(F.startswith("url", F.lit(prefix))).select(
            F.substring("url", len(prefix) + 1, 2**31 - 1).alias("job_id"), "html"
        )
        wanted = runtime.cut_lineage(wanted)
        read = extract_for(wanted, stored, "job_id", detail_fields)
        read = runtime.cut_lineage(with_language(read, self.detector, "description", "description_lang"))
        lacking = runtime.cut_lineage(wanted.join(read.select("job_id"), "job_id", "left_anti"))
        details = language_filter(read, "description_lang", self.search.language)
        if self.details is None:
            self.details = details
        else:
            fresh = details.join(self.details.select("job_id"), "job_id", "left_anti")
            self.details = self.details.unionByName(runtime.cut_lineage(fresh))
        return details, lacking

    def walk(self, first_pages: int):
        """Positions in order: kept cards and the progress table."""
        search = self.search
        status, candidates = self.gather(0, first_pages - 1)
        last = first_pages
        kept, used, total = [], [], 0
        for position_no in range(len(search.phrases)):
            if total >= search.max_jobs:
                break
            own = F.col("position_no") == position_no
            while True:
                room = search.max_jobs - total
                new, added, taken, pages, stop = self.position(status.filter(own), candidates.filter(own), kept, room, last)
                if pages < last:
                    break
                # No rule has stopped this position yet: go further, for later ones as well.
                more_status, more_candidates = self.gather(last, 2 * last - 1, position_no)
                status = status.unionByName(more_status)
                candidates = candidates.unionByName(more_candidates)
                last *= 2
            total += added
            kept.append(new)
            used.append(taken)
            self.stops.append(stop)
        progress = _union(used, status.select("position_no", "position", "page", F.lit(0).alias("n")))
        return _union(kept, candidates), metrics.progress_metrics(progress, "position_no")

    def absent(self, kept: DataFrame, progress: DataFrame) -> list[DataFrame]:
        """Pages that the walk asked for and that are not stored, with a reason: search pages,
        and detail pages of cards that no posting kept before them made superfluous."""
        tables = []
        if self.stops:
            stops = with_search_url_a(_union(self.stops, self.stops[0]), self.search)
            tables.append(stops.withColumn("reason", F.lit("no search page")))
        if self.lacking is not None:
            place = F.struct("position_no", "page", "card")
            first = kept.groupBy(PAIR_KEY).agg(F.min(place).alias("_first"))
            cards = self.lacking.join(progress.select("position_no", "page"), ["position_no", "page"], "left_semi")
            asked = cards.join(first, PAIR_KEY, "left").filter(F.col("_first").isNull() | (place < F.col("_first")))
            told = asked.select(*_WHERE, "title", "company", "url", "job_id", F.lit("no detail page").alias("reason"))
            tables.append(runtime.cut_lineage(told))
        return tables

    def position(self, status: DataFrame, cards: DataFrame, kept: list[DataFrame], room: int, pages: int):
        """(new cards, their number, pages used, their number, the page whose failure ended the
        position) of a position with this many gathered pages."""
        if kept:
            cards = runtime.cut_lineage(
                anti_join_prior(cards, _union(kept, cards), cards.count(), self.hot_min_rows)
            )
        fresh = greedy_dedup(cards, ["_order"], ID_KEY, PAIR_KEY, self.hot_min_rows)
        fresh = runtime.cut_lineage(fresh)
        per_page = fresh.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
        counts = status.join(per_page, "page", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
        cap, failed = self.search.max_jobs_per_position, F.col("failed")
        if pages <= BLOCK:
            used = short_position_used(counts, min(cap, room), failed)
        else:
            used = pages_used(counts, "position_no", cap, room, failed)
        used, n_used = runtime.cut_and_count(used.select("position_no", "position", "page", "n"))
        new, n_new = runtime.cut_and_count(fresh.join(used.select("page"), "page", "left_semi"))
        stop = failed_page_reached(counts, used, min(cap, room), failed)
        stop = runtime.cut_lineage(counts.join(stop, ["position", "page"], "left_semi").select("position_no", "position", "page"))
        return new, n_new, used, n_used, stop


def _union(tables: list[DataFrame], otherwise: DataFrame) -> DataFrame:
    if not tables:
        return otherwise.limit(0)
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result
