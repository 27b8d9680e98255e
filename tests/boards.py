"""Stored pages of both boards, written from plain records."""

import json

from postmill import fixed_values as fixed
from postmill.functions import addresses
from postmill.sources.frontier import search_frontier_a, search_frontier_b


def card_html(card):
    link = f'<a class="base-card__full-link x" href="{card["url"]}"></a>' if card["url"] else ""
    return (
        f'<li>\n<div class="base-card job">{link}<h3 class="c__title">{card["title"]}</h3>'
        f'<h4 class="c__subtitle">{card["company"]}</h4><span class="c__location">{card["location"]}</span>'
        f'<time class="c__listdate">{card["age"]}</time></div></li>'
    )


def detail_html(detail):
    icon = "" if detail["easy_apply"] == "Yes" else f'<icon data-svg-class-name="{fixed.OFFSITE_ICON}"></icon>'
    items = "".join(
        f'<li><h3 class="description__job-criteria-subheader">{k}</h3>'
        f'<span class="description__job-criteria-text">{v}</span></li>'
        for k, v in detail["criteria"].items()
    )
    return (
        f'{icon}<div class="description__text"><section><div>{detail["description"]}</div></section></div>'
        f'<ul class="description__job-criteria-list">{items}</ul>'
    )


def store_a(spark, search, search_pages, details):
    """search_pages: {(position_no, page): [card]}, details: {job_id: detail}"""
    last = max((page for _, page in search_pages), default=0)
    frontier = search_frontier_a(spark, search, 0, last).collect()
    urls = {(r.position_no, r.page): r.url for r in frontier}
    rows = [(urls[k], "<ul>" + "".join(map(card_html, cards)) + "</ul>") for k, cards in search_pages.items()]
    rows += [(fixed.BOARD_A_DETAIL_URL + i, detail_html(d)) for i, d in details.items()]
    rows += [("https://elsewhere.example/1", "<p>other</p>"), rows[0]]
    return spark.createDataFrame(rows, "url string, html string")


def results_html(results, tiers=()):
    model = {"metaData": {"mosaicProviderJobCardsModel": {"results": results, "tierSummaries": list(tiers)}}}
    return (
        '<html><script>window.mosaic.providerData["mosaic-provider-jobcards"]='
        + json.dumps(model, ensure_ascii=False) + ";</script></html>"
    )


def job_html(description):
    blob = {"jobInfoWrapperModel": {"jobInfoModel": {"sanitizedJobDescription": description}}}
    return f"<script>window._initialData={json.dumps(blob)};</script>"


def store_b(spark, search, search_pages, details):
    """search_pages: {position_no: html}, details: {job_id: html}"""
    urls = {r.position_no: r.url for r in search_frontier_b(spark, search).collect()}
    ids = spark.createDataFrame([(i,) for i in details], "i string")
    detail_urls = dict(ids.select("i", addresses.board_b_detail_url(ids.i, search.base_url)).collect())
    rows = [(urls[k], page) for k, page in search_pages.items()]
    rows += [(detail_urls[i], page) for i, page in details.items()]
    return spark.createDataFrame(rows, "url string, html string")
