"""URL rules, carried over redirects and canonical links to a page's aliases.

Each page is a node. Its edges lead to the normal form of its own url and to the targets of
`<link rel=canonical>` and `<meta http-equiv=refresh>` in its html. Connected components over
the edges are alias classes, found by distributed contraction. A url that a rule fits takes
the longest rule's verdict (ties: allow). Any other takes its class's: allow if a member is
allowed by a rule, else block if a member is blocked by one, else allow.

Urls without `://` and nulls have no host and path, no edges, no rule and verdict allow. Pages
with the same url are one node. Every input row gives one row; columns other than those of the
result are not carried. Html is read once, inside the scan's tasks, and only hashes of urls
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import written
from postmill.llm.components import components

# (verdict, host, path prefix) in the order in which the longest is looked for.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Query parameters that do not name another page.
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    fits = (host == rule_host) | host.endswith("." + rule_host)
    return fits & path.startswith(rule_path)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits, nulls without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    rule = verdict = None
    for kind, rule_host, rule_path in ordered:
        fits = rule_fits(host, path, rule_host, rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def normal_form(url: Column) -> Column:
    """The url without scheme, `www.` and `m.`, fragment, tracking parameters, a trailing slash
    and `.html`."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/+)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.regexp_replace(query, rf"(^|&)({TRACKING})(=[^&]*)?(?=&|$)", "")
    return F.concat(host, path, F.lit("?"), F.regexp_replace(kept, "^&+", ""))


def link_targets(url: Column, html: Column) -> Column:
    """Absolute targets of canonical links and refreshes."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAG), F.lit(0))

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")
        refresh = tag.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
        found = F.when(canonical, F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(
            refresh, F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
        )
        scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
        return (
            F.when(found.contains("://"), found)
            .when(found.startswith("//"), F.concat(scheme, F.lit(":"), found))
            .when(found.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), found))
        )

    return F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of (page_id, url, html)."""
    url = F.col("url")
    node = F.when(url.contains("://"), F.xxhash64(F.lit("url"), url))
    form = lambda u: F.xxhash64(F.lit("form"), normal_form(u))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = written(
        pages.select(
            "page_id",
            F.when(url.contains("://"), host_of(url)).otherwise("").alias("host"),
            F.when(url.contains("://"), path_of(url)).otherwise("").alias("path"),
            node.alias("node"),
            F.when(node.isNotNull(), F.concat(F.array(form(url)), F.transform(link_targets(url, F.col("html")), form)))
            .alias("targets"),
        ).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "node", "targets")
    )
    linked = components(judged.select(F.col("node").alias("a"), F.explode("targets").alias("b")))
    members = judged.filter("node IS NOT NULL AND ruled IS NOT NULL").select("node", "ruled").distinct()
    classes = (
        linked.join(members, "node")
        .groupBy("component")
        .agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked"))
    )
    # Only classes that hold a blocked page and no allowed one change a verdict.
    blocked = linked.join(classes.filter("blocked AND NOT allowed"), "component", "left_semi").select("node").distinct()
    open_ = judged.filter("ruled IS NULL").join(blocked.withColumn("hit", F.lit(True)), "node", "left")
    settled = judged.filter("ruled IS NOT NULL")
    return settled.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).union(
        open_.select("page_id", "host", "path", "rule", F.when(F.col("hit"), "block").otherwise("allow"))
    )
