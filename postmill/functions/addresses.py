"""Search and detail addresses, and the id inside a posting link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed_values as fixed


def form_encode(text: Column) -> Column:
    """Form encoding: space is '+', '~' stays, '*' is escaped."""
    encoded = F.url_encode(text.cast("string"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _param(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), form_encode(value))


def posting_id(url: Column) -> Column:
    """After the last '-', up to the first '?' of that piece."""
    return F.substring_index(F.substring_index(url, "-", -1), "?", 1)


def board_a_search_url(start: Column, keywords: Column, search) -> Column:
    """Optional parameters that do not apply are null, which concat_ws skips."""
    null = F.lit(None).cast("string")
    timespan = fixed.TIMESPAN_CODES[search.publish_timespan]
    parameters = [
        _param("start", start),
        _param("location", F.lit(search.location)),
        _param("f_E", F.lit(fixed.EXPERIENCE_CODES[search.experience_level])),
        _param("f_JT", F.lit(fixed.WORK_MODE_CODES[search.work_mode])),
        _param("f_WT", F.lit(fixed.REMOTE_WORK_TYPE)),
        F.lit("f_AL=true") if search.easy_apply else null,
        F.when(keywords != "", _param("keywords", keywords)),
        F.lit("f_JIYN=true") if search.less_than_ten_applicants else null,
        _param("f_TPR", F.lit(timespan)) if timespan else null,
    ]
    return F.concat(F.lit(fixed.BOARD_A_SEARCH_URL + "?"), F.concat_ws("&", *parameters))


def board_a_detail_url(job_id: Column) -> Column:
    return F.concat(F.lit(fixed.BOARD_A_DETAIL_URL), job_id)


def board_b_search_url(
    phrase: Column,
    location: Column,
    max_age_days: Column | int = 3,
    remote_only: Column | bool = True,
    base_url: str = fixed.BOARD_B_BASE_URL,
) -> Column:
    age = max_age_days if isinstance(max_age_days, Column) else F.lit(max_age_days)
    remote = remote_only if isinstance(remote_only, Column) else F.lit(remote_only)
    query = F.concat_ws("&", _param("q", phrase), _param("l", location), _param("fromage", age))
    suffix = F.when(remote, F.lit(fixed.BOARD_B_REMOTE_SUFFIX)).otherwise(F.lit(""))
    return F.concat(F.lit(f"{base_url}/jobs?"), query, suffix)


def board_b_detail_url(job_id: Column, base_url: str = fixed.BOARD_B_BASE_URL) -> Column:
    return F.concat(F.lit(f"{base_url}/viewjob?jk="), job_id)
