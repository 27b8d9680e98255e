"""Search settings of the two boards."""

from __future__ import annotations

from dataclasses import dataclass

from postmill import fixed_values as fixed


def _known(name: str, codes: dict, what: str) -> None:
    if name not in codes:
        raise ValueError(f"unknown {what} {name!r}; known are {', '.join(codes)}")


@dataclass(frozen=True)
class _Search:
    positions: str = "Software Developer"
    location: str = "France"
    desired_language: str = ""
    use_analysis: bool = False

    def __post_init__(self):
        if self.use_analysis and not self.desired_language:
            raise ValueError("analysis runs on postings of one language, so use_analysis needs a desired_language")

    @property
    def phrases(self) -> list[str]:
        """Search phrases in order; spaces around commas stay."""
        return self.positions.split(",")

    @property
    def language(self) -> str:
        return self.desired_language.lower()


@dataclass(frozen=True)
class BoardASearch(_Search):
    work_mode: str = "Remote"
    easy_apply: bool = True
    max_jobs: int = 300
    max_jobs_per_position: int = 100
    experience_level: str = "Mid-Senior"
    publish_timespan: str = "Week"
    less_than_ten_applicants: bool = True

    def __post_init__(self):
        super().__post_init__()
        _known(self.work_mode, fixed.WORK_MODE_CODES, "work mode")
        _known(self.experience_level, fixed.EXPERIENCE_CODES, "experience level")
        _known(self.publish_timespan, fixed.TIMESPAN_CODES, "publish timespan")


@dataclass(frozen=True)
class BoardBSearch(_Search):
    base_url: str = fixed.BOARD_B_BASE_URL
    max_age_days: int = 3
    remote_only: bool = True
