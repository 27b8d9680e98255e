"""Values that results must equal, kept together in one place.

These are fixed values: names, codes, addresses, markers and patterns of the two job
boards whose stored pages the engine reads. Board A serves postings as HTML cards,
board B as a JSON document embedded in a script.
"""

# Codes used in search addresses.
WORK_MODE_CODES = {"On-site": 1, "Remote": 2, "Hybrid": 3}

EXPERIENCE_CODES = {
    "Intern": 1,
    "Assistant": 2,
    "Junior": 3,
    "Mid-Senior": 4,
    "Director": 5,
    "Executive": 6,
}

TIMESPAN_CODES = {"None": "", "Day": "r86400", "Week": "r604800", "Month": "r2592000"}

# Addresses.
BOARD_A_SEARCH_URL = "https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search"
BOARD_A_DETAIL_URL = "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"
BOARD_B_BASE_URL = "https://fr.indeed.com"
BOARD_B_REMOTE_SUFFIX = "&sc=0kf%3Aattr%285QWDV%7CCF3CP%252COR%29attr%28DSQF7%29%3B"
PAGE_OFFSET = 10
REMOTE_WORK_TYPE = 2

# Values of the posting column `source`.
SOURCE_A = "LinkedIn"
SOURCE_B = "Indeed"

# Markers in board A pages.
CARD_CLASS = "base-card"
LINK_CLASS_PART = "_full-link"
TITLE_CLASS_PART = "_title"
COMPANY_CLASS_PART = "_subtitle"
AGE_CLASS_PART = "listdate"
LOCATION_CLASS_PART = "_location"
DESCRIPTION_CLASS_PART = "description"
CRITERIA_LIST_CLASS = "description__job-criteria-list"
CRITERIA_LABEL_CLASS = "description__job-criteria-subheader"
CRITERIA_VALUE_CLASS = "description__job-criteria-text"
OFFSITE_ICON = "apply-button__offsite-apply-icon-svg"
CRITERIA_FIELDS = {
    "Seniority level": "seniority_level",
    "Employment type": "employment_type",
    "Job function": "job_function",
    "Industries": "industries",
}

# Patterns of the JSON documents embedded in board B pages.
RESULTS_BLOB = r'window.mosaic.providerData\["mosaic-provider-jobcards"\]=(\{.+?\});'
DETAIL_BLOB = r"_initialData=(\{.+?\});"

# Limits.
MAX_EMPTY_PAGES = 5
MAX_COLUMN_WIDTH = 50
LINK_COLUMN_WIDTH = 10

# Report layout.
REPORT_COLUMNS = [
    "title", "date_analyzed", "posted_time", "experience_years_needed", "easy_apply",
    "seniority_level", "employment_type", "job_function", "industries",
    "required_studies", "technologies_required", "company", "location",
    "salary_offered", "job_id", "title_lang", "description_lang", "source", "url",
]

# Request text for an external analyser.
REQUEST_BASE = """You are a job cataloger. Extract and return a JSON object
            with the following fields from the given software developer job description:
            - 'experience_years_needed': The number of years of experience required.
            - 'required_studies': The degree or education level required for the position (e.g., 'Bachelor's in Computer Science')."""
REQUEST_TECHNOLOGIES = """
            - 'technologies_required': A list of programming languages, frameworks, or tools mentioned as required."""
REQUEST_SALARY = """
            - 'salary_offered': The annual salary offered in integers (e.g., 80000). If a range is given, use the lower bound."""
REQUEST_DEFAULTS = """
            If no explicit experience requirement is found, return 0.
            If no required studies are mentioned, return 'Not specified'."""
REQUEST_DEFAULT_TECHNOLOGIES = "\nIf no technologies are mentioned, return an empty list."
REQUEST_DEFAULT_SALARY = "\nIf no salary is mentioned, return 0."
STUDIES_NOT_SPECIFIED = "Not specified"
