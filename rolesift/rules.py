"""Rule data: word lists, weights, patterns and limits, and their table forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rolesift import schemas

# ---- Fixed values: they must equal the published rule set for right results ----

TITLE_INCLUDE = ("software", "engineer", "backend", "senior")

TITLE_EXCLUDE = (
    "junior", "jr", "jr.", "entry level", "entry-level", "fresher", "graduate",
    "intern", "internship", "trainee", "apprentice",
    "associate", "mid-level", "mid level", "intermediate", "level 1", "level i",
    "l1", "level 2", "level ii", "l2",
    "qa", "tester", "test engineer", "sdet", "automation tester", "manual tester",
    "support", "technical support", "it support", "helpdesk",
    "sysadmin", "system administrator", "network engineer", "it engineer",
    "devops", "site reliability", "sre",
    "data", "business", "manager",
    "scrum master", "agile coach", "analyst", "quality",
    "hardware", "embedded", "firmware",
    "electrical", "mechanical", "civil",
    "ui", "ux", "designer", "web designer", "frontend intern",
    "contract", "contractor", "temporary", "temp", "freelance", "part-time", "part time",
    "director", "vp", "vice president", "head", "chief", "cto", "lead", "principal", "staff",
    "consultant", "advisor", "specialist", "coordinator", "assistant",
    "sales", "pre-sales", "presales", "marketing", "growth", "seo",
    "ninja", "rockstar", "guru", "wizard", "evangelist", "hacker", "champion",
    "researcher", "research assistant", "phd", "postdoc", "fellow",
    "wordpress", "shopify", "wix", "webflow",
    "trainer", "instructor", "faculty", "teacher",
)

LOCATIONS = (
    "india", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai", "delhi",
    "noida", "gurgaon", "gurugram", "chennai", "kolkata", "ahmedabad",
)

POSITIVE = (
    ("java", 2), ("python", 2),
    ("generative ai", 3), ("genai", 3), ("large language model", 3),
    ("rag", 3), ("retrieval augmented generation", 3),
    ("langchain", 2), ("vector database", 2), ("embeddings", 2),
    ("prompt engineering", 2), ("fine-tuning", 2), ("ai agents", 3),
    ("openai", 2), ("llm orchestration", 3), ("ai infrastructure", 3),
    ("microservices", 3), ("distributed systems", 3), ("api", 3), ("rest", 3),
    ("grpc", 3), ("graphql", 3), ("event-driven", 3), ("kafka", 3), ("rabbitmq", 3),
    ("aws", 2), ("gcp", 2), ("azure", 2), ("kubernetes", 2), ("k8s", 2),
    ("docker", 2), ("terraform", 2), ("ci/cd", 2),
    ("sql", 2), ("nosql", 2), ("postgresql", 2), ("mysql", 2), ("redis", 2),
    ("elasticsearch", 2), ("dynamodb", 2), ("mongodb", 2), ("cassandra", 2),
    ("system design", 3), ("scalability", 3), ("concurrency", 3),
    ("high availability", 3), ("fault tolerance", 3), ("caching", 3),
    ("load balancing", 3),
)

NEGATIVE = (
    ("react", 2), ("angular", 2), ("vue", 2), ("css", 2), ("html", 2),
    ("ios", 2), ("android", 2), ("swift", 2), ("objective-c", 2), ("flutter", 2),
    ("machine learning", 2), ("deep learning", 2),
    ("computer vision", 2), ("model training", 2),
    ("sales", 3), ("marketing", 3), ("data science", 3), ("data analyst", 3),
    ("recruiting", 3),
)

# (?iU): ignore case, with Unicode-aware \b and \s
PATTERNS = (
    (r"(?iU)\b[5-9]\+?\s*years", 3),
    (r"(?iU)\b1[0-5]\+?\s*years", 3),
    (r"(?iU)\bsenior\b", 2),
    (r"(?iU)\bbackend\b", 3),
)

SCORE_THRESHOLD = 20
MAX_PAGES = 20
PAGE_LIMIT = 20
FRESH_HOURS = 24

MIN_KEYWORD_SAMPLES = 3
MIN_TOTAL_DECISIONS = 10
BOOST_ABOVE = 1.3
SUPPRESS_BELOW = 0.7
MAX_MULTIPLIER = 2.0
MIN_MULTIPLIER = 0.25

# Values of company_info.ats, and the CSV columns they come from
SOURCE_A = "workday"
SOURCE_B = "greenhouse"
NAME_COLUMN = "Company Name"
LINK_COLUMNS = ((SOURCE_A, "Workday Carrer Page"), (SOURCE_B, "Greenhouse Carrer Page"))

# ---- End of fixed values ----


@dataclass(frozen=True)
class RuleSet:
    """Everything the ingest plan needs to judge a posting."""

    title_include: tuple[str, ...] = TITLE_INCLUDE
    title_exclude: tuple[str, ...] = TITLE_EXCLUDE
    locations: tuple[str, ...] = LOCATIONS
    positive: tuple[tuple[str, float], ...] = POSITIVE
    negative: tuple[tuple[str, float], ...] = NEGATIVE
    patterns: tuple[tuple[str, float], ...] = PATTERNS
    threshold: float = SCORE_THRESHOLD
    max_pages: int = MAX_PAGES
    fresh_hours: int = FRESH_HOURS


def keyword_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The weighted keywords as rows, in list order within each polarity."""
    rows = [
        (ordinal, polarity, keyword, float(weight))
        for polarity, words in (("pos", rules.positive), ("neg", rules.negative))
        for ordinal, (keyword, weight) in enumerate(words)
    ]
    return spark.createDataFrame(rows, schemas.KEYWORDS)
