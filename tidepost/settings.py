"""Fixed values of the data model: columns, keyword bins, weights, word lists and templates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values (they decide results, so they are stated as they are).

PROFILE_NAMES = {
    "geospatial": "Earth Systems & Geospatial",
    "energy": "Energy Infrastructure & Grid",
    "cv_robotics": "Applied Computer Vision & Robotics",
    "llm_science": "LLM & AI Engineering for Science",
}

KEYWORD_BINS = {
    "environmental": [
        "environmental", "climate change", "earth science", "earth sciences", "sustainable energy",
        "renewable energy", "ecology", "biodiversity", "natural resources", "green technology",
        "green tech", "clean energy", "carbon", "methane", "GHG", "green house", "co2",
        "air quality", "water quality", "soil quality", "soil", "sustainable development",
        "carbon footprint", "sequestration", "climate modeling", "climate simulation", "climate",
        "EPA", "environmental protection", "environmental management", "environmental policy",
        "natural disaster", "disaster management", "disaster", "risk", "conservation",
        "environmental impact", "sustainability", "environmental monitoring", "sustainable",
    ],
    "CV_autonomous_robotics": [
        "computer vision", "robotics", "autonomous vehicles", "self-driving cars", "segmentation",
        "CNN", "OpenCV", "autonomous",
    ],
    "LLM_related": [
        "LLM", "LLMs", "large language model", "large language models", "generative AI",
        "generative artificial intelligence", "gen AI", "genAI",
    ],
    "geospatial_r_sensing": [
        "remote sensing", "satellite imagery", "satellite", "spatial", "GIS",
        "geographic information system", "earth observation", "geospatial analysis",
        "spatial analysis", "spatial modeling", "remote monitoring", "geoinformatics", "UAV",
        "UAVs", "drones", "geopandas", "arcgis", "aerial vehicles",
    ],
    "energy": [
        "energy systems", "electric", "natural gas", "utility", "utiltities", "solar energy",
        "wind energy", "hydropower", "thermal energy", "energy system", "energy network",
        "bioenergy", "hydrogen energy", "power grid", "battery",
    ],
    "coding": ["python", "deep learning", "DL", "neural net", "tensorflow"],
}

BIN_WEIGHTS = {
    "environmental": 1.0,
    "CV_autonomous_robotics": 1.0,
    "LLM_related": 0.7,
    "geospatial_r_sensing": 1.0,
    "energy": 0.8,
    "coding": 0.3,
}

ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

EXTRA_STOP_WORDS = ["said", "would", "could", "also", "new"]

ANCHOR_TEMPLATE = "{text}\n\nKey Requirements:\n{criteria}"
QUERY_PREFIX = ("Instruct: Given a query, retrieve relevant documents that answer the query\n"
                "Query: ")
EMBED_SUFFIX = "<|endoftext|>"
EMBED_CONTEXT = 8192

RATING_PROMPT = """You are a career advisor. Given the user's profile and criteria, and the following job details, rate how likely they would want to apply on a scale from 1 to 10.

User Profile:
{profile}

Application Criteria:
{criteria}

Job Details:
- Company: {companies}
- Title: {titles}
- Location: {location}
- Description: {desc}

Return only the integer rating (1–10), with no additional text.
"""

COST_PER_1K_TOKENS = 0.0006

PAGE_SIZE = 25
SOURCE_CAP = 1000
RECENCY_CODES = ("r86400", "r172800", "r604800", "r2592000")

HOLDOUT_FRACTION = 0.25
FOLDS = 5
MAX_DF = 0.8
MAX_FEATURES = 100_000
NGRAM_RANGE = (1, 2)
PCA_COMPONENTS = 70

# White space as text splitting means it: Unicode's, and the four separators before the blank.
# The flag makes \\s Unicode-aware; naming the code points instead is three times slower.
WHITESPACE = "\\s\\x1c-\\x1f"
UNICODE = "(?U)"

# ---------------------------------------------------------------------------------------------

STOP_WORDS = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS

SCORE_PREFIX = "score_"
MAX_SCORE = "similarity_score"
KEYWORD_COLUMNS = ["keyword_" + name for name in KEYWORD_BINS]
FEATURE_COLUMNS = KEYWORD_COLUMNS + ["weighted_keywords"]


def posting_schema(profiles: Iterable[str] = PROFILE_NAMES) -> T.StructType:
    """The posting table, with one score column per profile."""
    text, double, time = T.StringType(), T.DoubleType(), T.TimestampNTZType()
    scores = [MAX_SCORE] + [SCORE_PREFIX + name for name in profiles]
    return T.StructType(
        [T.StructField("job_id", text, False)]
        + [T.StructField(name, text) for name in ("source", "titles", "companies", "location", "level", "desc")]
        + [T.StructField("scraped_at", time), T.StructField("posted_at_raw", text), T.StructField("posted_at", time)]
        + [T.StructField(name, double) for name in scores]
        + [T.StructField("html", text)])
