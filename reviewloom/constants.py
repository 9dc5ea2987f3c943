"""Fixed values.

Everything here must equal the published behaviour for results to match:
output labels, column dialects, seed phrases, thresholds and word lists.
"""

from __future__ import annotations

from importlib import resources

# The four review sides, as (side, platform, source column, sentiment).
SIDES = {
    "pros_gd": ("glassdoor", "Pros", "positive"),
    "cons_gd": ("glassdoor", "Cons", "negative"),
    "likes_am": ("ambitionbox", "Likes", "positive"),
    "dislikes_am": ("ambitionbox", "Dislikes", "negative"),
}
SIDE_NAMES = list(SIDES)
ID_PREFIX = {"glassdoor": "gd", "ambitionbox": "am"}

# Raw column name of every common column, per platform.
DIALECTS = {
    "glassdoor": {
        "company": "Company",
        "rating": "Rating",
        "date": "Date",
        "job_title": "Job",
        "review_title": "Title",
        "employment_type": "Status",
        "location": "Location",
        "work_policy": "Work_Policy",
    },
    "ambitionbox": {
        "company": "Company",
        "rating": "Overall_Rating",
        "date": "Date",
        "job_title": "Job_Profile",
        "review_title": "Review_Title",
        "employment_type": "Employment_Type",
        "location": "Location",
        "work_policy": "Work_Policy",
    },
}
METADATA_COLUMNS = list(DIALECTS["glassdoor"])

# CSV cells that read as null.
NULL_CELLS = ["", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>",
              "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN"]

# Text-column and keyword-column names, in order of preference.
TEXT_COLUMNS = ["review_text", "Pros", "Cons", "Likes", "Dislikes", "review", "Review",
                "phrase", "text", "Text"]
KEYWORD_COLUMNS = ["keyword", "term", "words", "phrase"]

# Categories in order, with their seed phrases.
BASE_SEEDS = {
    "workplace_environment_culture_relationships": [
        "community", "co-worker", "culture", "workplace environment", "collaboration",
        "friendly", "atmosphere"],
    "economic_psychological_benefits": [
        "work-life balance", "wellbeing", "monetary benefits", "goodies"],
    "job_satisfaction": ["meaningful work", "job satisfaction", "gratification"],
    "justice": ["fair", "justice", "just"],
    "employee_brand_identification": ["feel like family", "we", "our", "second home"],
    "brand_reputation": ["great brand", "respected brand", "valued brand", "good brand name"],
    "product_belief": ["products", "quality"],
    "employee_brand_love": ["love", "like", "passionate"],
    "inner_self_expressive_brands": ["share my belief", "values align with", "my personality"],
    "brand_authenticity": ["genuine", "honest", "transparency", "trust", "accountability",
                           "authentic"],
    "social_self_expressive_brands": ["feel important", "people think", "tell people"],
}
CATEGORIES = list(BASE_SEEDS)
BASE_SOURCE = "category_keyword_extension_seed"
EXPANSION_SOURCE = "keyword_embedding_similarity"

# Categories whose scores sum to the HR score, current and older rule.
HR_CATEGORIES = [
    "economic_psychological_benefits",
    "workplace_environment_culture_relationships",
    "job_satisfaction",
    "justice",
    "employee_brand_identification",
]
OLDER_HR_CATEGORIES = [
    "workplace_environment_culture_relationships",
    "economic_psychological_benefits",
]

# Phrases that signal an HR topic.
HR_SIGNALS = ["human resources", "recruitment", "hiring", "interview", "onboarding", "payroll",
              "notice period", "resignation", "termination", "layoff", "HR policy"]

# Thresholds, caps and block weights.
EMBEDDING_THRESHOLD = 0.50
TFIDF_THRESHOLD = 0.10
OLDER_THRESHOLD = 0.50
SEED_THRESHOLD = 0.60
SEED_TOP_N = 250
OLDER_SEED_TOP_N = 100
KEYWORD_MAX_FEATURES = 2500
KEYWORD_MIN_DF = 2
KEYWORD_NGRAM_MAX = 3
BLOCK_WEIGHTS = (0.60, 0.25, 0.15)
RESOLUTIONS = [0.8, 1.0, 1.2, 1.4, 1.6]
MODEL_ID = "sentence-transformers/all-MiniLM-L6-v2"


def english_stop_words() -> list[str]:
    """The public 318-word English stop list, the default of every ``stop_words`` parameter."""
    text = resources.files("reviewloom.resources").joinpath("stop_words_english.txt").read_text()
    return text.split()
