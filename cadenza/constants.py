"""Fixed values that must equal the reference application's for equal results.

Everything in this module is data, not logic.  The lists are typed out in the
order the application states them, duplicates included, so that counts and
membership match exactly.
"""

from __future__ import annotations

# --- FIXED VALUES: theme (word-cloud) stop list of the online job -----------
# 172 entries, 168 distinct ("when", "where", "why", "how" appear twice).
THEME_STOPWORDS_LISTED = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "need",
    "dare", "ought", "used", "it", "its", "it's", "this", "that", "these",
    "those", "i", "me", "my", "myself", "we", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "when", "where",
    "why", "how", "all", "each", "every", "both", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "just", "im", "i'm", "dont", "don't",
    "got", "get", "like", "know", "yeah", "oh", "uh", "ah", "na", "la",
    "da", "gonna", "wanna", "gotta", "cause", "'cause", "cuz", "let",
    "say", "see", "come", "go", "make", "take", "one", "two", "now",
    "up", "out", "if", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how",
    "any", "as", "back", "way", "right", "still", "well", "also",
    "verse", "chorus", "bridge", "intro", "outro", "hook", "pre",
)

# --- FIXED VALUES: custom stop words of the offline job ----------------------
# 31 entries, 30 distinct ("cant" twice).  Unioned with a general English list.
CUSTOM_STOPWORDS_LISTED = (
    "like", "got", "dont", "aint", "im", "want", "youre", "oh", "let", "ill",
    "get", "cant", "make", "know", "come", "cant", "go", "said", "could", "wan", "na",
    "gon", "see", "yeah", "doo", "ooh", "la", "da", "back", "time", "cause",
)

# --- FIXED VALUES: strings a pandas CSV read turns into null (pandas defaults)
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- FIXED VALUES: encoder registry (id, display name, dimensions) -----------
MODEL_REGISTRY = (
    ("all-MiniLM-L6-v2", "MiniLM (Fast)", 384),
    ("all-mpnet-base-v2", "MPNet (Balanced)", 768),
    ("bert-base-nli-mean-tokens", "BERT NLI (Original)", 768),
)
DEFAULT_MODEL = "all-MiniLM-L6-v2"

# --- FIXED VALUES: messages of rejected requests, form sentinel --------------
TOO_SHORT_MESSAGE = "Please enter at least {} characters of lyrics"
MISSING_FIELDS_MESSAGE = "Please provide both song name and artist name"
NOT_FOUND_MESSAGE = 'Could not find lyrics for "%s" by %s'
NO_INPUT = "None"
UNKNOWN_NAME = "Unknown"    # a song without title or artist

# --- FIXED VALUES: run parameters -------------------------------------------
DEFAULT_SAMPLES = 500
SAMPLES_FLOOR = 100
SAMPLES_CAP = 5000          # the application's single-machine cap; optional here
DEFAULT_CLUSTERS = 4
CLUSTERS_MIN = 2
CLUSTERS_MAX = 15
SEED = 42
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
MIN_CORPUS_CHARS = 50       # keep texts strictly longer than this
MIN_REQUEST_CHARS = 10      # stripped request text must have at least this many
MIN_THEME_CHARS = 10        # cleaned cluster text shorter than this gets no terms
PLAYLIST_SIZE = 20
ENRICHED_ROWS = 10
THEME_TERMS = 100           # online job; offline job uses the generator default 200
OFFLINE_TERMS = 200
SAMPLE_SONGS_PER_CARD = 5
THROTTLE_DELTA = 5.0        # progress points
STREAM_TIMEOUT_SECONDS = 300
TERMINAL_STEP = "purchase"  # test-data binding of the terminal (result) record
TRACK_URL_PREFIX = "/track/"    # prefix of the track link built from a catalogue id


def theme_stopwords() -> list[str]:
    """Distinct theme stop words, first-occurrence order."""
    return list(dict.fromkeys(THEME_STOPWORDS_LISTED))


def custom_stopwords() -> list[str]:
    return list(dict.fromkeys(CUSTOM_STOPWORDS_LISTED))
