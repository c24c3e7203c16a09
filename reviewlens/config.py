"""Fixed values and tunable limits.

The first block holds values that must equal the ones the original review
scripts use, or the results would differ.  They are written out as text,
in their original order.  Everything below that block is an engine setting.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original scripts for equal results)
# ---------------------------------------------------------------------------

# Promotion patterns searched in the raw review text (Python regex dialect).
PROMO_PATTERNS = (
    r"五星\S*送\S*",
    r"5星\S*送\S*",
    r"打卡\S*送\S*",
    r"加入\S*活動\S*送\S*",
    r"加入\S*line\S*會員\S*送\S*",
)

# Relative-age units, tested in this order by containment:
# (unit text, days, hours, minutes) subtracted per counted unit.
RELATIVE_UNITS = (
    ("年前", 365, 0, 0),
    ("個月前", 30, 0, 0),
    ("週前", 7, 0, 0),
    ("天前", 1, 0, 0),
    ("小時前", 0, 1, 0),
    ("分鐘前", 0, 0, 1),
)

# Output format of a resolved review date.
REVIEW_DATE_FORMAT = "yyyy/MM/dd HH:mm"
# Format of the collection time stamp.
SCRAPE_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"

# Emoji and symbol code-point ranges removed from review text, in the
# original order (single code points are written as one-element ranges).
EMOJI_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x1F900, 0x1F9FF),
    (0x1F926, 0x1F937),
    (0x10000, 0x10FFFF),
    (0x200D, 0x200D),
    (0x2640, 0x2642),
    (0x2600, 0x2B55),
    (0x23CF, 0x23CF),
    (0x23E9, 0x23E9),
    (0x231A, 0x231A),
    (0xFE0F, 0xFE0F),
    (0x3030, 0x3030),
)

# Characters kept by the cleaner: the CJK unified ideographs block.
CJK_RANGE = (0x4E00, 0x9FA5)

# Reviews holding this notice are machine translations and are dropped.
TRANSLATION_MARKER = "由 Google 提供翻譯"

# Processed reviews equal to this token ("more") are dropped.
MORE_TOKEN = "更多"

# Seed phrases widened by neighbours for the feature label.
SEED_PHRASES = ("打卡 送", "評論 送", "五星 送", "加入會員 送", "活動 送", "line 送")

# Listing status meaning "temporarily closed".
CLOSED_STATUS = "暫停營業"

# Rating text decorations removed before the rating is parsed.
RATING_PREFIX = "評等："
RATING_SUFFIX = " (最高：5)，"
# Marker appended to the age text of the newest review.
NEWEST_SUFFIX = "\n最新"
# Review-count text suffix, e.g. "1,234 則評論".
REVIEW_COUNT_SUFFIX = " 則評論"

# Reviews read per restaurant: blocks of ten, at most six blocks.
REVIEWS_PER_BLOCK = 10
MAX_BLOCKS = 6

# Class names of a stored review page: a review's block and its fields.
REVIEW_CLASSES = {
    "block": "WMbnJf vY6njf",
    "reviewer": "TSUbDb",
    "count": "A503be",
    "rating": "lTi8oc z3HNkc",
    "age": "PuaHbe",
    "picture": "DQBZx",
    "body": "Jtu6Td",
    "full": "review-full-text",
}

# Phrase mining: minimum count and score threshold.
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0
PHRASE_DELIMITER = "_"

# Embedding training: dimensions, window, minimum count, epochs.
W2V_VECTOR_SIZE = 100
W2V_WINDOW = 5
W2V_MIN_COUNT = 5
W2V_EPOCHS = 50

# Neighbours taken per seed word.
NEIGHBOURS_PER_SEED = 5

# Train / test split: test share and seed.
TEST_FRACTION = 0.2
SPLIT_SEED = 42

# Random-forest grid searched by cross-validation (5 folds, accuracy).
RF_GRID = {
    "n_estimators": (10, 50, 100, 200),
    "max_depth": (None, 10, 20, 30),
    "min_samples_split": (2, 5, 10),
    "min_samples_leaf": (1, 2, 4),
}
RF_FOLDS = 5

# Number of top words reported by importance.
TOP_WORDS = 10

# ---------------------------------------------------------------------------
# Engine settings (not from the original scripts)
# ---------------------------------------------------------------------------

# Python's str.split() / \s whitespace, written as a class both Java regex
# and RE2 read the same way (Java's \s lacks the Unicode spaces, RE2's
# lacks \x0B).
PY_SPACE_CLASS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
