"""Edit-type taxonomy: the type dimension, rule tables and word sets.

Everything under "Fixed values" must stay exactly as written: type ids are
positions in ``TYPE_NAMES`` and stored data refers to them, so names are only
ever appended (see ``check_taxonomy_append_only``).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's taxonomy; order is meaningful)
# ---------------------------------------------------------------------------

NULL_TYPE_NAME = "null"

SYNTHETIC_TYPES = [
    "black_and_white", "sepia_vintage", "brighter", "darker", "more_colorful",
    "less_colorful", "blur_background", "sharper", "warmer", "cooler",
    "inverted", "high_contrast", "low_contrast",
]

# (type, needles): first rule with any needle contained in the lower-cased
# prompt wins.
REAL_RULES = [
    ("painting", ["painting", "oil paint", "watercolor", "watercolour",
                  "impressionist", "van gogh", "monet", "picasso"]),
    ("rain_storm", ["rain", "storm", "thunder", "lightning"]),
    ("snow_winter", ["snow", "winter", "blizzard", "frozen", "icy", "frost"]),
    ("cartoon_anime", ["cartoon", "anime", "comic", "cel shad", "pixar"]),
    ("desert", ["desert", "sand dune", "sahara", "arid"]),
    ("fire_lava", ["fire", "flames", "burning", "lava", "volcanic"]),
    ("night", ["night", "midnight", "dark sky", "moonlit", "starry"]),
    ("sunset_sunrise", ["sunset", "sunrise", "golden hour", "dusk", "dawn"]),
    ("space_scifi", ["space", "galaxy", "nebula", "sci-fi", "futuristic",
                     "cyberpunk", "neon"]),
    ("drawing_sketch", ["sketch", "pencil drawing", "charcoal", "line drawing",
                        "woodcut", "ink drawing"]),
]

# (type, words): scanning the instruction's words from the end, the first word
# listed here decides the type.
TUNE_RULES = [
    ("season_winter", ["winter"]),
    ("weather_snow", ["snow", "snowy"]),
    ("season_autumn", ["autumn", "fall"]),
    ("time_night", ["night", "midnight", "nighttime"]),
    ("time_evening", ["evening", "dusk", "sunset"]),
    ("weather_storm", ["storm", "stormy", "thunderstorm"]),
    ("weather_fog", ["fog", "foggy", "mist", "misty"]),
    ("season_summer", ["summer"]),
]

# Corpus edit types that are used as a type unchanged.
WHOLE_TYPES = ["style_change", "background_change"]

# Objects that have their own `add_<object>` type.
ADD_OBJECTS = [
    "ball", "bouquet", "cup", "balloon", "seagull", "butterfly", "book", "vase",
    "sailboat", "bird", "basket", "glass", "cat", "dog", "guitar", "slice",
    "bear", "flower", "tree", "candle", "fish", "cake", "hat", "banner",
    "performer", "chef", "bookshelf", "surfboard", "farmer", "ribbon",
]

# Verbs that open an add instruction, and the optional article after them.
ADD_VERBS = ["add", "include", "put", "place", "insert"]
ADD_ARTICLES = ["a", "an", "the", "some"]

# Whole words that end the object phrase of an add instruction.
ADD_BOUNDARY_WORDS = [
    "on", "in", "at", "next", "between", "near", "under", "with", "behind",
    "over", "of", "to", "from", "beside", "against", "around", "inside",
    "outside", "beneath", "above", "below", "along", "across", "onto", "into",
    "nearby", "overhead", "out", "off", "up", "down", "away", "there", "here",
    "taking", "holding", "standing", "eating", "lying", "preparing", "watching",
    "sitting", "walking", "playing", "wearing", "hanging", "floating",
    "resting", "leaning", "flying", "perched", "waving", "waiting", "swimming",
    "running", "jumping", "reading", "riding", "carrying", "looking",
    "smiling", "tied", "placed", "parked", "seated", "attached", "surrounded",
    "covered", "filled",
]

# Trailing words that are never the object itself.
NOT_AN_OBJECT = [
    "nearby", "overhead", "out", "above", "below", "here", "there", "away",
    "flying", "perched", "waving", "waiting", "swimming", "running", "tied",
    "placed", "parked", "seated", "attached", "left", "right", "top", "bottom",
    "side", "front", "back", "middle", "corner", "area", "background",
    "foreground", "scene", "image", "picture", "photo", "one", "two", "some",
    "more", "another", "other", "same", "new", "few", "several", "many",
    "shining", "hovering", "standing", "sitting", "large", "small", "big",
    "little", "sky",
]

# Stop words of the unmatched-word profile.
PROFILE_STOP_WORDS = [
    "the", "a", "an", "it", "into", "to", "of", "in", "on", "with", "and",
    "make", "turn", "have", "his", "her", "their", "as", "is", "be", "let",
    "add", "change", "give", "put", "this", "that", "for", "at", "by",
]
# Characters stripped from both ends of a profile word.
PROFILE_STRIP_CHARS = ".,!?\"'"

# Earlier head-noun patterns (searched, not anchored), used by the profiles.
HEAD_V1_ADD_PATTERN = (r"\b(?:add|put|place|insert)\s+(?:a|an|some|the)?\s*"
                       r"([a-z]+(?:\s+[a-z]+)?)")
HEAD_V1_TUNE_PATTERN = (r"\b(?:to|make|change)\s+(?:the\s+)?"
                        r"(?:weather|season|time|day)?\s*(?:to\s+)?([a-z]+)\s*$")
ADDITION_PATTERN = (r"\b(?:add|put|give|place|insert)\s+(?:a|an|some|the)?\s*"
                    r"([a-z]+(?:\s+[a-z]+)?)")
ADDITION_TRAILING_PREPOSITIONS = ["on", "to", "in", "of", "with"]

# Thresholds and sizes used by the profiles and assembly.
OWN_TYPE_THRESHOLD = 1000
TRAINABLE_THRESHOLD = 400
MIN_TYPE_SUPPORT = 50

# ---------------------------------------------------------------------------
# Derived tables
# ---------------------------------------------------------------------------

REAL_TYPES = [name for name, _ in REAL_RULES]
TUNE_TYPES = [name for name, _ in TUNE_RULES]
ADD_TYPES = [f"add_{o}" for o in ADD_OBJECTS]

TYPE_NAMES = ([NULL_TYPE_NAME] + SYNTHETIC_TYPES + REAL_TYPES + TUNE_TYPES
              + WHOLE_TYPES + ADD_TYPES)
N_TYPES = len(TYPE_NAMES)
TYPE_ID = {name: i for i, name in enumerate(TYPE_NAMES)}

# The first taxonomy (before the corpus switch): ids 0..23.
TAXONOMY_V3 = [NULL_TYPE_NAME] + SYNTHETIC_TYPES + REAL_TYPES


def family_of(name: str) -> str:
    if name == NULL_TYPE_NAME:
        return "null"
    if name in SYNTHETIC_TYPES:
        return "synthetic"
    if name in REAL_TYPES:
        return "real"
    if name in TUNE_TYPES:
        return "tune"
    if name in WHOLE_TYPES:
        return "whole"
    return "add"


TYPE_ROWS = [(i, name, family_of(name)) for i, name in enumerate(TYPE_NAMES)]

# (prio, type, needle) in rule order: the rule table in long form. The
# lowest prio whose needle is contained in the prompt decides.
REAL_NEEDLES = [(name, needle) for name, needles in REAL_RULES for needle in needles]
REAL_NEEDLES = [(prio, name, needle) for prio, (name, needle) in enumerate(REAL_NEEDLES)]

TUNE_WORD_TO_TYPE = {w: name for name, words in TUNE_RULES for w in words}


def type_dimension(spark):
    """(type_id, name, family) as a DataFrame; 64 rows, safe to broadcast."""
    from .functions.literal import literal_table
    return literal_table(spark, TYPE_ROWS, "type_id bigint, name string, family string")
