"""Fixed values that decide the results: patterns, word lists and markers.

All patterns use syntax shared by Java and RE2, so the same text can be checked
in another engine.  ``\\s`` alone is not enough: Java's class leaves out the
separators 0x1C-0x1F and the Unicode spaces.
"""

SPACE_CLASS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACES = f"[{SPACE_CLASS}]+"
NON_SPACES = f"[^{SPACE_CLASS}]+"
URL = f"https?://[^{SPACE_CLASS}]+"

# The wide class is the union of the documented emoji ranges.  It runs through
# the CJK blocks, so kana, Han and Hangul go too; the narrow class keeps letters.
EMOJI_WIDE = r"[\x{24C2}-\x{10FFFF}\x{200D}\x{23CF}\x{23E9}\x{231A}]+"
EMOJI_NARROW = (
    r"[\x{24C2}-\x{2BFF}\x{3030}\x{FE0F}\x{1F000}-\x{1FAFF}"
    r"\x{200D}\x{23CF}\x{23E9}\x{231A}]+"
)

REMOVED_MARKERS = ("[removed]", "[deleted]")

ACCEPTED_LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "nl", "ru", "zh", "ja", "ko")

# Strings a CSV reader of posts takes as missing.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

TOKEN = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]+"
WORD = r"[\p{L}\p{M}]+"
NON_LETTERS = r"[^\p{L}\p{M}]+"
LETTERS_ONLY = r"^\p{L}+$"

# A label answer: the quoted form first, else the rest of the line.
LABEL = r': "([^\n]*?)"|: [^\n]*'
LABEL_QUOTED = r'^: "[^\n]*"$'

LINE_BREAK = "<br />"
WORDS_PER_BREAK = 20

TEXT_SEPARATOR = "\n"
