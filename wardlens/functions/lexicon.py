"""Word lists, patterns and constants that the results depend on."""

from __future__ import annotations

import unicodedata

# --- fixed values ------------------------------------------------------------------------------------------

# The 179-word English stop list.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()

# Words the embedding clean drops on top of the stop list.
NON_ESSENTIAL_WORDS = ["admission", "date", "service", "birth", "also"]

# Clinical headers and phrases: (pattern, replacement), applied in this order to lower-cased text.
CLINICAL_SUBSTITUTIONS = [
    ("admission date:", ""),
    ("discharge date:", ""),
    ("date of birth:", ""),
    ("service:", ""),
    ("sex:", ""),
    ("admission", ""),
    ("allergies:", ""),
    ("attending:", ""),
    ("chief complaint:", ""),
    ("major surgical or invasive procedure:", "procedure"),
    (r"\?\?\?\?\?\?", ""),
    ("discharge medications:", "medications"),
    ("discharge disposition:", "disposition"),
    ("discharge", ""),
    ("completed by:", ""),
    (r"\[([^\n]*?)\]", ""),
    (r"[^\x00-\x7F]+", ""),
    ("--|__|==", ""),
    ("also", ""),
]

# Keywords whose sentences move to the front of an augmented document.
SENTENCE_KEYWORDS = """
disp aortic refill status hospital unit blood sig stable pain valve congestive pressure day medication normal
patient release drug possible history rhythm renal lasix sob discharge head daily admitted post tablet heart
mellitus ventricular right artery trauma hypertension admission needed left disease coumadin glucose rehab aspirin
transferred nausea
""".split()

# ASCII punctuation, and the same without the full stop.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION_KEEP_STOP = PUNCTUATION.replace(".", "")

# Noun endings and what they become, tried against a vocabulary.
NOUN_SUFFIXES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# Parts of speech in the order that wins ties.
POS_ORDER = ["n", "v", "a", "r"]

# The date that stands for "no date found".
MISSING_DATE = "1999-01-01"

# --- patterns, in the syntax of both Java and RE2 ----------------------------------------------------------

# the characters a whitespace split breaks on, ASCII and beyond
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE_CLASS}]+"

# a word: letters, digits and underscore in any script
WORD = r"[\p{L}\p{N}_]+"
WORD_2 = r"[\p{L}\p{N}_]{2,}"

# words and single punctuation marks
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE_CLASS}]"

# a sentence: a run of text with the marks that end it
SENTENCE = r"[^.!?]+[.!?]*"


def accent_table() -> tuple[str, str, str]:
    """(from, to, dropped) for accent stripping, from the Unicode decompositions of one-letter results.

    Covers Latin, Greek and Cyrillic letters; ``dropped`` are the combining marks themselves.
    """
    source, target = [], []
    for block in (range(0x00C0, 0x0530), range(0x1E00, 0x2000)):
        for code in block:
            char = chr(code)
            bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if char.isalpha() and len(bare) == 1 and bare != char:
                source.append(char)
                target.append(bare)
    marks = [chr(code) for code in range(0x0300, 0x0370) if unicodedata.combining(chr(code))]
    return "".join(source), "".join(target), "".join(marks)
