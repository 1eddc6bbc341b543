"""Lexicons that fit the words of the test tables (the default one hits none of them)."""

from tonelens.operators.lexicon import Lexicon

DOCUMENTS = Lexicon(
    patterns={
        "Gaslighting": [r"\bidiot\b", r"\bmoron\b", r"\bstupid\s+(the|and|of|in)\b", r"\b(pathetic|worthless)\b"],
        "Passive-Aggressive": [
            r"\bclown\b", r"\b(trash|scum)\b", r"\bloser\b", r"\bthat (is|was) the\b", r"\bthe (ing|tion) (is|of|and)\b",
        ],
        "Sarcastic": [r"\bdisgusting\b", r"\b(so\s+)?pathetic\b", r"\bof (the|that) (the|that)\b"],
    },
    keywords={
        "Gaslighting": ["idiot", "moron", "stupid"],
        "Passive-Aggressive": ["clown", "trash ", "that the"],
        "Sarcastic": ["scum", "loser", "was to"],
        "Sincere": ["and the", "que la", "und der", "tion is"],
    },
)

CONVERSATIONS = Lexicon(
    patterns={
        "Gaslighting": [
            r"\bthat (the|of|is)\b", r"\bthere(ed|ing)\b", r"\bof the\b", r"\sque (la|le|de)\s",
            r"\bund (die|der)\b", r"\bis (in|to)\b", r"\bto be\b",
        ],
        "Passive-Aggressive": [
            r"\bwith (the|that)\b", r"\bfor (the|of)\b", r"\bby (of|the|that)\b", r"\sde (la|les)\s", r"\bin (the|of)\b",
        ],
        "Sarcastic": [r"\bfrom (the|of)\b", r"\bon (the|of)\b", r"\b(so\s+)?as (the|of)\b"],
    },
    keywords={
        "Gaslighting": ["tion of", "und die"],
        "Passive-Aggressive": ["and of", "de la", "ed in"],
        "Sarcastic": ["was the", "les de", "ed the"],
        "Sincere": ["and the", "que le", "ing", "ung"],
    },
)

#: label -> (reassurance, strategies, answers): a table of the queries' own.
GUIDANCE = {
    "Gaslighting": ("Trust your notes.", ["Write it down", "Ask a friend"], ["I saw it differently."]),
    "Passive-Aggressive": ("Ask what is meant.", ["Ask once", "Stay calm"], ["Say it plainly, please."]),
    "Sarcastic": ("Look for the real point.", ["Skip the jab"], ["What do you want to say?"]),
    "Sincere": ("Nothing to do.", ["Answer openly"], ["Thanks."]),
}

#: Frequent short words of the four languages, left out of the n-gram reports.
STOP_WORDS = [
    "the", "of", "and", "in", "to", "is", "that", "on", "was", "for", "it", "be", "as", "by", "with", "from", "an",
    "this", "are", "at", "or", "de", "la", "que", "le", "les", "et", "en", "un", "une", "el", "los", "del", "se", "no",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "auf", "ist",
]
