"""Patterns and word lists shared by the operators.

Patterns avoid the parts in which regex engines differ: words, digits and white space are explicit Unicode classes, and
word boundaries are spelled out. ``B`` is such a boundary for the JVM.
"""

from __future__ import annotations

import re

#: Decimal digits of other scripts, and the plain ones in their order (fixed values).
DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९๐๑๒๓๔๕๖๗๘๙", "0123456789" * 5
#: White space as Python's ``str.split`` has it. The JVM tests the property far faster than a list of ranges.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
#: The same as ranges, for engines that lack the property.
WS_RANGES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same as a string of its signs.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
S, NS = f"[{WS}]", f"[^{WS}]"
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Code points that are taken out: single ones and ranges (fixed values).
INVISIBLES = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), 0xFEFF, (0xFE00, 0xFE0F), (0xFFF9, 0xFFFB))
TAGS = ((0xE0001, 0xE007F),)
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
# Spaces that become U+0020 (fixed values).
SPACES = (0x00A0, 0x1680, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)
# Punctuation that becomes plain (fixed values).
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"', "…": "..."}


def char_class(points) -> str:
    """A regex class of code points and ranges."""
    parts = (f"\\x{{{p:x}}}" if isinstance(p, int) else f"\\x{{{p[0]:x}}}-\\x{{{p[1]:x}}}" for p in points)
    return "[" + "".join(parts) + "]"


STRIP_CLASS = char_class((*INVISIBLES, *TAGS, *PRIVATE))
TAG_CLASS, PRIVATE_CLASS, SPACE_CLASS = char_class(TAGS), char_class(PRIVATE), char_class(SPACES)

# Word lists of the style audit, in their order (fixed values).
TRANSITIONS = ("furthermore", "moreover", "in conclusion", "in summary", "overall", "additionally", "notably", "consequently", "importantly", "as a result", "it is worth noting", "it is important to note", "it is crucial to consider", "in today's evolving landscape", "in today's fast-paced world", "in today's society", "to sum up")
BUZZWORDS = ("delve", "delves", "delving", "tapestry", "testament", "beacon", "pivotal", "crucial", "foster", "fostering", "fosters", "underscore", "underscores", "underscoring", "vibrant", "interwoven", "intertwined", "paradigm", "synergy", "synergies", "enduring", "intricate", "intricacies", "interplay", "meticulous", "meticulously", "robust", "showcase", "showcases", "showcasing", "garner", "garnered", "boast", "boasts", "bolster", "bolstered", "elevate", "elevates", "embrace", "embraces", "harness", "harnessing", "navigate", "navigating", "resonate", "resonates", "transcend", "transcends", "revolutionize", "unwavering", "multifaceted", "plethora", "myriad")
QUALIFIERS = ("serves as", "stands as", "functions as", "marks a pivotal moment", "represents a significant shift", "underscores the importance of", "reflects broader trends", "setting the stage for", "a testament to", "testament to human ingenuity")
# Patterns of tokens left behind by tools, in their order; case does not matter (fixed values).
LEAKS = (rf"turn{D}+search{D}+", r"contentReference\[[^\]\n]+\](?:\{[^}\n]+\})?", r"attributableIndex\[[^\]\n]+\](?:\{[^}\n]+\})?", r"oaicite:?\{?[^}\n]+\}?", rf"cite_turn{D}+", r"\[citation needed\]", "As an AI language model", "I cannot fulfill this request", "Here is a revised version:", "Certainly! Here is")
CONTRACTIONS = ("don't", "can't", "won't", "it's", "doesn't", "didn't", "hasn't", "haven't", "shouldn't", "wouldn't", "couldn't", "I'm", "we're", "you're", "they're")
PERSONS = ("I", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "we", "us", "our", "ours")
OPINIONS = ("I think", "I feel", "I believe", "in my opinion", "in our opinion")
PARTICIPLES = ("underscoring", "highlighting", "ensuring", "contributing", "reflecting", "fostering", "marking", "serving as")

# Section classes and their key words, in their order (fixed values).
SECTIONS = {
    "front_matter": ("certificate", "certificate of approval", "declaration", "approval sheet", "dedication", "acknowledgement", "acknowledgments", "acknowledgements", "table of contents", "contents", "list of figures", "list of tables", "list of abbreviations", "abbreviations", "acronyms", "nomenclature"),
    "abstract": ("abstract", "executive summary"),
    "introduction": ("introduction", "background", "motivation", "research problem"),
    "literature_review": ("literature review", "related work", "previous studies", "theoretical framework", "state of the art"),
    "methodology": ("methodology", "methods", "materials and methods", "experimental setup", "proposed framework", "model architecture", "data collection"),
    "results": ("results", "findings", "experimental results", "empirical analysis", "evaluation"),
    "discussion": ("discussion", "implications", "comparative analysis", "limitations"),
    "conclusion": ("conclusion", "conclusions", "concluding remarks", "summary", "future work"),
    "references": ("references", "bibliography", "works cited", "literature cited"),
}
PROTECTED = ("front_matter", "references")

# Labels of tiers, from highest to lowest (fixed values).
AUDIT_LEVELS = ("High AI Probability", "Moderate AI Signals", "Low AI Markers", "Clean / Human-like")
RISK_LEVELS = ("High Similarity / Verbatim Matching", "Moderate Risk / Partial Overlap", "Low Similarity / Minor Coincidence", "Clean / Highly Original", "Clean / 100% Original")

#: An optional number of a caption, and what may stand behind it.
# The forms of captions (fixed values).
_CAPTION_REST = rf"{S}*({D}+[a-zA-Z]?(?:[-.]{D}+)?)?{S}*[:.-]?{S}+([^\n]*)\n?$"
FIGURE_CAPTION = rf"(?iu)^{S}*(?:figure|fig\.?){_CAPTION_REST}"
TABLE_CAPTION = rf"(?iu)^{S}*(?:table|tbl\.?){_CAPTION_REST}"


def alternatives(words) -> str:
    """An alternation of literal words."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\'", "'").replace("\\-", "-") for w in words)


def whole(words) -> str:
    """Words of a list as whole words. They begin and end with letters, so looking one sign back and ahead is enough."""
    return f"(?<!{W})(?:{alternatives(words)})(?!{W})"
