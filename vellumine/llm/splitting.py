"""Splitting oversized chunks at natural boundaries, with balanced targets.

The least number of pieces is computed from both limits, targets of equal length are placed, and each is snapped to the
strongest boundary near it; while any piece still breaks a limit, a piece is added and the targets are placed anew.
Pieces are consecutive stretches of the text: joined, they give the text back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, functions as F

from .common import WHITE_SPACE, map_batches

MAX_WORDS, MAX_CHARS, OVERLAP = 400, 3200, 160
_SPACE = "[" + re.escape(WHITE_SPACE) + "]"
_WORD = re.compile("[^" + re.escape(WHITE_SPACE) + "]+")
_RUN = re.compile(_SPACE + "+")
_SENTENCE_END = re.compile(r"[.!?…。！？।؟]['\")\]»”’」』）]*$")
_JOINERS = "\u200c\u200d\u2060"
#: Marks of scripts that put no space behind them: ends of sentences, and of clauses.
_TIGHT = ((re.compile(r"[。！？।؟][」』”）]*"), 3), (re.compile(r"[，；：、؛،]"), 4))


def _cuts(text: str) -> tuple[list[int], list[int]]:
    """Places between which a text may be cut, with their rank: 0 before a heading, then a blank line, a line of its own
    (item, row, heading), a sentence's end, a clause's end, a word's end."""
    rank: dict[int, int] = {}
    for m in _RUN.finditer(text):
        a, b = m.span()
        if not 0 < b < len(text):
            continue
        breaks = m.group().count("\n")
        if breaks > 1:
            rank[b] = 0 if text[b] == "#" else 1
        elif breaks and text[b] in "-|#":
            rank[b] = 2
        elif _SENTENCE_END.search(text[max(0, a - 6) : a]):
            rank[b] = 3
        else:
            rank[b] = 4 if text[a - 1 : a] in (",", ";", ":", "–", "—") else 5
    for pattern, r in _TIGHT:
        for m in pattern.finditer(text):
            if m.end() < len(text) and text[m.end()] not in WHITE_SPACE:
                rank.setdefault(m.end(), r)
    places = sorted(rank)
    return places, [rank[p] for p in places]


def split_points(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> list[int]:
    """Ends of the pieces; one, the text's length, where nothing is over a limit."""
    words = [m.start() for m in _WORD.finditer(text)]
    n = len(text)
    pieces = max(1, -(-n // max_chars), -(-len(words) // max_words))
    if pieces == 1:
        return [n]
    places, ranks = _cuts(text)
    # a word counts to the piece in which it begins or, cut, in which it goes on
    count = lambda a, b: bisect_left(words, b) - bisect_left(words, a) + (a > 0 and a < n and text[a] not in WHITE_SPACE and text[a - 1] not in WHITE_SPACE)
    fits = lambda a, b: b - a <= max_chars and count(a, b) <= max_words

    def furthest(a: int) -> int:
        """The furthest end that a piece from a may have."""
        end = min(n, a + max_chars)
        w = bisect_left(words, a) + max_words - (count(a, a + 1) - (bisect_left(words, a + 1) - bisect_left(words, a)) if a < n else 0)
        return min(end, words[w]) if w < len(words) else end

    while pieces <= n:
        ends, at = [], 0
        for i in range(1, pieces):
            left = pieces - i + 1
            target = at + (n - at) // left
            reach = furthest(at)
            # the rest must still fit into the pieces that are left
            low = max(at + 1, target - (target - at) // 2, n - (left - 1) * max_chars)
            high = min(reach, target + (n - at) // (2 * left))
            if low > reach:
                break
            if low > high:
                high = reach
            k, m = bisect_left(places, low), bisect_right(places, high)
            if k < m:
                cut = places[min(range(k, m), key=lambda j: (ranks[j], abs(places[j] - target)))]
            else:
                cut = max(low, min(target, high))
                while cut > low and unicodedata.category(text[cut])[0] == "M" or cut > low and text[cut] in _JOINERS:
                    cut -= 1  # marks stay with their letter
            ends.append(cut)
            at = cut
        else:
            ends.append(n)
            if all(fits(a, b) for a, b in zip([0, *ends], ends)):
                return ends
        pieces += 1
    return list(range(1, n + 1))


def overlap_tail(text: str, end: int, overlap: int) -> str:
    """The last ``overlap`` characters before ``end``, begun at a word where there is one."""
    start = max(0, end - overlap)
    if start and text[start - 1] not in WHITE_SPACE:
        m = _RUN.search(text, start, end)
        if m and m.end() < end and text[m.end() : end].strip(WHITE_SPACE):
            start = m.end()
    return text[start:end].strip(WHITE_SPACE)


def _shares(text: str, ends: list[int], indices: list[int] | None, elements: list[int | None] | None) -> list[list[int] | None]:
    """Each piece's part of ``para_indices``: those of the blocks it touches."""
    if indices is None:
        return [None] * len(ends)
    blocks, at = [], 0
    for m in [*(m for m in _RUN.finditer(text) if m.group().count("\n") > 1), None]:
        stop = m.start() if m else len(text)
        if text[at:stop].strip(WHITE_SPACE):
            blocks.append((at, stop))
        at = m.end() if m else stop
    tables = [text[a:b].lstrip(WHITE_SPACE).startswith("|") for a, b in blocks]
    numbers: list[int | None]
    if elements is not None and len(elements) == len(blocks) and any(e is not None for e in elements):
        known = set(indices)
        numbers = [e if e in known else None for e in elements]
    elif len(indices) == len(blocks) - sum(tables):
        rest = iter(indices)
        numbers = [None if t else next(rest) for t in tables]
    else:  # gaps that nothing explains: in proportion to the blocks
        out: list[list[int] | None] = []
        for a, b in zip([0, *ends], ends):
            i, j = len(indices) * a // max(1, len(text)), -(-len(indices) * b // max(1, len(text)))
            out.append(indices[i:j])
        return out
    return [[x for x, (s, e) in zip(numbers, blocks) if x is not None and s < b and e > a] for a, b in zip([0, *ends], ends)]


def split_chunks(chunks: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk over a limit.

    Columns: ``chunk_uid, doc_id, chunk_id, piece`` (0-based), ``pieces``, ``start_pos``, ``end_pos``, ``text``,
    ``word_count``, ``prev_context_tail`` (the first piece keeps the chunk's own), ``para_indices``.
    Null texts and texts within the limits give no rows. Rows repeated under one ``chunk_uid`` give one set of pieces,
    rows without one are split each. A text without any boundary is cut by length, before no combining mark if it can be. Null ``para_indices`` stay null; other columns are ignored.
    """
    # only texts that may be over a limit reach Python; 400 words need 799 characters
    over = (F.char_length("text") > max_chars) | ((F.char_length("text") >= 2 * max_words) & (F.regexp_count("text", F.lit("[^\\p{IsWhite_Space}]+")) > max_words))
    columns = set(chunks.columns)
    have = lambda name, kind: F.col(name) if name in columns else F.lit(None).cast(kind)
    kept = chunks.where(over).select("chunk_uid", have("doc_id", "bigint").alias("doc_id"), have("chunk_id", "int").alias("chunk_id"), "text", have("prev_context_tail", "string").alias("tail"), have("para_indices", "array<int>").alias("para_indices"), (F.col("elements.para_idx") if "elements" in columns else F.lit(None)).cast("array<int>").alias("elements"))
    kept = kept.withColumn("row", F.when(F.col("chunk_uid").isNull(), F.monotonically_increasing_id())).dropDuplicates(["chunk_uid", "row"]).drop("row")

    def make():
        def split(uids, docs, ids, texts, tails, indices, elements):
            out: list[list] = [[] for _ in range(11)]
            for uid, doc, cid, text, tail, idx, els in zip(uids, docs, ids, texts, tails, indices, elements):
                ends = split_points(text, max_words, max_chars)
                shares = _shares(text, ends, idx, els)
                for i, (a, b) in enumerate(zip([0, *ends], ends)):
                    piece = text[a:b]
                    before = tail if i == 0 else overlap_tail(text, a, overlap)
                    for c, v in zip(out, (uid, doc, cid, i, len(ends), a, b, piece, len(_WORD.findall(piece)), before, shares[i])):
                        c.append(v)
            return out

        return split

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return map_batches(kept, make, f"chunk_uid {kinds['chunk_uid']}, doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, piece int, pieces int, start_pos int, end_pos int, text string, word_count int, prev_context_tail string, para_indices array<int>")
