"""Per-document text quality statistics and a verdict: prose, list, table or junk.

The texts of a batch are one array of code points: words, symbols, marks, lines and blocks are counted over it by array
operations, and line patterns by Arrow's kernels, so no text is looked at by itself. Fixed thresholds, published ones
where there are such (``RULES``), give the reason for each failure. Lines are told apart as items, rows and running text;
a document more than half of whose characters lie in items is a list, in rows a table, and one that fails the readability
rules is junk.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .languages import script_table, STOPS, stop_masks
from .spans import _mix, _Powers

BULLET = r"[-*•‣◦▪▫■□●○·∙→»➤✓–]"
_CLOSED = re.compile(r"[.!?…。！？।؟:：]['\"”’“»」』）)\]]*\s*$")
_STOP = re.compile(r"[。！？।]|[.!?](?:\s|$)\s*\S")


def _wrapped(lines: list[str]) -> bool:
    """Whether lines are one text wrapped at a width: no line could have taken the next one's first word."""
    width = max(map(len, lines))
    fits = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:]))
    return fits >= 0.9 * (len(lines) - 1)


#: Patterns of lines, for Arrow's kernels.
_S = r"[\s\p{Z}]"
ITEM = rf"^{_S}*(?:{BULLET}{_S}+\S|\(?(?:\d{{1,3}}|[ivxlc]{{1,6}}|[a-zа-я])[.)]{_S}+\S|\(?(?:[IVXLC]{{2,6}}[.)]|[A-ZА-Я]\)){_S}+\S|\(?\d{{1,3}}[）、．]{_S}*\S|\[\d{{1,4}}\]{_S}+\S|\d{{1,2}}(?:\.\d{{1,2}}){{1,3}}\.?{_S}+\S|[①-⑳]{_S}*\S)"
LEADER = rf"(?:\.{_S}?){{4,}}{_S}*\d*{_S}*$|…{{2,}}{_S}*\d+{_S}*$"
GLOSS = rf"^{_S}*[^\s:：.!?;,|][^:：.!?;|]{{0,40}}(?::|：|{_S}[–—=]){_S}+\S"
ENTRY = rf"^{_S}*\p{{L}}[\p{{L}}\p{{N}}'’_-]*,{_S}*\p{{L}}\.[^\n]*?\((?:19|20)\d\d[a-z]?\)"
CLOSED = rf"[.!?…。！？।؟:：]['\"”’“»」』）)\]]*{_S}*$"
PAIR = rf"^{_S}*\S.{{0,40}}?{_S}?[=:]{_S}?[-+−]?\d[\d.,]*(?:{_S}?[%°\p{{L}}\d_]{{1,4}})?{_S}*$"
NUMBERS = rf"^{_S}*(?:[-+−±]?\d[\d.,]*%?|n/a|±|-|NA|NaN)(?:{_S}+(?:[-+−±]?\d[\d.,]*%?|n/a|±|-|NA|NaN))+{_S}*$"
GAP = r"\S {3,}\S"
TAG = r"</?[a-zA-Z][^<>]{0,300}>|&[a-z]{2,8};|&#\d+;"

#: Ratios over words are asked only of texts that have as many running words.
MIN_WORDS = 15
#: Repetition is asked only of texts with as many words, and as many lines.
MIN_REPEATED_WORDS, MIN_REPEATED_LINES = 10, 8
#: Closing marks a word, from which on a text is taken to have sentences.
MIN_CLOSINGS = 1 / 60
RULES = {  # name: (statistic, least, most, where the rule comes from); None leaves an end open
    "too few words": ("words", 1, None, "own: any word at all, as short prose counts"),
    "mean word length": ("mean_word_length", 3.0, 10.0, "Rae et al. 2021 (Gopher): 3 to 10"),
    "words with letters": ("letter_word_ratio", 0.8, None, "Rae et al. 2021 (Gopher): at least 80 %"),
    "hashes and ellipses": ("hash_ellipsis_ratio", None, 0.1, "Rae et al. 2021 (Gopher): at most 0.1 a word"),
    "repeated lines": ("repeated_line_ratio", None, 0.3, "Rae et al. 2021 (Gopher): at most 30 % duplicate lines"),
    "common words": ("common_ratio", 0.11, None, "Laurençon et al. 2022 (ROOTS): closed-class words by language; cutoff own"),
    "no vowels": ("vowelless_ratio", None, 0.5, "own: words of three letters and more"),
    "symbols": ("symbol_ratio", None, 0.3, "own"),
    "markup": ("markup_ratio", None, 0.3, "own"),
    "mojibake": ("mojibake_ratio", None, 0.04, "own"),
    "odd words": ("odd_ratio", None, 0.12, "own"),
    "one word": ("top_word_ratio", None, 0.5, "own"),
    "encoded data": ("encoded_ratio", None, 0.5, "own"),
}
#: Failing one of these is junk whatever the lines are.
HARD = {"markup", "mojibake", "encoded data", "one word", "repeated lines", "no letters or digits"}


# Properties of characters, a bit each.
SPACE, LETTER, DIGIT, UPPER, LOW, MARK, JOINER, STRANGE, POINT, HEXA, BASE, BASE_URL, LIST_MARK, WIDE_COMMA, LEAD, TRAIL, UNSPACED, LISTED, BREAK, TAB, HASH, ELLIPSIS, DOT, CONTROL, LOST, A_HAT, VOWEL, TERM = (1 << k for k in range(28))


class _Tables:
    """Properties of characters of the basic plane, as tables; made once a worker."""

    made: _Tables | None = None

    def __init__(self) -> None:
        chars = [chr(i) for i in range(0x10000)]
        bits = np.zeros(0x10000, dtype=np.uint32)

        def put(bit, flags) -> None:
            bits[np.asarray(flags, dtype=bool)] |= np.uint32(bit)

        of = lambda s: np.isin(np.arange(0x10000), [ord(c) for c in s])
        between = lambda *ranges: np.any([(np.arange(0x10000) >= a) & (np.arange(0x10000) < b) for a, b in ranges], axis=0)
        letter = np.array([c.isalpha() for c in chars])
        put(SPACE, [c.isspace() for c in chars])
        put(LETTER, letter)
        put(DIGIT, [c.isdigit() for c in chars])
        put(UPPER, between((0x41, 0x5B)))
        put(LOW, between((0x61, 0x7B), (0xE0, 0x100)))
        put(MARK, between((0x300, 0x370), (0x900, 0x904), (0x93A, 0x950), (0xE31, 0xE32), (0xE34, 0xE3B), (0xE47, 0xE4F)) & ~letter)
        base = np.array([c.isascii() and (c.isalnum() or c in "+/=") for c in chars])
        put(BASE, base)
        put(BASE_URL, base | of("_-"))
        put(LEAD, between((0xC3, 0xF5)))
        put(TRAIL, of("€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ") | between((0x80, 0xC0)))
        put(CONTROL, between((0x80, 0xA0)))
        for bit, marks in ((JOINER, "'’-"), (STRANGE, "~^|\\{}@"), (POINT, ",.;:!?%)"), (HEXA, "0123456789abcdefABCDEF"), (LIST_MARK, ";；、·•"), (WIDE_COMMA, "，"), (BREAK, "\n"), (TAB, "\t"), (HASH, "#"), (ELLIPSIS, "…"), (DOT, "."), (LOST, "�"), (A_HAT, "Â"), (TERM, ".!?…؟۔।")):
            put(bit, of(marks))
        script = script_table()
        # vowel letters of the Latin script, with all their marks; letters of other scripts count as such
        put(VOWEL, [unicodedata.normalize("NFD", c)[0].lower() in "aeiouyæœøıə" for c in chars] | (letter & (script != 1)))
        put(UNSPACED, (script == 6) | (script >= 8))
        put(LISTED, (script >= 1) & (script <= 5))  # scripts of the languages that have lists
        self.bits = bits
        with np.errstate(over="ignore"):
            self.mixed = _mix(np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint64) + np.uint64(11))

    @classmethod
    def of(cls) -> _Tables:
        cls.made = cls.made or cls()
        return cls.made


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    if inside[-1]:
        edges = np.append(edges, len(inside))
    return edges[::2], edges[1::2]


def _counts(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the places, which rise, lie between each two bounds."""
    return np.diff(np.searchsorted(places, bounds))


def _repeats(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner: how many different keys it has, how often the most frequent comes, and how many come again."""
    most, different = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not len(key):
        return different, most, most.copy()
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    first = np.nonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]))[0]
    counts = np.diff(np.append(first, len(o)))
    np.maximum.at(most, o[first], counts)
    different = np.bincount(o[first], minlength=n)
    return different, most, np.bincount(owner, minlength=n) - different


class Batch:
    """Figures of a batch of texts."""

    def __init__(self, texts: list[str]):
        t, n = _Tables.of(), len(texts)
        self.n = n
        sum_ = lambda who, what=None: np.bincount(who, weights=what, minlength=n)
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = np.minimum(codes, 0xFFFF).astype(np.intp)
        bits = t.bits[small]
        if (codes > 0xFFFF).any():
            bits[codes > 0xFFFF] = LETTER
        has = lambda bit: (bits & np.uint32(bit)) != 0
        spots = lambda bit: np.flatnonzero(bits & np.uint32(bit))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        docs = np.concatenate([[0], np.cumsum(sizes + 1)])  # where each begins
        in_doc = lambda places: _counts(places, docs)
        ends = spots(BREAK)
        starts = np.concatenate([[0], ends[:-1] + 1])
        edges = np.append(starts, len(codes))
        in_line = lambda places: _counts(places, edges)
        n_lines = len(starts)
        line_doc = np.searchsorted(docs, starts, side="right") - 1
        solid = ~has(SPACE)
        letter = has(LETTER)
        with np.errstate(over="ignore"):
            up, down = _Powers.of(len(codes) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.mixed[small] * up[:-1], dtype=np.uint64)])
            hashed = lambda a, b: (sums[b] - sums[a]) * down[a]

        # tokens and lines: stripped sizes, blocks
        token_begin, token_end = _runs(solid)
        line_tokens = np.searchsorted(token_begin, edges)
        filled = line_tokens[1:] > line_tokens[:-1]
        pad = np.append(token_begin, 0), np.append(token_end, 0)
        first = np.where(filled, pad[0][line_tokens[:-1]], len(codes))
        last = np.where(filled, pad[1][line_tokens[1:] - 1] - 1, -1)
        size = np.where(filled, last - first + 1, 0)
        block = np.cumsum(~filled | np.concatenate([[True], line_doc[1:] != line_doc[:-1]]))
        n_blocks = int(block[-1]) + 1
        per_block = lambda who, what=None: np.bincount(block[who], weights=what, minlength=n_blocks)

        # lines: patterns
        lines = pa.array([x for text in texts for x in text.split("\n")], type=pa.large_string())
        match = lambda pattern, mask=None: self._match(lines, pattern, mask)
        count = lambda mark: pc.count_substring(lines, mark).to_numpy(zero_copy_only=False)
        pipes = count("|")
        item = match(ITEM, filled)
        short = filled & (size < 60)
        row = filled & ((pipes >= 2) | ((pipes == 1) & (codes[np.minimum(first, len(codes) - 1)] == 124)))
        row |= filled & (in_line(spots(TAB)) > 0) & self._inner(lines, "\t")
        row |= match(GAP, filled & self._has(lines, "   "))
        row |= match(PAIR, short & ~item & ~row)
        row |= match(NUMBERS, filled & ~row)
        for mark in (",", ";"):
            alone = count(mark) - count(mark + " ")
            open_ = filled & ~row & (alone > 0) & ~self._has(lines, mark + " ")
            same = open_[1:] & open_[:-1] & (alone[1:] == alone[:-1]) & (block[1:] == block[:-1])
            run = np.cumsum(np.concatenate([[True], ~same]))
            long = np.bincount(run[open_], minlength=int(run[-1]) + 1)[run]
            row |= open_ & (long >= 2) & ((alone >= 2) | (long >= 3))
        rest = filled & ~row
        marked = rest & item
        marked |= match(LEADER, rest & ~marked & (self._has(lines, "..") | self._has(lines, ". .") | self._has(lines, "…")))
        marked |= match(ENTRY, rest & ~marked)
        before = np.cumsum(marked)
        ahead = before - marked - (before - marked)[np.searchsorted(block, block)]  # marked lines above in the block
        plain = rest & ~marked & ~((ahead > 0) & ~solid[starts])
        is_item = rest & ~plain
        closed = match(CLOSED, filled)
        gloss = plain & ~closed & match(GLOSS, plain & ~closed)

        # words: runs of letters, marks and joiners from their first letter on
        begin, end = _runs(has(LETTER | MARK | JOINER))
        letter_at = np.flatnonzero(letter)
        to_letter = np.searchsorted(letter_at, begin)
        starts_at = np.append(letter_at, len(codes))[to_letter]
        with_letter = starts_at < end
        begin, end = starts_at[with_letter], end[with_letter]
        word_line = np.searchsorted(starts, begin, side="right") - 1
        word_doc, length = line_doc[word_line], end - begin
        with np.errstate(over="ignore"):
            word_hash = hashed(begin, end)
        languages = stop_masks(word_hash)
        common = languages != 0

        # blocks of running lines: glossaries, keywords, bare items
        nb = per_block(plain)
        total = per_block(plain, size[plain])
        longest = np.zeros(n_blocks)
        np.maximum.at(longest, block[plain], size[plain])
        marks = per_block(plain, in_line(spots(LIST_MARK))[plain])
        cuts = marks + per_block(plain, (in_line(spots(WIDE_COMMA)) + count(", "))[plain])
        joined = total + np.maximum(0, nb - 1)
        in_plain = plain[word_line]
        words_b = np.bincount(block[word_line[in_plain]], minlength=n_blocks)
        share = np.bincount(block[word_line[in_plain]], weights=common[in_plain], minlength=n_blocks) / np.maximum(1, words_b)
        n_gloss = per_block(gloss)
        listed = (nb >= 2) & (n_gloss > 0.7 * nb) | ((nb == 1) & (n_gloss == 1) & (total < 90) & (share < 0.25))
        keys = (nb > 0) & ~listed & (cuts >= 4) & (joined < 28 * (cuts + 1)) & (((marks >= 0.7 * cuts) & (share < 0.12)) | ((cuts >= 5) & (joined < 22 * (cuts + 1)) & (share < 0.05) & (nb == 1)))
        bare = (nb >= 3) & ~listed & ~keys & (per_block(plain & closed) == 0) & (longest < 100) & (share < 0.3) & (total < 64 * nb)
        members = np.nonzero(plain & (keys | bare)[block])[0]
        if len(members):  # few: what is left to see is whether they hold sentences, or are one text wrapped at a width
            for b, some in self._groups(block[members], members):
                body = [lines[int(i)].as_py().strip() for i in some]
                text = " ".join(body)
                if keys[b]:
                    listed[b] = not (_STOP.search(text[:-1]) or text.endswith(("。", "！", "？", "।")))
                    if not listed[b] and nb[b] >= 3 and not any(_CLOSED.search(x) for x in body) and longest[b] < 100 and share[b] < 0.3 and total[b] < 64 * nb[b]:
                        listed[b] = not (_wrapped(body) and longest[b] >= 40 and share[b] >= 0.22)
                else:
                    listed[b] = not (_wrapped(body) and longest[b] >= 40 and share[b] >= 0.22)
        in_list = plain & listed[block]
        left = plain & ~in_list

        # figures of documents
        whole = np.maximum(1, sum_(line_doc, size))
        items = sum_(line_doc, size * (is_item | in_list))
        rows = sum_(line_doc, size * row)
        chars = np.maximum(1, sizes)
        digit_at = spots(DIGIT)
        letters = sum_(word_doc, length)
        digits = in_doc(digit_at)
        n_words = sum_(word_doc)
        unspaced = in_doc(spots(UNSPACED))
        low = left[word_line]
        n_low = sum_(word_doc[low])
        vowel_at = np.append(spots(VOWEL), len(codes))
        long_word = low & (length >= 3)
        mute = sum_(word_doc[long_word & (vowel_at[np.searchsorted(vowel_at[:-1], begin)] >= end)]) / np.maximum(1, sum_(word_doc[long_word]))
        closings = in_doc(spots(TERM))
        by_language = np.zeros((len(STOPS), n))
        hit = low & common
        for k in range(len(STOPS)):
            by_language[k] = np.bincount(word_doc[hit], weights=(languages[hit] >> np.uint32(k)) & np.uint32(1), minlength=n)
        best = by_language.argmax(0)
        token_line = np.searchsorted(starts, token_begin, side="right") - 1
        token_doc, token_left, token_size = line_doc[token_line], left[token_line], token_end - token_begin
        solids = sum_(token_doc, token_size)
        n_solid = np.maximum(1, solids)
        n_tokens = sum_(token_doc)
        lettered = np.append(letter_at, len(codes))[np.searchsorted(letter_at, token_begin)] < token_end
        with_letters = sum_(token_doc[lettered & token_left])
        others = np.flatnonzero(~lettered & token_left)
        numbered = sum_(token_doc[others[np.append(digit_at, len(codes))[np.searchsorted(digit_at, token_begin[others])] < token_end[others]]])  # marks alone are no words
        # long tokens, and documents of short ones, may be encoded data
        long_at = np.flatnonzero(token_size >= 25)
        runs = [bits[a:b] for a, b in zip(token_begin[long_at], token_end[long_at])]
        is_code = np.array([bool((x & BASE_URL).all() and (x & DIGIT).any() and (x & UPPER).any()) for x in runs], dtype=bool)
        is_base = np.array([bool((x & BASE).all()) for x in runs], dtype=bool)
        hexed = (n_tokens > 8) & (sum_(token_doc[token_size > 2]) == 0)
        for i in np.flatnonzero(hexed):
            x = bits[docs[i] : docs[i + 1]]
            hexed[i] = bool((x & (HEXA | SPACE)).all())
        nx = np.append(bits[1:], np.uint32(SPACE))
        pv = np.concatenate([[np.uint32(SPACE)], bits[:-1]])
        odd = ((bits & LOW) != 0) & ((nx & UPPER) != 0)
        strange_at = spots(STRANGE)
        odd_at = [np.flatnonzero(odd), digit_at[((nx[digit_at] & LETTER) != 0) & ((pv[digit_at] & LETTER) != 0)]]
        odd_at += [strange_at[(pv[strange_at] & LETTER) != 0], strange_at[(nx[strange_at] & LETTER) != 0]]
        point_at = spots(POINT)
        odd_at.append(point_at[((nx[point_at] & SPACE) == 0) & ((pv[point_at] & SPACE) != 0)])
        odd_at = np.concatenate(odd_at)
        odd_line = np.searchsorted(starts, odd_at, side="right") - 1
        odd = sum_(line_doc[odd_line[left[odd_line]]]) + sum_(token_doc[long_at[is_base & token_left[long_at]]]) if len(long_at) else sum_(line_doc[odd_line[left[odd_line]]])
        n_left = sum_(token_doc[token_left])
        lead_at = spots(LEAD | A_HAT | CONTROL | LOST)
        b0, b1, bp = bits[lead_at], nx[lead_at], pv[lead_at]
        broken = ((b0 & LEAD) != 0) & ((b1 & TRAIL) != 0) | ((b0 & A_HAT) != 0) & ((b1 & TRAIL) != 0) & (small[np.minimum(lead_at + 1, len(small) - 1)] < 0xC0)
        broken |= ((b0 & CONTROL) != 0) & ~(((b0 & TRAIL) != 0) & ((bp & LEAD) != 0)) | ((b0 & LOST) != 0)
        broken = in_doc(lead_at[broken])
        different, most, _ = _repeats(word_doc, word_hash, n)
        filled_at = np.nonzero(filled)[0]
        with np.errstate(over="ignore"):
            line_hash = hashed(first[filled_at], last[filled_at] + 1)
        _, _, again = _repeats(line_doc[filled_at], line_hash, n)
        n_filled = sum_(line_doc[filled_at])
        ratio = lambda a, b: np.round(a / np.maximum(1, b), 4)
        hash_at, dot_at = spots(HASH), spots(DOT)
        hashes = in_doc(hash_at[((pv[hash_at] & HASH) == 0) & ((nx[hash_at] & SPACE) == 0)]) + in_doc(spots(ELLIPSIS)) + in_doc(dot_at[((pv[dot_at] & DOT) != 0) & ((nx[dot_at] & DOT) != 0)])
        self.figures = {
            "chars": sizes, "words": (n_words + unspaced // 2).astype(np.int64), "mean_word_length": np.round(letters / np.maximum(1, n_words), 3),
            "symbol_ratio": ratio(np.maximum(0, solids - letters - digits), chars), "digit_ratio": ratio(digits, chars),
            "closed_line_ratio": ratio(sum_(line_doc, closed), n_filled), "bullet_line_ratio": ratio(sum_(line_doc, item), n_filled),
            "common_ratio": ratio(by_language.max(0), n_low), "distinct_ratio": np.where(n_words > 0, ratio(different, n_words), 1.0),
            "letter_word_ratio": np.where(with_letters + numbered > 0, ratio(with_letters, with_letters + numbered), 1.0), "hash_ellipsis_ratio": ratio(hashes, n_tokens),
            "markup_ratio": ratio(self._markup(texts), chars), "mojibake_ratio": ratio(broken, chars), "odd_ratio": ratio(odd, n_left),
            "top_word_ratio": np.where(n_words >= MIN_REPEATED_WORDS, ratio(most, n_words), 0.0), "repeated_line_ratio": np.where(n_filled >= MIN_REPEATED_LINES, ratio(again, n_filled), 0.0),
            "vowelless_ratio": np.round(mute, 4), "closing_ratio": ratio(closings, n_words), "encoded_ratio": np.where(hexed, 1.0, ratio(sum_(token_doc[long_at[is_code]], token_size[long_at[is_code]]) if len(long_at) else np.zeros(n), n_solid)), "item_ratio": ratio(items, whole), "row_ratio": ratio(rows, whole),
        }
        names = list(STOPS)
        self.language = [names[k] if by_language[k, i] > 0 else None for i, k in enumerate(best)]
        self._judge(unspaced * 3 < n_solid, n_low, n_left, in_doc(spots(LISTED)) > 0.5 * np.maximum(1, in_doc(letter_at)), in_doc(letter_at) + digits > 0)

    @staticmethod
    def _match(lines: pa.Array, pattern: str, mask: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(lines), dtype=bool)
        where = np.nonzero(mask)[0]
        if len(where):
            out[where] = pc.match_substring_regex(lines.take(pa.array(where)), pattern).to_numpy(zero_copy_only=False)
        return out

    @staticmethod
    def _has(lines: pa.Array, mark: str) -> np.ndarray:
        return pc.match_substring(lines, mark).to_numpy(zero_copy_only=False)

    @staticmethod
    def _inner(lines: pa.Array, mark: str) -> np.ndarray:
        """Whether a mark stands within the line, not at its ends alone."""
        return pc.match_substring(pc.utf8_trim_whitespace(lines), mark).to_numpy(zero_copy_only=False)

    @staticmethod
    def _groups(keys: np.ndarray, values: np.ndarray):
        cuts = np.nonzero(np.diff(keys))[0] + 1
        for k, v in zip(keys[np.concatenate([[0], cuts])], np.split(values, cuts)):
            yield k, v

    def _markup(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(self.n)
        where = [i for i, x in enumerate(texts) if "<" in x or "&" in x]
        if where:
            some = pa.array([texts[i] for i in where], type=pa.large_string())
            out[where] = (pc.utf8_length(some).to_numpy() - pc.utf8_length(pc.replace_substring_regex(some, TAG, "")).to_numpy()).astype(float)
        return out

    def _judge(self, spaced, n_low, n_left, listed, readable) -> None:
        f, n = self.figures, self.n
        asked = {
            # many a language has no list here; its prose is told by its sentences
            "common words": spaced & (n_low >= MIN_WORDS) & listed & (f["closing_ratio"] < MIN_CLOSINGS),
            "no vowels": spaced & (n_low >= MIN_WORDS), "mean word length": spaced & (n_low >= MIN_WORDS), "odd words": spaced & (n_left >= MIN_WORDS),
            "words with letters": spaced & (n_left >= MIN_WORDS),
        }
        fails = {}
        for name, (key, least, most, _) in RULES.items():
            bad = np.zeros(n, dtype=bool)
            if least is not None:
                bad |= f[key] < least
            if most is not None:
                bad |= f[key] > most
            fails[name] = bad & asked.get(name, True)
        fails["no letters or digits"] = ~readable
        hard = np.any([fails[k] for k in HARD], axis=0)
        any_ = np.any(list(fails.values()), axis=0)
        rows, items = f["row_ratio"], f["item_ratio"]
        both = (rows + items > 0.5) & ~fails["symbols"] & ~fails["odd words"]
        self.kind = np.select([hard, rows > 0.5, items > 0.5, both & (rows > items), both, any_], ["junk", "table", "list", "table", "list", "junk"], "prose").tolist()
        self.reasons = [[k for k, v in fails.items() if v[i]] for i in range(n)]


def statistics(text: str | None) -> dict:
    """All figures of one text, its verdict and the reasons."""
    batch = Batch([text or ""])
    return {k: v[0].item() for k, v in batch.figures.items()} | {"language": batch.language[0], "kind": batch.kind[0], "reasons": batch.reasons[0]}


FIGURES = dict.fromkeys(("chars", "words"), "int") | dict.fromkeys(("mean_word_length", "symbol_ratio", "digit_ratio", "closed_line_ratio", "bullet_line_ratio", "common_ratio", "distinct_ratio", "letter_word_ratio", "hash_ellipsis_ratio", "markup_ratio", "mojibake_ratio", "odd_ratio", "top_word_ratio", "repeated_line_ratio", "vowelless_ratio", "closing_ratio", "encoded_ratio", "item_ratio", "row_ratio"), "double") | {"language": "string", "kind": "string", "reasons": "array<string>"}
#: Characters of a batch of texts, about; a longer text is a batch of its own.
SLICE = 1 << 19


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``FIGURES`` of each document. Null and empty texts have zero figures and count as junk ("too few
    words"). ``language`` is that of the list whose common words it has most of; the rule on them is asked only of texts
    in the scripts of the lists that have no sentences either, as many a language has no list. Repeated rows give repeated results; other columns are ignored."""
    kept = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))

    def make():
        def figures(ids, texts):
            out: list[list] = [[] for _ in FIGURES]
            texts = [t or "" for t in texts]
            at = 0
            while at < len(texts):
                stop, room = at + 1, SLICE - len(texts[at])
                while stop < len(texts) and room > len(texts[stop]):
                    room -= len(texts[stop])
                    stop += 1
                batch = Batch(texts[at:stop])
                for c, v in zip(out, (*(batch.figures[k].tolist() for k in list(FIGURES)[:-3]), batch.language, batch.kind, batch.reasons)):
                    c += v
                at = stop
            return [ids, *out]

        return figures

    kind = kept.schema["__id"].dataType.simpleString()
    return map_batches(kept, make, f"`{id_col}` {kind}, " + ", ".join(f"{k} {v}" for k, v in FIGURES.items()))
