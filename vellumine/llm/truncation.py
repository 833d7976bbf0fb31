"""Texts cut off by field limits or in transfer.

A trie of the corpus vocabulary is asked about the final token of every text that is not closed: an unknown proper prefix
of known words is a fragment. Length evidence stands beside it: lengths at which a source's unclosed texts pile up are its
field limits. How the text ends is the third evidence: running text must end in a closing mark, other units (list items,
captions, cells, headings, Thai sentences) need not, and their final words are compared with those that end such units
within texts. A strange final word is let pass where many different texts end in the same two units, as those of one
template do. ``why`` names the first evidence of a cut in this order.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..operators.scale import salted_join
from ..session import checkpointed
from .common import WHITE_SPACE, map_batches
from .lookalikes import plain
from .sentences import _CAPTION, _ENTRY, _INVISIBLE as _IGNORED, MAYBE, NEVER, sentence_units

#: A stand-in for a missing text: a word for nothing, or "no" and a word for what is missing, in brackets or not.
STAND_IN = re.compile(
    r"[\[(<{]?\s*(?:n/?a|none|null|nil|nan|undefined|unknown|empty|blank|missing|void|tbd|todo|-+"
    r"|(?:no|empty|missing|blank)\s+(?:text|output|response|content|answer|result|reply|data|value|body)(?:\s+(?:was\s+)?(?:returned|available|provided|given|generated|found|here|yet))?"
    r"|(?:text|output|response|content|answer|result|reply|data|value|body)\s+(?:missing|empty|unavailable|not\s+(?:available|found|provided)))\s*[.!]?\s*[\])>}]?",
    re.I,
)
_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎]+[^\W\d_]*)*")
# words of the vocabulary: no letters joined to digits, as in hex strings
_KNOWN = re.compile(r"[^\W\d_]++(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎]++[^\W\d_]*+)*+(?!(?<=[a-z])[0-9])")
_JOINED = re.compile(r"[0-9]+[a-z][0-9a-z]*")
#: What a record weighs in counts; its deliveries share it. Divisible by 1 to 16.
RECORD = 720_720
#: Up to so many repeated ids are broadcast.
REPEATS = 1_000_000
#: Up to so many distinct final tokens are broadcast.
FINALS = 200_000
#: The share of a word's occurrences in which it ends units of a kind, if it is a usual end of them.
END_SHARE = 0.002
_STRIP = WHITE_SPACE + "".join(_IGNORED.findall("".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))))
_CLOSED = re.compile(r"[.!?。！？｡．؟।॥]+[\"'”’“»」』）)\]}\s`*_]*$")
_TRACE = re.compile(r"(?:…|\.\.\.|�|\[|\(|<|\[(?:…|\.\.\.|truncated|cut)\]?)$", re.I)
_THAI = re.compile(r"[฀-๿]")
_LAST = re.compile(r"[\w.\-]+$")
_PAIRS = (("(", ")"), ("（", "）"), ("„", "“"), ("«", "»"), ("「", "」"), ("『", "』"), ("[", "]"))


def _kind(text: str, a: int, b: int) -> str:
    head = text[a : a + 40]
    if head[0] in "#＃":
        return "heading"
    if head[0] in "|｜":
        return "table"
    if re.match(r"[-*•‣◦▪]\s", head):
        return "list"
    if _CAPTION.match(plain(head)):
        return "caption"
    if _ENTRY.match(text, a, b):
        return "entry"
    if len(_THAI.findall(text, a, b)) * 3 > b - a:
        return "thai"
    return "text"


_PART = re.compile(r"[^\W\d_]|[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎]")
_BLANKS = _STRIP + "\"'”’“»」』）)]}`*_.|"


def final_token(text: str) -> str:
    """The last run of letters, in lower case; "0" where a digit or letters joined to one end the text, "" where none does.

    The run is read whole, however long: as long as it may begin before the stretch looked at, a longer one is taken.
    """
    width = 80
    while True:
        tail = plain(text[-width:]).rstrip(_BLANKS)
        at = len(tail)
        while at and _PART.match(tail, at - 1):
            at -= 1
        if at or width >= len(text):
            break
        width *= 4
    if tail[-1:].isdigit():
        return "0"
    last = tail[at:].lower().lstrip("".join(c for c in set(tail[at:]) if unicodedata.category(c)[0] == "M"))
    if last.isascii() and at and tail[at - 1] in "0123456789":
        return "0" if last else ""
    return last


def read_end(text: str, units: list[tuple[int, int]]) -> tuple[str, str, str]:
    """How a text ends: a state, the kind of its last unit, and its final token.

    States: ``cut`` and ``whole`` are sure; ``open`` needs the corpus, ``limit`` only counts at a field limit.
    """
    t = text.rstrip(_STRIP)
    if not units or STAND_IN.fullmatch(t):
        return "whole", "none", ""
    a, b = units[-1]
    rest = text[b:].strip(_STRIP)
    kind = _kind(text, a, b)
    unit = text[a:b].rstrip(_STRIP)
    whole = unit + rest
    token = final_token(unit)
    if re.fullmatch(r"[\[(<{].{0,30}[\])>}]", t) and len(units) == 1:
        return "whole", kind, token  # a lone stand-in
    if _TRACE.search(t):
        return "cut", kind, token
    if kind == "table":
        return ("open" if not unit.rstrip("\"'”’“»`* ").endswith(("|", "｜")) else "whole"), kind, token
    if kind in ("list", "caption", "heading", "thai"):
        if kind != "heading" and _CLOSED.search(whole):
            return "whole", kind, token
        return "open", kind, token
    if " " not in unit and len(unit) > 60 and unit.isascii():
        return "whole", kind, token  # an unbroken sequence
    if not _CLOSED.search(whole):
        return "cut", kind, token
    # closed, but perhaps by the full stop of an abbreviation, of a number, or within brackets
    inner = _IGNORED.sub("", unit).rstrip("\"'”’“»」』）)]}`*_ ")
    if kind == "entry":
        if re.search(r"\d\s?[–-]\s?\d+\.$", inner):
            return "whole", kind, token
        if re.search(r"(?:\(\d{4}[a-z]?\)|\b[^\W\d_])\.$", inner):
            return "cut", kind, token
        return "limit", kind, token
    for opening, closing in _PAIRS:
        if unit.count(opening) > unit.count(closing) and (opening != "[" or unit.rfind("[") > len(unit) - 12):
            return "cut", kind, token
    if unit.count('"') % 2 and not unit.endswith('"') and not whole.endswith('"') and re.search(r'(?:^|\s)"[^"\s][^"]*$', unit):
        return "cut", kind, token
    if inner.endswith("."):
        m = _LAST.search(inner, 0, len(inner) - 1)
        if m:
            raw = m.group()
            word = raw.lower().strip("-.")
            if not word.isascii():
                word = plain(word)
            if word in NEVER and len(word) > 1 or re.fullmatch(r"[^\W\d_]", raw) and (raw.isupper() or word in ("p", "z", "d", "u", "т", "е", "и", "i", "e")) and not re.search(r"\d\s?°?\S?$", inner[: m.start()]):
                return "cut", kind, token
            if word in ("ff", "u.s", "a.m") or (word == "al" and len(inner.split()) <= 4):
                return "cut", kind, token
            if word in MAYBE or word.isdigit():
                return "limit", kind, token
    return "whole", kind, token


@dataclass
class Extra:
    """What another operator wants read in the same pass: input columns, and a maker of a function of the texts, their
    ends (state, kind, token) and these columns that returns the output columns."""

    inputs: dict[str, Column]
    outputs: dict[str, str]
    make: Callable[[], Callable[..., list[list]]]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _signs(df: DataFrame, field: str, id_col: str, source: str, order: Column, extra: Extra | None = None) -> DataFrame:
    """Rows of three kinds: ``r`` records, ``v`` vocabulary, ``e`` ends of units within texts; records have digests of their last lines and of what leads to them."""
    kept = df.select(F.col(id_col).cast("bigint").alias("row_id"), order.cast("timestamp").alias("o"), F.col(source).cast("string").alias("source"), F.col(field).alias("t"), *(c.alias(f"__{n}") for n, c in (extra.inputs if extra else {}).items()))
    more = [c for c in kept.columns if c.startswith("__")]
    repeats = checkpointed(kept.groupBy("row_id").agg(F.count("*").alias("k")).where("k > 1"))
    kept = kept.join(F.broadcast(repeats) if repeats.count() <= REPEATS else repeats, "row_id", "left").select("row_id", "o", "source", "t", F.coalesce("k", F.lit(1)).alias("k"), *more)

    reader = extra.make if extra else None

    def make():
        read = reader() if reader else None

        def signs(ids, orders, sources, texts, deliveries, *columns):
            words: Counter[str] = Counter()
            shared: Counter[str] = Counter()
            ends: Counter[tuple[str, str]] = Counter()
            out: list[tuple] = []
            states: list[tuple[str, str, str]] = []
            for i, o, s, t, times in zip(ids, orders, sources, texts, deliveries):
                if t is None:
                    states.append(("whole", "none", ""))
                    out.append(("r", i, o, s, "whole", "none", "", 0, 0, None, None))
                    continue
                units = sentence_units(t)
                state, kind, token = read_end(t, units)
                states.append((state, kind, token))
                line = lead = None
                if state == "open" and len(units) > 1:
                    # the last unit behind the whole one before it, and the words that lead to them
                    at = units[-2][0]
                    line = _digest(t[at:].strip(_STRIP))
                    lead = _digest(" ".join(_WORD.findall(plain(t[:at]).lower())))
                out.append(("r", i, o, s, state, kind, token, len(t), len(t.encode("utf-8", "surrogatepass")), line, lead))
                for a, b in units[:-1]:
                    head = t[a]
                    if head in "-*•#|" or _THAI.match(t, b - 1) or _THAI.match(head):
                        k = _kind(t, a, b)
                    elif t.startswith(("Figure", "Table", "figure", "table"), a):
                        k = "caption"
                    else:
                        continue
                    ends[k, final_token(t[max(a, b - 80) : b])] += RECORD // times
                if units:
                    p = plain(t[: units[-1][0]] + " " + t[units[-1][0] : units[-1][1]].rstrip(_STRIP))
                    found = _KNOWN.findall(_JOINED.sub(" ", p.lower()))
                    if found and token and token != "0" and found[-1] == token:
                        found.pop()
                    if times == 1:
                        words.update(set(found))
                    else:
                        for w in set(found):
                            shared[w] += RECORD // times
            for w, n in words.items():
                shared[w] += n * RECORD
            out += [("v", 0, None, None, None, None, w, n, 0, None, None) for w, n in shared.items()]
            out += [("e", 0, None, None, None, k, w, n, 0, None, None) for (k, w), n in ends.items()]
            found = [list(c) for c in zip(*out)]
            if read:  # the records come first
                rest = [None] * (len(out) - len(texts))
                found += [c + rest for c in read(texts, states, *columns)]
            return found

        return signs

    return map_batches(kept, make, "what string, row_id bigint, o timestamp, source string, state string, kind string, token string, n bigint, n_bytes bigint, line binary, lead binary" + "".join(f", {n} {t}" for n, t in (extra.outputs if extra else {}).items()))


def trie_nodes(words: DataFrame, finals: DataFrame) -> DataFrame:
    """The nodes of the vocabulary's trie that some final token reaches: ``token, own, through``.

    ``words`` are ``token, c``. The trie is a table with a row a node: the letters that lead to it, the count of the word
    that ends there, and that of all words through it. So it is built by one grouped sum and grows with the cluster.
    """
    few = finals.count() <= FINALS
    node = words.select("token", "c", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("n"))
    node = node.select(F.substring("token", F.lit(1), F.col("n")).alias("token"), F.when(F.col("n") == F.length("token"), F.col("c")).otherwise(0).alias("own"), "c")
    if not few:  # sums first: a short prefix has very many words
        node = node.groupBy("token").agg(F.sum("own").alias("own"), F.sum("c").alias("c"))
    return node.join(F.broadcast(finals) if few else finals, "token", "left_semi").groupBy("token").agg(F.sum("own").alias("own"), F.sum("c").alias("through"))


def _lookup(finals: DataFrame, words: DataFrame, share: float = 0.005) -> DataFrame:
    """``token, known, prefix`` for each final token that is in the trie, as a word or as a part of one.

    A token is a known word if it is as frequent as ``share`` of the words that go on from it; a prefix if any do.
    """
    more = F.col("through") - F.col("own")
    return trie_nodes(words, finals).select("token", ((F.col("own") > 0) & (F.col("own") >= share * more)).alias("known"), (more > 0).alias("prefix"))


def _limits(records: DataFrame, width: int = 12, least: int = 5, share: float = 0.3) -> DataFrame:
    """Field limits of sources: ``source, measure, low, high``.

    A limit is a length, in code points or bytes, up to which at least ``share`` of a source's texts cut in running text
    lie within ``width``, ``least`` of them at least, where an even spread would put less than a tenth as many.
    A source may have several; of those that overlap, a text counts for the sharpest alone, and each must pass by its own.
    """
    cut = records.where("state = 'cut' and source is not null").select("source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("n").alias("len")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("len")))).alias("m")).select("source", "m.*")
    by = cut.groupBy("source", "measure", "len").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("source", "measure")
    near = whole.orderBy("len").rangeBetween(-width, 0)
    by = by.withColumn("near", F.sum("n").over(near)).withColumn("all", F.sum("n").over(whole)).withColumn("most", F.max("len").over(whole))
    peak = by.where((F.col("near") >= least) & (F.col("near") >= share * F.col("all")) & (F.col("near") >= 10.0 * F.col("all") * (width + 1) / F.col("most")))
    # a sharp limit has its texts at one length (in bytes, a letter less), others within the width below
    sharp = F.col("n") >= 0.5 * F.col("near")
    peak = peak.withColumn("sharp", sharp).withColumn("low", F.when(sharp, F.col("len") - F.when(F.col("measure") == "bytes", 3).otherwise(0)).otherwise(F.col("len") - width))
    # candidates of a source, best first; there are few, since each holds a share of its texts
    rank = F.struct((~F.col("sharp")).alias("blunt"), (-F.when(F.col("sharp"), F.col("n")).otherwise(F.col("near"))).alias("less"), (-F.col("len")).alias("down"), (F.col("measure") == "chars").alias("chars"), "measure", "low", F.col("len").alias("high"), "all")
    peaks = peak.groupBy("source").agg(F.array_sort(F.collect_list(rank)).alias("peaks"))
    lengths = records.where("state = 'cut' and source is not null").groupBy("source", "n", "n_bytes").agg(F.count("*").alias("c"))
    first = F.expr("filter(peaks, p -> CASE WHEN p.measure = 'bytes' THEN n_bytes ELSE n END BETWEEN p.low AND p.high)")
    held = salted_join(lengths, peaks, ["source"], F.col("n"), "inner").withColumn("p", F.get(first, F.lit(0))).where("p is not null")
    by = held.groupBy("source", "p").agg(F.sum("c").alias("own")).where((F.col("own") >= least) & (F.col("own") >= share * F.col("p.all")))
    return by.select("source", "p.measure", "p.low", "p.high")


def _usual(records: DataFrame, least: int = 3, share: float = 1e-4) -> DataFrame:
    """``line, usual``: last lines to which different texts lead, ``least`` and ``share`` of all records at least."""
    by = records.where("line is not null").groupBy("line").agg(F.count_distinct("lead").alias("c")).where(F.col("c") >= least)
    return by.crossJoin(F.broadcast(records.agg(F.count("*").alias("all")))).where(F.col("c") >= share * F.col("all")).select("line", F.lit(True).alias("usual"))


def truncated(df: DataFrame, field: str = "humanized_text", id_col: str = "result_id", source: str = "source", order: Column | None = None, extra: Extra | None = None) -> DataFrame:
    """For each record: ``row_id``, ``source``, ``cut`` (boolean) and ``why``, and the columns of ``extra``.

    Null texts and texts without letters and digits are not cut. Of rows repeated under one id the last by ``order``
    counts. A null source has no limits of its own. Other columns are ignored.
    """
    signs = checkpointed(_signs(df, field, id_col, source, F.lit(None) if order is None else order, extra))
    names = list(extra.outputs) if extra else []
    last = F.coalesce("o", F.timestamp_seconds(F.lit(0)))
    one = [F.max_by(F.struct("source", "state", "kind", "token", "n", "n_bytes", "line", "lead"), last).alias("x")]
    if names:  # of the deliveries that have them
        one.append(F.max_by(F.struct(*names), F.when(F.col(names[0]).isNotNull(), last)).alias("y"))
    records = signs.where("what = 'r'").groupBy("row_id").agg(*one).select("row_id", "x.*", *(["y.*"] if names else []))
    limits = _limits(records).groupBy("source").agg(F.collect_list(F.struct("measure", "low", "high")).alias("limits"))
    left = records.where("state <> 'whole'")
    # a word of one record alone tells nothing; how often a known one must be is relative
    words = signs.where("what = 'v'").groupBy("token").agg(F.sum("n").alias("c")).where(F.col("c") >= 2 * RECORD)
    finals = checkpointed(left.where("state <> 'limit' and token not in ('', '0')").select("token").distinct())
    looked = _lookup(finals, words)
    # a token ends units of a kind if it does so in a share of its occurrences
    ends = signs.where("what = 'e'").groupBy("kind", "token").agg(F.sum("n").alias("e")).join(words, "token", "left").where(F.col("e") >= END_SHARE * F.coalesce("c", F.lit(0))).select("kind", "token", F.lit(True).alias("ends"))
    lines = _usual(records)
    # many texts end alike, and sources are few: the joins are salted on the records' side
    judged = left
    for right, keys in ((looked, ["token"]), (ends, ["kind", "token"]), (lines, ["line"]), (limits, ["source"])):
        judged = salted_join(judged, right, keys, F.col("row_id"))
    at_limit = F.coalesce(F.expr("exists(limits, x -> CASE WHEN x.measure = 'bytes' THEN n_bytes ELSE n END BETWEEN x.low AND x.high)"), F.lit(False))
    fragment = F.coalesce(~F.col("known") & F.col("prefix"), F.lit(False)) & (F.col("state") != "limit") & (F.col("kind") != "table")
    strange = (F.col("kind").isin("list", "caption", "thai")) & (F.col("token") != "0") & F.col("ends").isNull()
    unclosed = F.col("state") == "cut"
    why = F.when(fragment, "fragment").when(at_limit & (unclosed | (F.col("state") == "limit") | F.col("ends").isNull() | (F.col("token") == "0")), "limit").when(unclosed, "open end")
    why = why.when((F.col("state") == "open") & (F.col("kind") == "table"), "row").when((F.col("state") == "open") & strange & F.col("usual").isNull(), "ending")
    settled = judged.select("row_id", "source", why.isNotNull().alias("cut"), why.alias("why"), *names)
    return records.where("state = 'whole'").select("row_id", "source", F.lit(False).alias("cut"), F.lit(None).cast("string").alias("why"), *names).unionByName(settled)


def truncation_rates(found: DataFrame) -> DataFrame:
    """For each source: records, those cut, and their share."""
    return found.groupBy("source").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"), F.round(F.count_if("cut") / F.count("*"), 4).alias("share"))
