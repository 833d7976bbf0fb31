"""Long exact spans that stand in more than one record, by relative Lempel-Ziv parsing.

Winnowing picks anchors (k-grams whose hash is the least of a window), so that every span of the given length holds one.
The text around each anchor that stands in more than one record goes to a reference block, which is chosen by the
anchor's hash: so two records that share a span meet in a block, and copies are stored there once. A block is indexed
by the hashes of all its grams of the given length. Each document segment is factored greedily against it: at the first
place with a reference in another record the longest match is taken as a factor, and the parse goes on behind it. Each
factor's end is checked: places before it from which another reference reaches beyond the end begin a factor as well.
Hashes choose, texts decide. An anchor with very many different surroundings is spread over the cluster by windows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from ..operators.scale import salted_join
from ..session import written
from .common import map_batches

MIN_LENGTH = 200
HOT = 2000  # contexts of one anchor that a task handles; beyond it, windows are spread over the cluster
BLOCK = 10_000  # segments in a reference block, about
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _BASE), dtype=np.uint64)])
                cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, inverse), dtype=np.uint64)])
        return cls.up[:n], cls.down[:n]


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    at, size = x, 1
    while size * 2 <= w:
        at = op(at[:-size], at[size:])
        size *= 2
    return op(at[: len(at) - (w - size)], at[w - size :]) if w > size else at


def anchors(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some window of w; needs ``len(codes) >= k + w - 1``."""
    with np.errstate(over="ignore"):
        up, down = _Powers.of(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        h = _mix((sums[k:] - sums[:-k]) * down[: len(codes) - k + 1])
    least = _slide(h, w, np.minimum)
    # a place is chosen if it is least in one of its windows: the greatest of their minima is its own hash
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    chosen = np.nonzero(_slide(padded, w, np.maximum) == h)[0]
    return chosen, h[chosen].view(np.int64)


def _anchor_rows(df: DataFrame, fields: list[str], min_length: int) -> DataFrame:
    k = min_length // 2
    w = min_length - k + 1

    def make():
        def find(ids, *columns):
            out_h, out_i, out_f, out_p = [], [], [], []
            for f, texts in enumerate(columns):
                for i, t in zip(ids, texts):
                    if t is None or len(t) < min_length:
                        continue
                    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    at = 0
                    while at + min_length <= len(codes):
                        p, h = anchors(codes[at : at + _SLICE], k, w)
                        out_p += (p + at).tolist()
                        out_h += h.tolist()
                        out_i += [i] * len(p)
                        out_f += [f] * len(p)
                        at += _SLICE - min_length + 1
            return [out_h, out_i, out_f, out_p]

        return find

    return map_batches(df.select("id", *fields), make, "h bigint, id bigint, f tinyint, pos int")


def _segments(df: DataFrame, wanted: DataFrame, fields: list[str], min_length: int) -> DataFrame:
    """The surroundings of each wanted anchor: enough to see any span of the length that holds it."""
    k = min_length // 2
    reach = min_length - k

    def make():
        def cut(wants, *columns):
            out: list[list] = [[] for _ in range(8)]
            for want, *texts in zip(wants, *columns):
                for w in want:
                    t = texts[w["f"]]
                    p = w["pos"]
                    if t is None or p + k > len(t):
                        continue
                    left, core, right = t[max(0, p - reach) : p], t[p : p + k], t[p + k : p + k + reach]
                    ctx = hashlib.blake2b("\0".join((left, core, right)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for c, v in zip(out, (w["h"], ctx, w["id"], w["f"], p, left, core, right)):
                        c.append(v)
            return out

        return cut

    joined = df.join(wanted, "id").select("want", *fields)
    return map_batches(joined, make, "h bigint, ctx binary, id bigint, f tinyint, pos int, l string, c string, r string")


class Block:
    """A reference block: segments of text with the least and greatest record that holds each, and the index of its grams."""

    def __init__(self, segments: list[str], low: np.ndarray, high: np.ndarray, length: int):
        self.length, self.low, self.high = length, low, high
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        self.codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.owner = np.repeat(np.arange(len(segments)), sizes)
        at = np.arange(max(0, len(self.codes) - length + 1))
        self.places = at[at + length <= self.ends[self.owner[: len(at)]]]  # grams that lie within one segment
        with np.errstate(over="ignore"):
            up, down = _Powers.of(len(self.codes) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
            h = (sums[self.places + length] - sums[self.places]) * down[self.places]
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        who = self.owner[self.places[order]]
        # of each gram: the least and the greatest record, and a place in each
        self.ranked = self.places[order]
        self.first, self.size = first, np.diff(np.append(first, len(h)))
        least = np.lexsort((low[who], group)) if len(h) else first
        most = np.lexsort((-high[who], group)) if len(h) else first
        self.least, self.most = self.ranked[least[first]], self.ranked[most[first]]
        self.of = np.full(len(self.codes), -1, dtype=np.int64)
        self.of[self.ranked] = group
        shared = low[self.owner[self.least]] != high[self.owner[self.most]] if len(h) else np.zeros(0, bool)
        self.found = np.zeros(len(self.codes), dtype=bool)
        self.found[self.ranked] = shared[group] if len(h) else False

    def _match(self, p: int, r: int) -> int:
        """Length of what stands both at p and at r, within their segments."""
        n = min(self.ends[self.owner[p]] - p, self.ends[self.owner[r]] - r)
        differ = np.nonzero(self.codes[p : p + n] != self.codes[r : r + n])[0]
        return int(differ[0]) if len(differ) else int(n)

    def _longest(self, p: int) -> int:
        """The longest match at p in another record, of those that its gram's entry names; 0 if it is shorter than asked."""
        x, g = self.owner[p], self.of[p]
        best = 0
        for r, record in ((self.least[g], self.low[self.owner[self.least[g]]]), (self.most[g], self.high[self.owner[self.most[g]]])):
            if record != self.low[x]:
                best = max(best, self._match(p, r))
        if best < self.length:  # grams of one hash that differ: ask all of them
            for r in self.ranked[self.first[g] : self.first[g] + self.size[g]]:
                if self.low[self.owner[r]] != self.low[x] or self.high[self.owner[r]] != self.low[x]:
                    best = max(best, self._match(p, r))
        return best if best >= self.length else 0

    def factors(self, x: int) -> list[tuple[int, int]]:
        """Factors of segment x that reach the length, as begin and end in it; those met at others' ends overlap them."""
        a, b = int(self.starts[x]), int(self.ends[x])
        if b - a < self.length:
            return []
        if self.low[x] != self.high[x]:
            return [(0, b - a)]  # the whole segment stands in several records
        out = []
        places = (np.nonzero(self.found[a:b])[0] + a).tolist()
        p, i = a, 0
        while True:
            i = bisect_left(places, p, i)
            if i == len(places):
                return out
            p = places[i]
            n = self._longest(p)
            if n:
                out.append((p - a, p - a + n))
                p += n - self.length + 1  # the first place whose gram reaches beyond the factor's end
            else:
                p += 1


def shared_spans(df: DataFrame, fields: list[str], id_col: str = "result_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """Spans of at least ``min_length`` code points that stand, code point by code point, in another record too.

    Columns: ``field``, ``row_id``, ``start_pos``, ``end_pos``: of each text the longest stretches of which every window
    of ``min_length`` is shared. A record is an id: what its own fields, or rows repeated under it, share does not count.
    Rows without an id are no records. Null and shorter texts have no spans; an empty table gives none. Other columns
    are ignored.
    """
    k = min_length // 2
    reach = min_length - k
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), *(F.col(f).alias(f"t{i}") for i, f in enumerate(fields))).where("id is not null")
    names = [f"t{i}" for i in range(len(fields))]
    seen = written(_anchor_rows(texts, names, min_length))
    shared = seen.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("h")
    wanted = salted_join(seen, shared, ["h"], F.col("id"), "inner").groupBy("id").agg(F.collect_set(F.struct("h", "id", "f", "pos")).alias("want"))  # as many as the record's own texts have
    held = written(_segments(texts, wanted, names, min_length))

    contexts = held.groupBy("h", "ctx").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.any_value("l").alias("l"), F.any_value("c").alias("c"), F.any_value("r").alias("r"))
    counted = written(contexts)
    blocks = max(1, -(-counted.count() // BLOCK))
    hot = counted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h")

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        lefts, cores = pdf["l"].tolist(), pdf["c"].tolist()
        block = Block([a + b + c for a, b, c in zip(lefts, cores, pdf["r"].tolist())], pdf["low"].to_numpy(), pdf["high"].to_numpy(), min_length)
        # a window of the length asked for begins j before the anchor
        rows = [(h, ctx, len(left) - (e - min_length), len(left) - s) for x, (h, ctx, left) in enumerate(zip(pdf["h"].tolist(), pdf["ctx"].tolist(), lefts)) for s, e in block.factors(x)]
        return pd.DataFrame(rows, columns=["h", "ctx", "a", "b"])

    usual = counted.join(hot, "h", "left_anti").withColumn("block", F.pmod("h", F.lit(blocks))).groupBy("block").applyInPandas(factor, "h bigint, ctx binary, a int, b int")
    spread = counted.join(hot, "h", "left_semi").select("h", "ctx", "low", "high", "l", "c", "r", F.explode(F.sequence(F.greatest(F.lit(0), reach - F.length("r")), F.least(F.lit(reach), F.length("l")))).alias("j")).where(F.col("j").between(F.greatest(F.lit(0), reach - F.length("r")), F.least(F.lit(reach), F.length("l"))))
    window = F.md5(F.concat(F.expr("right(l, j)"), F.col("c"), F.expr(f"left(r, {reach} - j)")))
    spread = spread.select("h", "ctx", "j", "low", "high", window.alias("m"))
    meets = spread.groupBy("h", "j", "m").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("h", "j", "m")
    factors = usual.unionByName(spread.join(meets, ["h", "j", "m"]).select("h", "ctx", F.col("j").alias("a"), F.col("j").alias("b")))

    spans = held.select("h", "ctx", "id", "f", "pos").join(factors, ["h", "ctx"]).select("id", "f", (F.col("pos") - F.col("b")).alias("s"), (F.col("pos") - F.col("a") + min_length).alias("e")).distinct()
    # spans whose windows follow each other are one; a text has as many as it is long at most
    text = Window.partitionBy("id", "f").orderBy("s", "e")
    reached = F.max("e").over(text.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.when(F.col("s") <= reached - min_length + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = apart.groupBy("id", "f", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    name = reduce(lambda c, i: c.when(F.col("f") == i, fields[i]), range(1, len(fields)), F.when(F.col("f") == 0, fields[0]))
    return merged.select(name.alias("field"), F.col("id").alias("row_id"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))


def shared_report(df: DataFrame, spans: DataFrame, fields: list[str], id_col: str = "result_id") -> DataFrame:
    """For each record and field with a text: its length, how many of its characters lie in shared spans, and the share."""
    lengths = df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.length(f).alias("n_chars")) for f in fields))).alias("x")).select("row_id", "x.*").where("n_chars is not null").groupBy("row_id", "field").agg(F.max("n_chars").alias("n_chars"))
    # spans of one text may overlap by less than the length asked for: count their union
    flat = spans.groupBy("row_id", "field").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("p"))
    union = F.expr("aggregate(p, named_struct('n', 0, 'e', 0), (acc, x) -> named_struct('n', acc.n + greatest(0, x.end_pos - greatest(x.start_pos, acc.e)), 'e', greatest(acc.e, x.end_pos)), acc -> acc.n)")
    by = flat.select("row_id", "field", union.alias("shared_chars"), F.size("p").alias("spans"))
    return lengths.join(by, ["row_id", "field"], "left").fillna(0, ["shared_chars", "spans"]).select("field", "row_id", "n_chars", "shared_chars", "spans", F.round(F.col("shared_chars") / F.greatest(F.lit(1), F.col("n_chars")), 4).alias("share"))
