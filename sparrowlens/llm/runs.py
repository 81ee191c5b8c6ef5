"""Periodic runs of words, found from Lyndon words.

Under one of two opposite orders of the words, the longest Lyndon word that starts where a root of a run starts is
that root (the runs theorem). So a stack is scanned right to left under either order: what it pops to is the next
smaller suffix, whose distance is the length of the longest Lyndon word. Each such length is tried as a period and
extended both ways. Suffixes are compared word by word first and by a rolling hash with binary search where they
agree for longer; no suffix array is made. Every run is verified on the words themselves.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are compared one by one before hashes are asked.
DIRECT = 8
_PRIME, _BASE = (1 << 61) - 1, 0x1D872B41E3C5A9F7 % ((1 << 61) - 1)

RUN = "struct<start:long,length:long,period:long>"


class Words:
    """Words as numbers, with the longest common extension of two places; hashes are made when first asked for."""

    def __init__(self, numbers: list[int]):
        self.w, self.n = numbers, len(numbers)
        self.hash = self.power = None

    def _hashed(self) -> None:
        if self.hash is None:
            self.hash = list(accumulate(self.w, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
            self.power = list(accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1))

    def forward(self, i: int, j: int) -> int:
        """How many words from ``i`` on agree with those from ``j`` on (i < j)."""
        w, n = self.w, self.n
        most = n - j
        for k in range(min(DIRECT, most)):
            if w[i + k] != w[j + k]:
                return k
        if most <= DIRECT:
            return max(0, most)
        self._hashed()
        h, p = self.hash, self.power
        low, high = DIRECT, most + 1  # low words agree, high don't (or aren't there)
        step = DIRECT
        while low + step < high:  # gallop, then halve
            m = low + step
            if (h[i + m] - h[i + low] * p[step] - h[j + m] + h[j + low] * p[step]) % _PRIME:
                high = m
                break
            low, step = m, 2 * step
        while high - low > 1:
            m = (low + high) // 2
            q = p[m - low]
            if (h[i + m] - h[i + low] * q - h[j + m] + h[j + low] * q) % _PRIME:
                high = m
            else:
                low = m
        return low

    def backward(self, i: int, j: int) -> int:
        """How many words before ``i`` agree with those before ``j`` (i < j)."""
        w = self.w
        for k in range(min(DIRECT, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        if i <= DIRECT:
            return i
        self._hashed()
        h, p = self.hash, self.power
        low, high = DIRECT, i + 1
        step = DIRECT
        while low + step < high:
            m = low + step
            q = p[step]
            if (h[i - low] - h[i - m] * q - h[j - low] + h[j - m] * q) % _PRIME:
                high = m
                break
            low, step = m, 2 * step
        while high - low > 1:
            m = (low + high) // 2
            q = p[m - low]
            if (h[i - low] - h[i - m] * q - h[j - low] + h[j - m] * q) % _PRIME:
                high = m
            else:
                low = m
        return low


def candidates(words: Words, descending: bool, least_exponent: int):
    """Yield (place, period): the longest Lyndon words under an order whose next two copies may follow.

    The stack is kept as links to the next smaller suffix; a suffix that another begins with is the smaller one.
    """
    w, n = words.w, words.n
    after = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        x, j = w[i], i + 1
        while j < n:
            y = w[j]
            if y == x:
                k = words.forward(i, j)
                if j + k >= n or (w[j + k] < w[i + k]) != descending:
                    break
            elif (y < x) != descending:
                break
            j = after[j]
        after[i] = j
        if j < n and w[j] == x and i + (least_exponent - 1) * (j - i) <= n:
            yield i, j - i


def find_runs(found: list, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All (start, length, period) with length at least ``least_length`` and ``least_exponent`` (2 or more) periods, by start and period.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical)
    that no neighbouring word extends keeping period q.
    """
    number: dict = {}
    words = Words([number.setdefault(x, len(number)) for x in found])
    w, n, runs = words.w, words.n, set()
    for descending in (False, True):
        covered: dict[int, int] = {}  # by period: where the last run begins
        for i, p in candidates(words, descending, least_exponent):
            if i >= covered.get(p, n):
                continue
            right = words.forward(i, i + p)
            if right <= (least_exponent - 2) * p:  # the first root of a run has more of it behind
                continue
            left = words.backward(i, i + p)
            start, end = i - left, i + p + right
            covered[p] = start
            if end - start >= max(least_length, least_exponent * p):
                runs.add((start, end - start, p))
    for start, length, p in runs:
        end = start + length
        if w[start : end - p] != w[start + p : end] or (start and w[start - 1] == w[start - 1 + p]) or (end < n and w[end] == w[end - p]):
            raise ArithmeticError("two different stretches have the same rolling hash")
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(found: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run has after its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + length) for s, length, p in runs):
        if end > at:
            out += found[at:start]  # none if an earlier run reaches beyond
            at = end
    return out + found[at:]


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """Add ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` (the kept words, joined by a space).

    Words are runs without ASCII white space of the whole text, compared as they are; a null text
    has none, and neither has an empty one. Rows are independent of one another: nothing is
    shuffled, repeated rows and rows with null keys are returned as they come, an empty table gives
    an empty one. Columns of ``docs`` that are named ``runs`` or ``collapsed`` are replaced.
    """

    def scanned(texts: pa.Array) -> pa.Array:
        rows, kept, known = [], [], {}
        for t in texts.to_pylist():
            if t not in known:
                found = (t or b"").split()
                runs = find_runs(found, least_length, least_exponent)
                known[t] = runs, b" ".join(collapsed(found, runs)).decode("utf-8", "surrogatepass")
            rows.append(known[t][0])
            kept.append(known[t][1])
        flat = [r for row in rows for r in row]
        ends = [0]
        for row in rows:
            ends.append(ends[-1] + len(row))
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
        return pa.StructArray.from_arrays([lists, pa.array(kept, pa.string())], names=["runs", "collapsed"])

    both = F.arrow_udf(scanned, f"struct<runs:array<{RUN}>,collapsed:string>")
    return docs.withColumn("_found", both(F.col(text).cast("binary"))).withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (by cross products), ties to the smaller start, then period; null without runs."""
    none = F.lit(None).cast(RUN)
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | ((b["length"] * a["period"] == a["length"] * b["period"]) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])))
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a repeated ending in a tenth of the texts, which the CRC-32 of the decimal key tells.

    With h = crc32(key), g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Such a text's
    words are joined by single spaces. Rows with a null key keep their text.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    n = F.size("_w")
    place = split.withColumn("_a", F.when(n > 0, (g % n).cast("int")))
    place = place.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("_a")
    root = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    ending = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), ending), " ")
    return place.withColumn(text, F.when(F.col("_a").isNotNull(), changed).otherwise(F.col(text))).drop("_w", "_a", "_p")
