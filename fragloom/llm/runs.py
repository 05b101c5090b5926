"""Periodic runs of words through a Re-Pair grammar of each document.

1. The most frequent pair of neighbouring symbols becomes a rule until no pair occurs twice; what is left of the text is
   the start rule. Rules of one count are taken in the order in which their pairs came up, which keeps the grammar flat.
   The start rule's symbols are joined pairwise by a balanced tree, so every boundary is a nonterminal's.
2. A run lies in the text of one nonterminal and crosses its inner boundary. There the two words at the boundary recur a
   period away, so the other places of that word pair inside the nonterminal give all periods worth extending. That is
   done once per nonterminal, however often it is derived.
3. What a rule's boundary gives is moved to all places where the rule is derived, from the start rule downwards.
4. Stretches of one period that overlap by a period or more are one; stretches with a period that one of their divisors
   has as well are dropped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fragloom.llm.common import texts, words

LEAST = 6  # words of a run
TIMES = 4  # periods of a run


def word_ids(parts: list[bytes]) -> list[int]:
    """Numbers of words by first occurrence."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in parts]


def re_pair(text: list[int]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Rules (left, right) of the symbols from max(text) + 1 on, the start rule, and the place of each of its symbols.

    Replaced places are taken out of a doubly linked list; a pair keeps the places at which it was seen, and the ones
    that have changed since are skipped when its turn comes.
    """
    n, fresh = len(text), max(text) + 1
    symbol, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    spots: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(pairwise(text)):
        spots[pair].append(i)
    turn = 0
    heap = []
    for pair, at in spots.items():
        if len(at) > 1:
            heap.append((-len(at), turn, pair))
            turn += 1
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        size, _, pair = heapq.heappop(heap)
        left, right = pair
        there = [i for i in sorted(set(spots[pair])) if symbol[i] == left and after[i] < n and symbol[after[i]] == right]
        live, end = [], -1
        for i in there:
            if i >= end:  # places of "a a" in "a a a" overlap: the left one counts
                live.append(i)
                end = after[after[i]]
        if len(live) < -size:
            # fewer than thought: wait for its turn, or never
            spots[pair] = there
            if len(live) > 1:
                heapq.heappush(heap, (-len(live), turn, pair))
                turn += 1
            continue
        del spots[pair]
        name = fresh + len(rules)
        rules.append(pair)
        new: dict[tuple[int, int], list[int]] = {}
        for i in live:
            j = after[i]
            k = after[j]
            symbol[i], symbol[j] = name, -1
            after[i] = k
            if k < n:
                before[k] = i
                new.setdefault((name, symbol[k]), []).append(i)
            if (p := before[i]) >= 0:
                new.setdefault((symbol[p], name), []).append(p)
        for key, at in new.items():
            held = spots[key]
            held.extend(at)
            if len(held) > 1:
                heapq.heappush(heap, (-len(held), turn, key))
                turn += 1
    start, at, i = [], [], 0
    while i < n:
        start.append(symbol[i])
        at.append(i)
        i = after[i]
    return rules, start, at


def crossing(text: list[int], low: int, m: int, high: int, places: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches of text[low:high] across ``m`` with TIMES periods and LEAST words.

    ``places`` are those of the word pair at m - 1. A run across m has it a period to the right or to the left.
    """
    most = (high - low) // TIMES
    found: list[tuple[int, int, int]] = []
    own = m - 1
    at = bisect_left(places, max(low, own - most))
    steps = []
    while at < len(places) and places[at] <= min(high - 2, own + most):
        if places[at] != own:
            steps.append(abs(places[at] - own))
        at += 1
    for q in sorted(set(steps)):
        for x in (own, own - q):  # two runs of one period may cross the boundary, one to each side
            if x < low or x + q + 1 >= high or text[x] != text[x + q] or text[x + 1] != text[x + q + 1]:
                continue
            if any(q % p == 0 and s <= x and x + q + 1 < e for s, e, p in found):
                continue  # a whole period here has a period that divides it, and so has the stretch
            i = j = x  # words k and k + q are equal for k from i up to, not including, j
            while i > low and text[i - 1] == text[i - 1 + q]:
                i -= 1
            while j + q < high and text[j] == text[j + q]:
                j += 1
            if j + q - i >= max(LEAST, TIMES * q):
                found.append((i, j + q, q))
    return found


def merged(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Maximal (start, length, period) by start, then period, of stretches (start, end, period)."""
    by_period: dict[int, list[list[int]]] = {}
    for s, e, q in sorted(set(stretches)):
        own = by_period.setdefault(q, [])
        if own and own[-1][1] - s >= q:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    out = []
    for q, own in by_period.items():
        smaller = [by_period[p] for p in by_period if p < q and q % p == 0]
        for s, e in own:
            # stretches of one period start and end in the same order, so the last one that starts in time decides
            if not any((k := bisect_left(o, [s + 1, 0])) and o[k - 1][1] >= e for o in smaller):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of a word id sequence, by start, then period."""
    n = len(text)
    if n < LEAST:
        return []
    rules, start, at = re_pair(text)
    if not rules:
        return []  # no pair occurs twice
    fresh = max(text) + 1
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(pairwise(text)):
        places[pair].append(i)
    sizes = [1] * fresh + [0] * len(rules)
    for k, (a, b) in enumerate(rules):
        sizes[fresh + k] = sizes[a] + sizes[b]

    # where each rule is derived: the start rule's symbols, then each rule hands its places down
    derived: list[list[int]] = [[] for _ in rules]
    for s, i in zip(start, at):
        if s >= fresh:
            derived[s - fresh].append(i)
    stretches: list[tuple[int, int, int]] = []
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        left = sizes[a]
        if a >= fresh:
            derived[a - fresh].extend(derived[k])
        if b >= fresh:
            derived[b - fresh].extend([i + left for i in derived[k]])
        if left + sizes[b] >= LEAST:
            low = derived[k][0]
            m = low + left
            other = places[text[m - 1], text[m]]
            if len(other) > 1:
                for s, e, q in crossing(text, low, m, m + sizes[b], other):
                    stretches.extend([(s - low + i, e - low + i, q) for i in derived[k]])

    at.append(n)
    for j in range(1, len(start)):  # boundary j of a balanced tree over the start rule covers a power of two on both sides
        m = at[j]
        other = places[text[m - 1], text[m]]
        if len(other) > 1:
            reach = j & -j
            stretches.extend(crossing(text, at[j - reach], m, at[min(j + reach, len(start))], other))
    return merged(stretches)


def collapse(parts: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return parts
    edge = np.zeros(len(parts) + 1, "i8")
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed``.

    Words are parted by ASCII white space. A run is a stretch with smallest period q and max(6, 4 q) words or more that
    no neighbouring word extends keeping that period. ``collapsed`` joins the words that no run holds behind its first q words
    by one space. Whole texts, no shuffle. Null, empty and blank texts have no words, no runs and an empty ``collapsed``;
    repeated rows, equal and null ids stay; an empty table gives no rows; other columns are not read, whatever their
    names. Very long texts take time in proportion to their words, but for a factor of their logarithm.
    """
    rows = texts(docs, id_col, text_col).withColumnRenamed("_id", id_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                chunk = batch.slice(at, 256)
                sizes, found, left = [], [], []
                for text in chunk.column(1).to_pylist():
                    parts = (text or "").encode("utf-8", "surrogatepass").split()
                    runs = runs_of(word_ids(parts))
                    sizes.append(len(parts))
                    found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                    left.append(b" ".join(collapse(parts, runs)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(left, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(text: Column, number: Column) -> Column:
    """The text with a periodic tail where crc32 of the decimal ``number`` is divisible by ten; no change for null.

    With g = crc32 / 10, n words and a = g % n, word i from a on becomes word a + (i - a) % (1 + (n - a) / (3 + g % 8)).
    """
    crc = F.crc32(number.cast("string").cast("binary"))
    w = words(text)

    def tail(x: Column) -> Column:
        n, g = F.size(x), F.floor(crc / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.transform(x, lambda word, i: F.when(i < a, word).otherwise(F.get(x, a + F.pmod(i - a, p))))

    periodic = F.transform(F.array(w), lambda x: F.when(F.size(x) > 0, tail(x)).otherwise(x))[0]  # the words once
    return F.when(F.pmod(crc, F.lit(10)) == 0, F.array_join(periodic, " ")).otherwise(text)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: counts, the longest run, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_l", longest).select(
        F.col(f"`{id_col}`"), "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("_l.s")).alias("start"), F.col("_l.length").alias("length"), (-F.col("_l.p")).alias("period"),
        F.floor(1000 * F.col("_l.length") / -F.col("_l.p")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
