"""Periodic runs of words, found on a grammar.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 3 * q)`` words that no neighbouring word extends.

1. Every run consists of grams of `GRAM` words that occur again q words on, so only stretches covered by repeated grams are read further.
2. Re-Pair turns their word ids into a grammar: a round replaces every pair that is more frequent than the pairs it overlaps, until none
   repeats; what is left is paired up as a balanced tree. All documents of a chunk share one grammar, so a passage is compressed once.
3. A run lies in the lowest node of the derivation that holds it and crosses the boundary between that node's two halves. Per nonterminal,
   once, all periods are tried at the boundary: longest common extensions to both sides come from names of words sequences of 1, 2, 4, ... words.
4. These runs are translated to every place the nonterminal is derived at; of one period, only maximal intervals stay.

Work per word is bounded by the logarithm of its text's length; a task holds one chunk of about a million words (or one longer text) at a time.

Defined results: NULL and empty texts have no words and no runs. Rows that repeat an id stay rows of their own. Equal runs cannot occur; runs are
in order of start, then period. Very long texts are chunks of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map
from wearline.llm.words import chunks, list_column, mixed, spaced_words

#: Fewest words and fewest periods of a run.
LEAST, PERIODS = 24, 3
#: A stretch of period q and length max(24, 3q) less q holds at least 16 starts of equal words, hence a gram of 8 on either side of any of them.
GRAM = 8
#: Pairs of node and period tried at once.
TRIED = 1_000_000


def repeated_stretches(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of stretches of one document in which every word lies in a gram the document repeats."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread = mixed(ids.astype(np.uint64) + np.uint64(1))
    key = mixed(doc[:n].astype(np.uint64))
    for j in range(GRAM):
        key = key * np.uint64(0x9E3779B97F4A7C15) + spread[j : j + n]
    inside = doc[:n] == doc[GRAM - 1 :]
    places = np.flatnonzero(inside)
    order = places[np.argsort(key[places], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, dtype=np.int32)
    change[: n][again] += 1
    change[GRAM : GRAM + n][again] -= 1
    covered = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    cuts = np.flatnonzero(covered[1:] & covered[:-1] & (doc[1:] != doc[:-1])) + 1
    starts, stops = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
    long = stops - starts >= LEAST
    return starts[long], stops[long]


class Grammar:
    """Re-Pair over stretches of words that a word of its own separates.

    Nodes of at least `LEAST` words are kept: their first place, boundary and stop there (`first`, `middle`, `stop`), and all places they
    are derived at (`node`, `place`).
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.occurrences: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes = 0
        symbol, place, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), dtype=np.int64)
        symbol, place, size = self._pairs(symbol, place, size)
        inside = stretch[place] >= 0
        self._tree(place[inside], size[inside], stretch[place[inside]])
        empty = np.zeros(0, dtype=np.int64)
        self.first, self.middle, self.stop = (np.concatenate([empty, *c]) for c in (zip(*self.parts, strict=True) if self.parts else ((), (), ())))
        self.node, self.place = (np.concatenate([empty, *c]) for c in (zip(*self.occurrences, strict=True) if self.occurrences else ((), ())))

    def _keep(self, kind: np.ndarray, place: np.ndarray, middle: np.ndarray, size: np.ndarray) -> None:
        """Records the nodes of new symbols at all their places; `kind` numbers the symbols."""
        long = size >= LEAST
        kind, place, middle, size = kind[long], place[long], middle[long], size[long]
        if len(kind):
            _, first, number = np.unique(kind, return_index=True, return_inverse=True)
            self.parts.append((place[first], middle[first], place[first] + size[first]))
            self.occurrences.append((number + self.nodes, place))
            self.nodes += len(first)

    def _pairs(self, symbol: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        fresh = int(symbol.max(initial=0)) + 1
        while len(symbol) > 1:
            pairs, kind, count = np.unique((symbol[:-1] << 32) | symbol[1:], return_inverse=True, return_counts=True)
            if count.max() < 2:
                break
            # ties go by a hash, so that equally frequent pairs of a passage are replaced side by side
            rank = np.where(count > 1, (count << 31) + (mixed(pairs.astype(np.uint64)) >> np.uint64(33)).astype(np.int64), -1)[kind]
            before, after = np.concatenate([[-1], rank[:-1]]), np.concatenate([rank[1:], [-1]])
            spot = np.arange(len(rank))
            # a pair of equal symbols overlaps itself: every other one of such a chain
            chain = np.maximum.accumulate(np.where(rank != before, spot, 0))
            chosen = np.flatnonzero((rank >= 0) & (rank >= before) & (rank >= after) & ((spot - chain) % 2 == 0))
            _, number = np.unique(kind[chosen], return_inverse=True)
            self._keep(number, place[chosen], place[chosen + 1], size[chosen] + size[chosen + 1])
            symbol[chosen] = fresh + number
            size[chosen] += size[chosen + 1]
            fresh += int(number.max()) + 1
            left = np.ones(len(symbol), dtype=bool)
            left[chosen + 1] = False
            symbol, place, size = symbol[left], place[left], size[left]
        return symbol, place, size

    def _tree(self, place: np.ndarray, size: np.ndarray, stretch: np.ndarray) -> None:
        while len(place) > 1:
            spot = np.arange(len(place))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], stretch[1:] != stretch[:-1]]), spot, 0))
            chosen = spot[:-1][((spot - start)[:-1] % 2 == 0) & (stretch[1:] == stretch[:-1])]
            if not len(chosen):
                break
            self._keep(chosen, place[chosen], place[chosen + 1], size[chosen] + size[chosen + 1])
            size[chosen] += size[chosen + 1]
            left = np.ones(len(place), dtype=bool)
            left[chosen + 1] = False
            place, size, stretch = place[left], size[left], stretch[left]


class Names:
    """Numbers of all sequences of 1, 2, 4, ... words; equal numbers mean equal sequences."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        self.level = [words.astype(np.int64)]
        while 2 ** len(self.level) <= max(GRAM, longest):
            width, last = 2 ** (len(self.level) - 1), self.level[-1]
            named = -1 - np.arange(n)  # sequences that would pass the end equal nothing
            if n >= 2 * width:
                base = int(last.max(initial=0)) + 1
                both = last[: n - 2 * width + 1] * base + last[width : n - width + 1]
                named[: n - 2 * width + 1] = np.unique(both, return_inverse=True)[1]
            self.level.append(named)

    def gram(self, at: np.ndarray) -> np.ndarray:
        """Names of `GRAM` words; places off the words have names of their own."""
        inside = np.clip(at, 0, len(self.level[3]) - 1)
        return np.where(at == inside, self.level[3][inside], -(2**40) - at)

    def forward(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many words from `a` on equal those from `b` on, up to `stop`; `a` lies before `b`."""
        done = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            fits = b + done + (1 << k) <= stop
            i = np.flatnonzero(fits)
            done[i] += (self.level[k][a[i] + done[i]] == self.level[k][b[i] + done[i]]).astype(np.int64) << k
        return done

    def backward(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words before `a` equal those before `b`, down to `first`; `a` lies before `b`."""
        done = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            fits = a - done - (1 << k) >= first
            i = np.flatnonzero(fits)
            done[i] += (self.level[k][a[i] - done[i] - (1 << k)] == self.level[k][b[i] - done[i] - (1 << k)]).astype(np.int64) << k
        return done


def crossing(grammar: Grammar, names: Names) -> tuple[np.ndarray, ...]:
    """(node, start, stop, period) of the runs within a node's first place that cross its boundary, each with its smallest period."""
    first, middle, stop = grammar.first, grammar.middle, grammar.stop
    tries = (stop - first) // PERIODS
    ends = np.cumsum(tries)
    found = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, TRIED):
        flat = np.arange(low, min(low + TRIED, int(ends[-1])))
        node = np.searchsorted(ends, flat, side="right")
        q = flat - (ends[node] - tries[node]) + 1
        m, lo, hi = middle[node], first[node], stop[node]
        # the last word of the left half has a partner to its right ...
        right = (m - 1 + q < hi) & ((names.gram(m - GRAM) == names.gram(m - GRAM + q)) | (names.gram(m - 1) == names.gram(m - 1 + q)))
        i = np.flatnonzero(right)
        back, ahead = names.backward(m[i], m[i] + q[i], lo[i]), names.forward(m[i], m[i] + q[i], hi[i])
        found.append((node[i], m[i] - back, m[i] + q[i] + ahead, q[i], back > 0))
        # ... or the word q before the boundary has one in the right half
        left = (m - q >= lo) & ((names.gram(m - q) == names.gram(m)) | (names.gram(m - q - GRAM + 1) == names.gram(m - GRAM + 1)))
        i = np.flatnonzero(left)
        back, ahead = names.backward(m[i] - q[i], m[i], lo[i]), names.forward(m[i] - q[i], m[i], hi[i])
        found.append((node[i], m[i] - q[i] - back, m[i] + ahead, q[i], ahead > 0))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    node, start, end, q, crosses = (np.concatenate(c) for c in zip(*found, strict=True))
    good = np.flatnonzero(crosses & (end - start >= np.maximum(LEAST, PERIODS * q)))
    good = good[np.lexsort((q[good], end[good], start[good], node[good]))]
    node, start, end, q = node[good], start[good], end[good], q[good]
    least = np.ones(len(node), dtype=bool)  # of one interval, the smallest period
    least[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[least], start[least], end[least], q[least]


def translated(grammar: Grammar, node: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal intervals (start, end, period) at all places of the derivation."""
    order = np.argsort(grammar.node, kind="stable")
    begin = np.searchsorted(grammar.node[order], np.arange(grammar.nodes + 1))
    times = begin[node + 1] - begin[node]
    run = np.repeat(np.arange(len(node)), times)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    shift = grammar.place[order[begin[node[run]] + nth]] - grammar.first[node[run]]
    start, end, q = start[run] + shift, end[run] + shift, q[run]
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    # every interval of a period lies in a maximal one of that period, which starts no later and comes first
    rank = np.cumsum(np.concatenate([[0], (q[1:] != q[:-1]).astype(np.int64)])) if len(q) else q
    high = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + rank * high)
    maximal = np.ones(len(q), dtype=bool)
    maximal[1:] = end[1:] + rank[1:] * high > np.maximum(reach[:-1], rank[1:] * high)
    return start[maximal], end[maximal], q[maximal]


def runs(docs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of every document's word numbers, by start, then period."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *docs])
    doc = np.repeat(np.arange(len(docs)), lengths)
    starts, stops = repeated_stretches(ids, doc)
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(starts):
        return [none] * len(docs)
    sizes = stops - starts
    heads = np.cumsum(sizes + 1) - (sizes + 1)  # a separator follows each stretch
    stretch = np.repeat(np.arange(len(starts)), sizes + 1)
    place = np.arange(len(stretch)) - heads[stretch] + starts[stretch]
    separator = place == stops[stretch]
    words = np.where(separator, int(ids.max()) + 1 + stretch, ids[np.minimum(place, len(ids) - 1)]).astype(np.int64)
    grammar = Grammar(words, np.where(separator, -1, stretch))
    longest = int((grammar.stop - grammar.first).max(initial=0))
    start, end, q = translated(grammar, *crossing(grammar, Names(words, longest)))
    if not len(start):
        return [none] * len(docs)
    of = doc[place[start]]
    begins = np.cumsum(lengths) - lengths
    table = np.stack([place[start] - begins[of], end - start, q], axis=1)
    order = np.lexsort((table[:, 2], table[:, 0], of))
    return np.split(table[order], np.searchsorted(of[order], np.arange(1, len(docs))))


def collapsed(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The words that are in the first period of every run that holds them."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return words[np.cumsum(change[:-1]) == 0]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, known in chunks(batches, spaced_words):
            found = runs(words)
            texts = [b" ".join(map(known.__getitem__, (collapsed(w, f) if len(f) else w).tolist())).decode("utf-8", "surrogatepass") for w, f in zip(words, found, strict=True)]
            parts = [list_column([f[:, j] for f in found], pa.int64()) for j in range(3)]
            table = pa.ListArray.from_arrays(parts[0].offsets, pa.StructArray.from_arrays([p.values for p in parts], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), table, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, schema)


def summary(found: DataFrame) -> DataFrame:
    """Counts, the run with the greatest exponent (compared exactly; ties: smallest start, then period) and the digests of `periodic_runs`."""

    def better(best, run):
        ours, theirs = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(ours > theirs, run).otherwise(best)  # runs come by start, then period

    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", 0), better))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (
        found.withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where one text in ten repeats a stretch of its words to its end, as the crc32 h of its decimal id decides.

    With g = h div 10 and n words: if h mod 10 is 0, each word i from a = g mod n on becomes word a + (i - a) mod p, with
    p = 1 + (n - a) div (3 + g mod 8); words are then joined by one space. Other texts, empty ones and NULL ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size("words").cast("long")
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("words", F.when(h % 10 == 0, words))
    changed = (
        marked.withColumn("g", g).withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
        .withColumn("changed", F.expr("concat_ws(' ', slice(words, 1, int(a)), transform(sequence(a, size(words) - 1L), i -> words[int(a + (i - a) % p)]))"))
    )
    return changed.select("doc_id", F.when(F.col("a").isNotNull(), F.col("changed")).otherwise(F.col("text")).alias("text"))
