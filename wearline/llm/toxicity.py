"""Toxicity by a learned lexicon whose misspellings a Levenshtein automaton finds in the lexicon's trie.

1. The lexicon is learned from a bounded sample of labelled rows (`SAMPLE_LABELS`, chosen by a hash of the id): words, and stems that
   many words begin with, that far more toxic than clean documents hold than chance allows.
2. The lexicon is a trie. A word matches a term exactly, begins with a stem, or is a misspelling: one edit or one swap of neighbours away
   from a term, two from a term of `LONG_LETTERS` or more letters. The automaton of these bounds, swaps included, is intersected with the
   trie and made deterministic as words need it; a word leaves it after a few letters where no term is near. Words are runs of letters; where none of a run's words is a hit, what stands between
   spaces is tried as a whole, with its digits and signs. Words that clean documents of the sample hold are ordinary words and not misspellings.
3. Each hit is weighed by its context window: inside quotation marks or after a word of speaking it counts as quoted, else as abuse.
4. A logistic regression over a few numbers per document (abuse, quoted, misspelled hits and their rate) gives the score. It is fitted
   on a part of the sample that the lexicon for the fit was not learned from; the final lexicon then uses the whole sample.

Labels are used for learning only. Defined results: NULL and empty texts score like texts without hits. A document labelled more than once
is toxic if one label says so. Without toxic labels nothing is learned, and every score is 0. Rows pass through one by one, and texts of any length are read whole.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import Memo, arrow_map, crc_bucket, held, whole_text

SAMPLE_LABELS = 20_000
THRESHOLD = 0.3
#: Fixed by the contract: documents of this fold are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Shortest and longest stem.
STEMS = (4, 7)
#: Fewest letters of a term that may be misspelled with letters, with digits or signs, and by two edits.
FUZZY_LETTERS, MASKED_LETTERS, LONG_LETTERS = 4, 3, 6
#: Fewest toxic documents that hold a term, smallest log odds, and the chance (per term) at which a term counts.
SUPPORT, ODDS, CHANCE = 4, 2.5, 1e-6
#: Terms kept, best first.
TERMS = 5_000
#: Words on each side that make the context of a hit.
WINDOW = 4
#: Words that announce a quotation.
SPEAKING = frozenset("said says say saying called calls quote quoted quoting wrote word term sagte sagt nannte schrieb wort dit disait appelé écrit mot dijo dice llamó escribió palabra".split())
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")
#: What stands between spaces and quotation marks, and where it is parted if it is no term as a whole.
_CHUNK = re.compile(r"[^\s\"“”„«»]+|[\"“”„«»]")
_EDGE = ".,;:!?()[]{}<>/–—…-"
_PARTED = re.compile(f"[{re.escape(_EDGE)}]+")
#: Longest run that is remembered.
_CHUNK_CHARS = 64


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    #: misspellings that are ordinary words
    ordinary: frozenset[str]


class Automaton:
    """The Levenshtein automaton of all words within a term's bound, intersected with the trie of the terms.

    A position is a place in the trie, the edits so far, whether one of them was a swap, and the letter a swap still waits for. Terms of
    `LONG_LETTERS` or more letters allow two edits, others one. Sets of positions become the states of a deterministic automaton when a word
    first needs them; a word without a term near it ends in the empty state after a few letters. States are bounded and start anew when full.
    """

    STATES = 50_000

    def __init__(self, terms: list[str]):
        self.below: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # edits the most tolerant term at or below a place allows
        for term in terms:
            bound, at = self.bound(term), 0
            self.most[0] = max(self.most[0], bound)
            for letter in term:
                if letter not in self.below[at]:
                    self.below[at][letter] = len(self.below)
                    self.below.append({})
                    self.term.append(None)
                    self.most.append(0)
                at = self.below[at][letter]
                self.most[at] = max(self.most[at], bound)
            self.term[at] = term
        self.letters = {letter for term in terms for letter in term}
        self._clear()

    @staticmethod
    def bound(term: str) -> int:
        return 2 if len(term) >= LONG_LETTERS else 1

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {(): 0}
        self.sets: list[tuple] = [()]
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple | None] = [()]
        self.start = self._number(self._closed({(0, False, ""): 0}))

    def _closed(self, positions: dict[tuple, int]) -> tuple:
        """With the places that letters missing from the word lead to; of equal places the one with the fewest edits."""
        waiting = [k for k in positions if not k[2]]
        while waiting:
            place, swapped, _ = key = waiting.pop()
            edits = positions[key] + 1
            for child in self.below[place].values():
                to = (child, swapped, "")
                if edits <= self.most[child] and positions.get(to, 9) > edits:
                    positions[to] = edits
                    waiting.append(to)
        return tuple(sorted((k, e) for k, e in positions.items() if not (k[1] and not k[2] and positions.get((k[0], False, ""), 9) <= e)))

    def _number(self, found: tuple) -> int:
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            self.ends.append(None)
        return number

    def _step(self, state: int, letter: str) -> int:
        new: dict[tuple, int] = {}

        def add(key: tuple, edits: int) -> None:
            if edits <= self.most[key[0]] and new.get(key, 9) > edits:
                new[key] = edits

        for (place, swapped, awaited), edits in self.sets[state]:
            if awaited:
                if letter == awaited:
                    add((place, swapped, ""), edits)
                continue
            below = self.below[place]
            if letter in below:
                add((below[letter], swapped, ""), edits)
            if edits < self.most[place]:
                add((place, swapped, ""), edits + 1)  # a letter too many
                for other, child in below.items():
                    if other != letter:
                        add((child, swapped, ""), edits + 1)
                        if letter in self.below[child]:
                            add((self.below[child][letter], True, other), edits + 1)
        return self._number(self._closed(new))

    def near(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The terms within one edit of a word, and those within their bound where swaps are edits too; both by name."""
        if len(self.sets) > self.STATES:
            self._clear()
        state = self.start
        for letter in word:
            if letter not in self.letters:
                letter = ""
            following = self.steps[state].get(letter)
            if following is None:
                following = self._step(state, letter)
                self.steps[state][letter] = following
            state = following
            if not state:
                return (), ()
        if self.ends[state] is None:
            at = [(self.term[k[0]], k[1], e) for k, e in self.sets[state] if not k[2] and self.term[k[0]] is not None]
            self.ends[state] = tuple(sorted({t for t, swapped, e in at if e <= 1 and not swapped})), tuple(sorted({t for t, _, e in at if e <= self.bound(t)}))
        return self.ends[state]


class Trie:
    """What the words of a text are to a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        terms = [t for t in lexicon.words if len(t) >= MASKED_LETTERS]
        self.longest = max(map(len, terms), default=0)
        self.automaton = Automaton(terms)
        self.classes = Memo(lambda word: self._judged(word)[0], 10_000, _CHUNK_CHARS)
        self.kinds = Memo(lambda word: self._judged(word)[1], 100_000, _CHUNK_CHARS)
        self.parts = Memo(self._parts, 120_000)

    def misspelled(self, word: str) -> str | None:
        """The first term (by name) within one edit of a word."""
        return next((t for t in self.automaton.near(word)[0] if len(t) >= _fewest(word)), None)

    def slipped(self, word: str) -> str | None:
        """The first term (by name) within one edit or swap of neighbours of a word, or two for long terms."""
        return next((t for t in self.automaton.near(word)[1] if len(t) >= _fewest(word)), None)

    def _judged(self, word: str) -> tuple[tuple[int, float], tuple[int, float]]:
        """(0 no hit, 1 word, 2 stem, 3 misspelled) and the weight of a word: by one edit only, and where swapped neighbours and two
        edits of a long term count as misspelled too."""
        lexicon, found = self.lexicon, (0, 0.0)
        if word in lexicon.words:
            found = 1, lexicon.words[word]
        else:
            for size in range(STEMS[1], STEMS[0] - 1, -1):
                if len(word) > size and word[:size] in lexicon.stems:
                    found = 2, lexicon.stems[word[:size]]
                    break
        if found[0] or word in lexicon.ordinary or len(word) > self.longest + 2:
            return found, found
        if term := self.misspelled(word):
            found = 3, lexicon.words[term]
            return found, found
        term = self.slipped(word)
        return found, (3, lexicon.words[term]) if term else found

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """The words of what stands between spaces; a whole with digits or signs where that is a misspelling and no word in it is a hit."""
        words = _TOKEN.findall(chunk)
        if chunk.isalpha() or not words or chunk in _QUOTES or any(self.kinds[w][0] for w in words):
            return tuple(words)
        for whole in dict.fromkeys((chunk.strip(_EDGE), _trimmed(chunk))):
            # every digit or sign is an edit
            if MASKED_LETTERS - 1 <= len(whole) <= self.longest + 2 and 0 < sum(not c.isalpha() for c in whole) <= 2 and self.kinds[whole][0]:
                return (whole,)
        pieces = [p for p in _PARTED.split(chunk) if p]
        if len(pieces) > 1:
            return tuple(w for p in pieces for w in self._parts(p))
        return tuple(words)

    def tokens(self, text: str) -> list[str]:
        """The words and quotation marks of a text."""
        parts = self.parts
        return [t for c in _CHUNK.findall(text.lower()) for t in (parts[c] if len(c) <= _CHUNK_CHARS else self._parts(c))]

    def numbers(self, text: str) -> list[float]:
        """What the regression sees of a text."""
        tokens = self.tokens(text)
        kinds = self.kinds
        hits = [i for i, t in enumerate(tokens) if kinds[t][0]]
        sums = [0.0] * 4  # words, stems and masked words that abuse, quoted ones, misspelled ones, all hits
        for i in hits:
            kind, weight = kinds[tokens[i]]
            quoted = self._quoted(tokens, i)
            sums[1 if quoted else 2 if kind == 3 and tokens[i].isalpha() else 0] += weight  # a term with digits or signs in it is meant
            sums[3] += 1
        return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(1000 * sums[3] / (len(tokens) + 50))]

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        inside = any(t in _QUOTES for t in before) and any(t in _QUOTES for t in after)
        return inside or any(t in SPEAKING for t in before)


def _trie(packed: bytes) -> Trie:
    """One trie per worker and lexicon, with what it remembers of words, for all tasks of the worker."""
    return held(("toxicity", packed), lambda: Trie(pickle.loads(packed)))


def _fewest(word: str) -> int:
    return FUZZY_LETTERS if word.isalpha() else MASKED_LETTERS


def _trimmed(chunk: str) -> str:
    """A chunk without what stands before its first and behind its last letter or digit."""
    kept = [i for i, c in enumerate(chunk) if c.isalnum()]
    return chunk[kept[0] : kept[-1] + 1]


class Model(NamedTuple):
    lexicon: Lexicon
    weights: tuple[float, ...]


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, FOLDS) == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, toxic, fold) of at most `sample` labelled documents."""
    chosen = (
        labels.where(~held_out(id_col) & F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit("toxicity sample")), "doc_id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold"))  # at most `sample` rows


def _features(text: str) -> set[str]:
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
    return words | {w[:n] + "*" for w in words for n in range(STEMS[0], STEMS[1] + 1) if len(w) > n}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems that tell toxic from clean documents of the sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[bool(toxic)].update(_features(text))
                seen[bool(toxic)][""] += 1
            names = list({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[n] for n in names], pa.int64()) for s in seen]], names=["term", "clean", "toxic"])

    counts = arrow_map(sample.select("text", "toxic"), counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals, found = {}, []
    for r in counts.where((F.col("term") == "") | ((F.col("toxic") >= SUPPORT) & (F.col("toxic") > F.col("clean")))).collect():  # bounded by the sample
        if r["term"] == "":
            totals = {"toxic": r["toxic"], "clean": r["clean"]}
        else:
            found.append((r["term"], r["toxic"], r["clean"]))
    if not totals or not totals["toxic"]:
        return Lexicon({}, {}, frozenset())
    share = totals["toxic"] / (totals["toxic"] + totals["clean"])
    kept = []
    for term, toxic, clean in found:
        odds = math.log((toxic + 0.5) / (totals["toxic"] + 1)) - math.log((clean + 0.5) / (totals["clean"] + 1))
        if odds >= ODDS and _tail(toxic + clean, toxic, share) <= math.log(CHANCE):
            kept.append((odds, toxic, term))
    kept = sorted(kept, key=lambda k: (-k[0], k[2]))[:TERMS]
    words = {t: o for o, _, t in kept if not t.endswith("*")}
    most: dict[str, int] = {}  # documents of the most frequent term that begins with a stem
    for _, toxic, term in kept:
        for n in range(STEMS[0], min(STEMS[1], len(term)) + 1):
            if not term.endswith("*"):
                most[term[:n]] = max(most.get(term[:n], 0), toxic)
    stems = {t[:-1]: o for o, toxic, t in kept if t.endswith("*") and toxic > 1.2 * most.get(t[:-1], 0)}  # more than one word's beginning
    return Lexicon(words, stems, _ordinary(sample, Lexicon(words, stems, frozenset())))


def _tail(n: int, least: int, share: float) -> float:
    """Log of an upper bound of P(X >= least) for X binomial."""
    p = least / n
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def _ordinary(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Misspellings of a term that clean documents of the sample hold."""
    packed = pickle.dumps(lexicon)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(packed)
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in {*trie.tokens(t)} if trie.kinds[w][0] == 3}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return frozenset(r["word"] for r in arrow_map(sample.where("toxic = 0").select("text"), near, "word string").distinct().collect())


def numbers(texts: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of `texts` with `x`, what the regression sees, in place of the text."""
    packed = pickle.dumps(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(packed)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            kept = [i for i in range(batch.num_columns) if i != at]
            found = [trie.numbers(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, pa.list_(pa.float64()))], names=[*[batch.schema.names[i] for i in kept], "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text_col)
    return arrow_map(texts, rows, f"{fields}, x array<double>")


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps of a ridge-penalised logistic regression; the bias comes last."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_labels: int = SAMPLE_LABELS) -> Model:
    """The lexicon and the regression's weights."""
    sample = labelled_sample(docs, labels, id_col, text_col, sample_labels).persist()
    try:
        part = learn_lexicon(sample.where("fold <> 0"))
        seen = numbers(sample.where("fold = 0"), part).select("toxic", "x").toPandas()  # bounded by the sample
        lexicon = learn_lexicon(sample)
    finally:
        sample.unpersist()
    if not len(seen) or seen["toxic"].sum() == 0 or not (lexicon.words or lexicon.stems):
        return Model(lexicon, (0.0, 0.0, 0.0, 0.0, -math.inf))
    return Model(lexicon, fit_weights(np.array(seen["x"].tolist()), seen["toxic"].to_numpy(dtype=float)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    seen = numbers(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text")), model.lexicon)
    return seen.select("doc_id", "held_out", _score(model).alias("score")).select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _score(model: Model) -> Column:
    *weights, bias = model.weights
    if bias == -math.inf:
        return F.lit(0.0)
    return 1 / (1 + F.exp(-sum((F.get("x", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(bias))))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns; rows stay where they are."""
    seen = numbers(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), whole_text(text_col).alias("text")), model.lexicon)
    return seen.where(_score(model) < threshold).select("d.*")
