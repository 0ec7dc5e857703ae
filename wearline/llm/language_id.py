"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its character n-grams with its
borders marked: the longest size of which some n-gram is known counts, from four characters down to one.

The model is learned from a sample of the labelled documents, `SAMPLE_DOCS` in expectation, chosen by a hash of the id; words and n-grams seen
less than `LEAST_SEEN` times in it are left out, so the model's size is bounded by the sample and not by the corpus. Prediction reads every whole text.

Defined results: `und` with score 0 if the text is NULL, has no letters, or nothing was learned. Else the score is the posterior of the predicted
language with equal priors, tempered to ten words. Ties go to the first language by name. Rows pass through one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, crc_bucket, whole_text

SAMPLE_DOCS = 20_000
LEAST_SEEN = 3
LONGEST = 4
#: Fixed by the contract: documents of this fold are never learned from.
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Added to every count.
_SMOOTH = 0.5


class Model(NamedTuple):
    languages: list[str]
    #: size (0: words) -> gram -> its row
    tables: dict[int, dict[str, int]]
    #: size -> log frequency of every gram per language, less the mean over languages
    logs: dict[int, np.ndarray]


def words(text: str) -> list[str]:
    """Runs of letters; numerals such as fractions or raised digits are none and part words."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join([c if c.isalpha() else " " for c in run]).split())]


def grams(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, FOLDS) == HELD_OUT


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Counts words and n-grams of the sample by language."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    total = labelled.count()
    if total > sample_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30)) < int(sample_docs / total * (1 << 30)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            rows: Counter = Counter()
            for lang, found in seen.items():
                for word, n in found.items():
                    rows[lang, 0, word] += n
                    for size in range(1, LONGEST + 1):
                        for gram in grams(word, size):
                            rows[lang, size, gram] += n
            parts = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "size", "gram", "n"])

    counts = arrow_map(labelled.select(whole_text(text_col), F.col(lang_col).cast("string").alias("lang")), counted, "lang string, size int, gram string, n long")
    kept = counts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).toPandas()  # bounded by the sample
    languages = sorted(kept["lang"].unique())
    column = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, int]] = {}
    logs: dict[int, np.ndarray] = {}
    for size in range(LONGEST + 1):
        part = kept[kept["size"] == size]
        table = tables[size] = {gram: i for i, gram in enumerate(sorted(part["gram"].unique()))}
        counts = np.full((len(table), len(languages)), _SMOOTH)
        np.add.at(counts, (part["gram"].map(table).to_numpy(dtype=np.int64), part["lang"].map(column).to_numpy(dtype=np.int64)), part["n"].to_numpy())
        shares = np.log(counts / np.maximum(counts.sum(axis=0), _SMOOTH))
        logs[size] = (shares - shares.mean(axis=1, keepdims=True)).astype(np.float32) if languages else shares
    return Model(languages, tables, logs)


class Classifier:
    """Scores texts; what a word adds is remembered in a bounded matrix."""

    def __init__(self, model: Model, size: int = 300_000):
        self.model, self.size = model, size
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((size, len(model.languages)), dtype=np.float32)

    def word(self, word: str) -> np.ndarray:
        """What one word adds per language: its own entry, else the mean over its longest known n-grams."""
        tables, logs = self.model.tables, self.model.logs
        if (known := tables[0].get(word)) is not None:
            return logs[0][known]
        for size in range(LONGEST, 0, -1):
            if found := [tables[size][g] for g in grams(word, size) if g in tables[size]]:
                return logs[size][found].mean(axis=0)
        return np.zeros(len(self.model.languages), dtype=np.float32)

    def __call__(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        rows = self.rows
        for start in range(0, len(found), 20_000):
            some = found[start : start + 20_000]
            for w in {w for w in some if w not in rows}:
                if len(rows) >= self.size - 20_000:
                    rows.clear()
                    self._remember({*some})
                    break
                self._remember({w})
            total += self.matrix[np.fromiter((rows[w] for w in some), dtype=np.int64, count=len(some))].sum(axis=0, dtype=np.float64)
        total *= min(len(found), 10) / len(found)
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.languages[best], float(odds[best] / odds.sum())

    def _remember(self, some: set[str]) -> None:
        for w in some:
            self.rows[w] = len(self.rows)
            self.matrix[self.rows[w]] = self.word(w)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            found = [classify(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    return arrow_map(picked, rows, "doc_id long, held_out boolean, lang_pred string, score double")
