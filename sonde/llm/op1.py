"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import stored

FIT_DOCS = 20_000       # labelled rows that are read to fit, at most
FIT_WORDS = 50_000      # words kept for each language
LONGEST = 5             # n-grams of unseen words: 5, 4, 3, 2, 1 characters
CACHE = 300_000         # words a worker remembers; it starts anew beyond
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id bigint, lang_pred string, score double"


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> dict:
    """Log frequencies of words and n-grams by language, from (text, lang) rows with both present.

    At most `fit_docs` rows are read, those of the smallest hashes of text and language, equal ones once, and of each language the
    `fit_words` most frequent words are kept: the model is bounded, and collected only after counting on
    the executors.  Without rows the model knows no language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", "lang").alias("_h"))
    last = rows.select("_h").distinct().orderBy("_h").limit(fit_docs).agg(F.max("_h")).first()[0]
    rows = rows.where(F.col("_h") <= F.lit(last).cast("bigint")).groupBy("_h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    found = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counts = stored(found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    model = {"langs": langs, "total": [total[x] for x in langs], "words": {}, "grams": [{} for _ in range(LONGEST + 1)]}
    for i, lang in enumerate(langs):
        kept = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(fit_words).select("word", "n").toArrow()
        for word, n in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist()):
            model["words"].setdefault(word, {})[i] = n
            padded = f" {word} "
            for size in range(1, LONGEST + 1):
                grams = model["grams"][size]
                for at in range(len(padded) - size + 1):
                    found = grams.setdefault(padded[at:at + size], [0] * len(langs))
                    found[i] += n
    for size in range(2, LONGEST + 1):  # a single sighting says little and takes most of the room
        model["grams"][size] = {g: c for g, c in model["grams"][size].items() if sum(c) > 2}
    # Summed once here, as every task makes a scorer.
    model["mass"] = [np.log(np.sum(list(g.values()), axis=0) + float(max(len(g), 1))) if g else np.zeros(len(langs)) for g in model["grams"]]
    return model


class Scorer:
    """Scores texts by a fitted model; holds the score vectors of words it has met."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.size = len(self.langs)
        self.total = np.log(np.array(model["total"], float) + 1.0) if self.size else np.empty(0)
        self.words, self.grams, self.mass = model["words"], model["grams"], model["mass"]
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, self.size))

    def vector(self, word: str) -> np.ndarray:
        """Per-language log frequency of a known word; else the mean over its letters of the longest known n-grams."""
        seen = self.words.get(word)
        if seen:
            return np.log(np.array([seen.get(i, 0) for i in range(self.size)], float) + 0.1) - self.total
        padded, out, parts, at = f" {word} ", np.zeros(self.size), 0, 0
        while at < len(padded):
            for size in range(min(LONGEST, len(padded) - at), 0, -1):
                counts = self.grams[size].get(padded[at:at + size])
                if counts:
                    out += np.log(np.array(counts, float) + 0.5) - self.mass[size]
                    parts += 1
                    at += size
                    break
            else:
                at += 1
        return out / parts if parts else out

    def score(self, text: str | None) -> tuple[str, float]:
        found = Counter(WORD.findall(text.lower())) if text else None
        if not found or not self.size or not any(c.isalpha() for word in found for c in word):
            return "und", 0.0
        if len(self.known) + len(found) > CACHE:
            self.known.clear()
        at = []
        for word in found:
            i = self.known.get(word)
            if i is None:
                i = self.known[word] = len(self.known)
                if i >= len(self.table):
                    self.table = np.resize(self.table, (2 * i, self.size))
                self.table[i] = self.vector(word)
            at.append(i)
        sums = np.fromiter(found.values(), float, len(found)) @ self.table[at]
        best = int(np.argmax(sums))  # the first of equal ones
        return self.langs[best], float(1.0 / np.exp(np.clip(sums - sums[best], -700, 0)).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score for every row of `docs`, from its whole text.

    `und` with score 0 stands for null texts, texts without a letter, and a model without languages.
    The score is the winner's share of the likelihood; equal languages are settled by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
