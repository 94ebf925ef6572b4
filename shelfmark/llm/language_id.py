"""Language of texts by known words, with character n-grams for words that are not known.

A word that the labelled texts have scores by its log frequency in every language. Any other word is
read from left to right: at each place the longest known n-gram, from MAX_N characters down to one,
scores by its log frequency given its length.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_N = 5
#: Labelled documents of a language, and characters of all of them, that the model is fitted on.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 2000, 12_000_000
#: Times a word or n-gram is seen at least to be known.
SEEN = 2
#: Added to every count before logarithms.
SMOOTH = 0.1
#: Share of its score by which an n-gram counts less than a whole word.
BACKOFF = 0.4
CACHE = 300_000
UNKNOWN = "und"

_WORD = re.compile("[^\\W\\d_]+")


def grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, MAX_N + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def counts(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, kind 'w' or 'g', item, n) of all words and their n-grams in labelled texts."""
    taken = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    schema = "lang string, kind string, item string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for language, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(language, Counter()).update(_WORD.findall(body.lower()))
            for language, own in words.items():
                parts: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w):
                        parts[g] += n
                for kind, found in (("w", own), ("g", parts)):
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array([kind] * len(found)), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "kind", "item", "n"])

    return taken.mapInArrow(run, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Labelled documents for `train`: whole texts, of every language those with the smallest hashes.

    About SAMPLE_DOCUMENTS of a language, fewer where the texts of all would be longer than
    SAMPLE_CHARS: languages below an equal part of them keep all, the others divide what is left.
    Documents are taken or left by their hash, so no group is sorted.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).collect()
    shares = {r[0]: min(1.0, SAMPLE_DOCUMENTS / r.n) for r in sizes}
    left = float(SAMPLE_CHARS)
    for i, r in enumerate(sorted(sizes, key=lambda r: r.chars * shares[r[0]])):
        wanted = r.chars * shares[r[0]]
        fits = min(1.0, left / (len(sizes) - i) / max(1.0, wanted))
        shares[r[0]] *= fits
        left -= wanted * fits
    # One entry for each language that the model will have.
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v)]) if shares else F.create_map(F.lit(""), F.lit(0.0))
    place = F.pmod(F.xxhash64(id_col, text), F.lit(1 << 30)) / float(1 << 30)
    return known.where(place < share[F.col(lang)]).select(lang, text)


class Model:
    """Log frequencies of words and n-grams in every language; a row of `table` for every word met."""

    def __init__(self, found: dict[str, list]):
        self.languages = sorted(set(found["lang"]))
        at = {x: i for i, x in enumerate(self.languages)}
        tables: dict[str, dict[str, np.ndarray]] = {"w": {}, "g": {}}
        for language, kind, item, n in zip(found["lang"], found["kind"], found["item"], found["n"]):
            tables[kind].setdefault(item, np.full(len(at), SMOOTH))[at[language]] += n
        words = self._logs(tables["w"], lambda item: 0)
        self.grams = self._logs(tables["g"], len)
        self.known = {w: i for i, w in enumerate(words)}
        self.row = dict(self.known)
        self.table = np.array([*words.values(), np.zeros(len(at))])

    @staticmethod
    def _logs(table: dict[str, np.ndarray], group) -> dict[str, np.ndarray]:
        """Log shares among the items of one group, relative to the mean over languages."""
        totals: dict = {}
        for item, n in table.items():
            totals[group(item)] = totals.get(group(item), 0) + n
        out = {}
        for item, n in table.items():
            logs = np.log(n / totals[group(item)])
            out[item] = logs - logs.mean()
        return out

    def learn(self, word: str) -> int:
        """A row for a word that is not known, from its n-grams."""
        padded, score, i = f" {word} ", np.zeros(len(self.languages)), 0
        while i < len(padded):
            for n in range(min(MAX_N, len(padded) - i), 0, -1):
                if (found := self.grams.get(padded[i : i + n])) is not None:
                    score += BACKOFF * found
                    i += n
                    break
            else:
                i += 1
        at = self.row[word] = len(self.row)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = score
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.row) > len(self.known) + CACHE:
            self.row = dict(self.known)
        rows = [at if (at := self.row.get(w)) is not None else self.learn(w) for w in words]
        score = self.table[rows].sum(0)
        shares = np.exp(score - score.max())
        best = int(score.argmax())
        return self.languages[best], float(shares[best] / shares.sum())


#: The model of this process, by its name.
_MODELS: dict[str, Model] = {}


def model_of(name: str, found: dict[str, list]) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(found)
    return _MODELS[name]


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, list]:
    """Counts seen SEEN times or more, for `Model`; their number is bounded by `labelled`, see `sample`."""
    found = counts(labelled, lang, text)
    return found.where(F.col("n") >= SEEN).toArrow().to_pydict()


def predict(docs: DataFrame, model: dict[str, list], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if None) of every row, with lang_pred and score of its whole text.

    The score is the language's share of the likelihoods, from 0 to 1. A text that is null or has no
    letters, or any text under a model without languages, is "und" with score 0; ties go to the first
    language by name. Columns of these names in the input are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    taken = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_of(name, sent.value)
        for b in batches:
            found = [known.predict(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return taken.mapInArrow(run, schema)
