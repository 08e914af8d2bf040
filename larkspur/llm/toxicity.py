"""Toxicity by a weighted lexicon matched with Aho-Corasick.

A text is lower-cased, look-alike letters and digit or sign substitutions inside words are folded, and its words are laid out
between single spaces. One automaton holds the lexicon (whole words, and word beginnings) and the exception phrases. The
weights of the matches, without those inside an exception phrase, are summed, normalised by length and mapped to 0..1.

The lexicon, the exception phrases and the mapping are learned from labelled training rows only: at most ``TOXIC_ROWS`` rows
labelled toxic and ``CLEAN_ROWS`` labelled clean (the first by a hash of their id, one of each
family of near copies), which is a documented bound for fitting a
classifier. Within that sample nothing is cut off: every word or beginning in ``LEAST_SHARE`` of the toxic rows is a candidate.
A candidate's precision is that among rows weighed so that both labels have the same mass, by its lower bound, so neutral words
stand at one half at any mixture of labels. Candidates above ``LEAST_PRECISION`` become entries. Those that stand above
``DOUBTFUL_PRECISION`` only are looked at for exception phrases: word pairs around them that hold ``EXCEPTION_SHARE`` of their
clean rows and are hardly ever toxic; read without these, such a candidate may reach the bound.
Scoring covers every text whole, in one pass without a shuffle.

Defined cases: a null or wordless text has no matches and gets the score of such a text; a label row with a null id or label
is left out, and repeated label rows for one id count as toxic if any is; without usable labels nothing is learned and every
score is 0 (1 if all usable labels are toxic); an empty table gives an empty result; every input row gives one row; a text of
any length is read whole; other columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Word beginnings of these lengths are candidates for the lexicon.
BEGINNINGS = range(4, 9)
#: A candidate occurs in this share of the toxic rows (3 rows at least).
LEAST_SHARE = 0.003
#: Lower bounds of the precision, with equal masses of toxic and clean rows, of entries and of doubtful candidates.
LEAST_PRECISION, DOUBTFUL_PRECISION = 0.8, 0.6
#: An exception phrase holds this share of a doubtful candidate's clean rows (3 at least), and so many clean rows for one toxic row.
EXCEPTION_SHARE, EXCEPTION_ODDS = 0.05, 10
SLICE_BYTES = 4 << 20

#: Look-alikes of Latin letters (Cyrillic, Greek, full width).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s", **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
}
_GLYPHS = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_MIXED = re.compile(r"(?=[^\W_]*[^\W\d_])(?=[^\W_]*\d|[^\W_]*[@$!][^\W_])[^\W_]+(?:[@$!]+[^\W_]+)*|(?<![^\s])[@$][^\W\d_]{2,}")
_DIGITS = str.maketrans("03457@$!", "oeastasi")
_GAP = re.compile(r"[\W_]+")


def folded(text: str) -> list[str]:
    """The readings of a text: words between single spaces; a second one, with 1 as l, where a word mixes a 1 with letters."""
    low = text.lower()
    if not low.isascii():
        low = _GLYPHS.sub(lambda m: HOMOGLYPHS[m[0]], low)
    readings = [low]
    if not low.isalpha() and re.search(r"[0-9@$!]", low):
        one = _MIXED.sub(lambda m: m[0].translate(_DIGITS).replace("1", "i"), low)
        readings = [one]
        if "1" in low:
            two = _MIXED.sub(lambda m: m[0].translate(_DIGITS).replace("1", "l"), low)
            if two != one:
                readings.append(two)
    return [" " + _GAP.sub(" ", r).strip() + " " for r in readings]


@dataclass
class Model:
    """entries: word (or beginning, ending in *) -> weight; exceptions: phrases; mapping: weights of the logistic features."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    mapping: np.ndarray | None = None
    prior: float = 0.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            pattern = " " + e.rstrip("*") + ("" if e.endswith("*") else " ")
            a.add_word(pattern, (len(pattern), w, False))
        for e in self.exceptions:
            a.add_word(f" {e} ", (len(e) + 2, 0.0, True))
        a.make_automaton()
        return a

    def features(self, automaton, text: str | None) -> tuple[float, float, float]:
        """Summed weight, matches and words of the reading that matches most."""
        best = (0.0, 0.0, 0.0)
        for reading in folded(text or ""):
            n = reading.count(" ") - 1
            total, hits, spans, found = 0.0, 0, [], []
            if len(automaton):
                for end, (length, weight, exception) in automaton.iter(reading):
                    if exception:
                        spans.append((end - length + 1, end))
                    else:
                        found.append((end - length + 1, end, weight))
            for s, e, w in found:
                if not any(a <= s and e <= b for a, b in spans):
                    total, hits = total + w, hits + 1
            best = max(best, (total, float(hits), float(max(n, 0))))
        return best

    def score(self, f: np.ndarray) -> np.ndarray:
        """0..1 for rows of features."""
        if self.mapping is None:
            return np.full(len(f), self.prior)
        return 1 / (1 + np.exp(-np.clip(design(f) @ self.mapping, -500, 500)))


def design(f: np.ndarray) -> np.ndarray:
    """Constant, total weight (damped), and weight by length."""
    return np.stack([np.ones(len(f)), np.log1p(f[:, 0]), np.log1p(100 * f[:, 0] / (f[:, 2] + 20)), np.minimum(f[:, 1], 5)], axis=1)


def fit_mapping(f: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the two labels weigh alike as far as the ridge term allows."""
    x, w = design(f), np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(4) / 10
        step = np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * w / 10)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _apart(words: list[str], pairs: set[str]) -> list[str]:
    """The words that are in none of the pairs."""
    inside = {k for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in pairs for k in (i, i + 1)}
    return [w for i, w in enumerate(words) if i not in inside]


def _candidates(text: str, without: set[str] | None = None) -> set[str]:
    out: set[str] = set()
    for reading in folded(text):
        words = set(_apart(reading.split(), without) if without else reading.split())
        out |= {w for w in words if len(w) >= 3}
        for k in BEGINNINGS:
            out |= {w[:k] + "*" for w in words if len(w) >= k}
    return out


def _lower_bound(a: float, b: float) -> float:
    """Wilson bound of a share a / (a + b) at about 95 %."""
    n, z = a + b, 1.96
    p = a / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def precision(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Lower bound of the share of toxic rows among those with a candidate, were there as many clean rows as toxic ones; neutral: one half."""
    return _lower_bound(toxic * min(1.0, n_clean / max(n_toxic, 1)), clean * min(1.0, n_toxic / max(n_clean, 1)))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, low: float = LEAST_PRECISION, high: float = 1.0) -> dict[str, float]:
    """Candidates whose precision lies from ``low`` to below ``high``, with their weights, most frequent first.

    One entry stands for the longer ones that begin with it, and is left out where longer ones say it all.
    """
    kept: dict[str, float] = {}
    said: Counter = Counter()  # rows of the taken entries, by their beginnings
    for e in sorted(toxic, key=lambda e: (-toxic[e], clean.get(e, 0), -len(e.rstrip("*")), e)):
        a, b = toxic[e], clean.get(e, 0)
        stem = e.rstrip("*")
        sure = b == 0 and a >= 4
        if a < max(3, LEAST_SHARE * n_toxic) or not (low <= (1.0 if sure and high == 1.0 else precision(a, b, n_toxic, n_clean)) < high + (high == 1.0)):
            continue
        if any(stem[:k] + "*" in kept for k in BEGINNINGS if k <= len(stem) and stem[:k] + "*" != e):
            continue
        if said[stem] >= 0.8 * a:
            continue
        for k in range(1, len(stem) + 1):
            said[stem[:k]] += a
        kept[e] = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
    return {e: w for e, w in kept.items() if w > 0}


def _count(rows: DataFrame, only: set[str] | None, phrases: list[str] = ()) -> DataFrame:
    """(entry, n) document frequencies of candidates over the rows' texts, read without the phrases."""
    without = set(phrases)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    found = _candidates(text, without)
                    counts.update(found if only is None else found & only)
        names = list(counts)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"entry": pa.array(part, pa.string()), "n": pa.array([counts[x] for x in part], pa.int64())})

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _phrases(rows: DataFrame, entries: dict[str, float]) -> DataFrame:
    """(entry, phrase, toxic, clean): document frequencies of the word pairs around matches of the entries, summed in each task."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found = set()
                for reading in folded(text or ""):
                    words = reading.split()
                    for i, w in enumerate(words):
                        for e in (w, *(w[:k] + "*" for k in BEGINNINGS if k <= len(w))):
                            if e in entries:
                                found |= {(e, " ".join(words[j : j + 2])) for j in (i - 1, i) if 0 <= j < len(words) - 1}
                for x in found:
                    counts.setdefault(x, [0, 0])[1 - y] += 1
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"entry": pa.array([e for e, _ in part], pa.string()), "phrase": pa.array([p for _, p in part], pa.string()), "toxic": pa.array([counts[k][0] for k in part], pa.int64()), "clean": pa.array([counts[k][1] for k in part], pa.int64())})

    return rows.mapInArrow(run, "entry string, phrase string, toxic long, clean long").groupBy("entry", "phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@common.lean
def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's five-word shingles, which near copies mostly share."""
    for batch in batches:
        least = []
        for text in common.texts_as_bytes(batch.column("text")).to_pylist():
            words = (text or b"").lower().split()
            least.append(min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4)))))
        yield batch.append_column("family", pa.array(least, pa.int64()))


def _features(model: Model):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            f = [model.features(automaton, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), **{n: pa.array([x[i] for x in f], pa.float64()) for i, n in enumerate("abc")}})

    return run


def _exceptions(rows: DataFrame, doubtful: dict[str, float], clean: dict[str, int]) -> list[tuple[str, str]]:
    """(candidate, phrase): phrases around doubtful candidates in which these are not toxic."""
    if not doubtful:
        return []
    around = _phrases(rows, doubtful).where(F.col("clean") >= F.greatest(F.lit(3), EXCEPTION_ODDS * F.col("toxic")))
    return [(r["entry"], r["phrase"]) for r in around.collect() if r["clean"] >= EXCEPTION_SHARE * clean.get(r["entry"], 0)]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``."""
    common.prepare(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic is not null").where(common.train_split(F.col("doc_id"), modulus) != held_out)
    known = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    # at most TOXIC_ROWS + CLEAN_ROWS ids
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(_families, "text string, y int, family long")
    # copies of one text would make each of its words look toxic: one row a family
    rows = common.stored(rows.dropDuplicates(["family", "y"]).select("text", "y"))
    sizes = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(prior=1.0 if n1 else 0.0)
    first = _count(rows.where("y = 1"), None).where(F.col("n") >= max(3, LEAST_SHARE * n1))
    toxic = {r["entry"]: int(r["n"]) for r in first.collect()}
    clean = {r["entry"]: int(r["n"]) for r in _count(rows.where("y = 0"), set(toxic)).collect()}
    exceptions = _exceptions(rows, choose(toxic, clean, n1, n0, DOUBTFUL_PRECISION, LEAST_PRECISION), clean)
    if exceptions:  # count again without them
        names, phrases = set(toxic), sorted({p for _, p in exceptions})
        toxic, clean = ({r["entry"]: int(r["n"]) for r in _count(rows.where(f"y = {y}"), names, phrases).collect()} for y in (1, 0))
    entries = choose(toxic, clean, n1, n0)
    model = Model(entries, sorted({p for e, p in exceptions if e in entries}))
    got = rows.mapInArrow(_features(model), "y int, a double, b double, c double").toPandas()
    model.mapping = fit_mapping(got[["a", "b", "c"]].to_numpy(), got["y"].to_numpy(dtype=float))
    return model


def _scorer(handle, text: str, keep: float | None):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        automaton = model.automaton()
        for whole in batches:
            for batch in common.slices(whole, text, SLICE_BYTES):
                f = np.array([model.features(automaton, t) for t in batch.column(text).to_pylist()], dtype=np.float64).reshape(-1, 3)
                score = model.score(f)
                if keep is not None:
                    yield batch.filter(pa.array(score < keep))
                else:
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "matches": pa.array(f[:, 1].astype(np.int64))})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, matches of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(handle, "text", None), f"doc_id {kind}, score double, matches long")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(handle, text, threshold), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels of four fifths of the ids."""
    docs = common.documents(spark, sf_dir)
    out = score(docs, train(docs, common.documents(spark, sf_dir, "labels")))
    held = common.train_split(F.col("doc_id"), 5) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
