"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: accents go, look-alike letters of other scripts and digits or signs that stand for letters become
those letters, everything else separates words. Lexicon terms are word beginnings with a weight; the longest term that
fits at a word counts. Exception phrases are terms of weight zero: being longer, they win over the term they contain.
A document's weights are set against its length, and a logistic curve turns that into a score.

Terms, weights, exceptions and the curve are learned from labelled rows: a sample of at most about ``SAMPLE`` rows of each label,
chosen by the hash of the id, is all that learning reads; document counts per term are made by Spark.

Defined results: null and empty texts have no matches and get the score of a clean document; without any labelled toxic
row every score is 0; repeated labels of one id count once (toxic if any says so); extra columns are carried.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import map_texts
from hiregrain.session import materialize

SAMPLE = 10_000  # labelled rows of each label, at most (on average)
HELD_OUT = 5  # one in so many labelled rows, by checksum of the id, is never learned from
SHORTEST, LONGEST = 4, 8  # letters of a learned word beginning
MIN_TOXIC, MIN_WEIGHT = 4, 2.0
MIN_CLEAN = 3  # clean documents that make a longer word an exception
FLUSH = 300_000
# Letters of other scripts, digits and signs that pass for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "η": "n", "ω": "w", "γ": "y", "β": "b",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ꜱ": "s", "ʟ": "l", "ɪ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_ASCII = bytes((c if 97 <= c <= 122 else ord(LOOKALIKES.get(chr(c), " "))) for c in (ord(chr(b).lower()) if b < 128 else 32 for b in range(256)))
_OTHER = {ord(k): v for k, v in LOOKALIKES.items()}
_SEPARATE = re.compile("[^a-z]+")


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    # Zero-width and combining characters vanish, so they can't split a word.
    plain = unicodedata.normalize("NFKD", text).lower()
    plain = "".join(c for c in plain.translate(_OTHER) if c < "\x80" or not (unicodedata.combining(c) or unicodedata.category(c) == "Cf")) if not plain.isascii() else plain
    return _SEPARATE.sub(" ", plain.translate(_OTHER)).split()


def joined(words: list[str]) -> str:
    """Words with two spaces between, so that a term for a whole word doesn't take the next word's beginning."""
    return " " + "  ".join(words) + " "


@dataclass
class Lexicon:
    """Terms as they appear in :func:`joined` text (a space, then a word beginning) with their weight; exceptions weigh 0."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)

    def automaton(self):
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, weight)
        machine.make_automaton()
        return machine


def term(phrase: str, whole: bool = True) -> str:
    """A word or phrase as a lexicon term; not ``whole``: the last word may go on."""
    return " " + "  ".join(fold(phrase)) + (" " if whole else "")


def measures(text: str | None, machine) -> tuple[float, float, float, int]:
    """What the curve reads: matched weight on a log scale, weight by length, largest weight; and the number of matches."""
    words = fold(text or "")
    if not words or not len(machine):
        return 0.0, 0.0, 0.0, 0
    found = [w for _, w in machine.iter_long(joined(words)) if w > 0]
    total = sum(found)
    return float(np.log1p(total)), total / (10.0 + len(words)) ** 0.5, max(found, default=0.0), len(found)


def curve_scores(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    z = curve[0] + x @ np.array(curve[1:])
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, both labels given equal say."""
    a = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.diag([0.0, *[ridge] * x.shape[1]]) * len(x)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (share * (y - p)) - penalty @ w
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % HELD_OUT == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, sample: int) -> DataFrame:
    """``(text, toxic)`` of the sample. Only the sampled ids, of bounded number, are broadcast; the texts stay in place."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(id_column).agg(F.max(label).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # one row per label
    place = F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.lit(0.0)
    for value, count in counts.items():
        limit = F.when(F.col("_toxic") == value, F.lit(min(1.0, sample / max(count, 1)))).otherwise(limit)
    chosen = known.where((place < limit) & F.col("_toxic").isin(0, 1))
    return materialize(docs.join(F.broadcast(chosen), id_column).select(F.coalesce(text, F.lit("")).alias("text"), "_toxic"))


def _term_counts(sample: DataFrame) -> DataFrame:
    """Toxic and clean documents per candidate term: word beginnings, and whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])]], names=["term", "toxic", "clean"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                words = {w for w in fold(text) if len(w) >= 3}
                terms = {f" {w} " for w in words if len(w) <= 24}
                for n in range(SHORTEST, LONGEST + 1):
                    terms.update({" " + w[:n] for w in words if len(w) >= n})
                seen[toxic].update(terms)
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        yield flush()

    return sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = (), sample: int = SAMPLE) -> Lexicon:
    """A lexicon and its curve. What reaches the driver is bounded by the sample: its telling terms and three numbers a row."""
    rows = labelled_sample(docs, labels, id_column, text, label, sample)
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if not sizes.get(1):
        return Lexicon()
    ratio = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1.0))
    counts = materialize(_term_counts(rows).withColumn("weight", ratio))
    telling = counts.where((F.col("toxic") >= MIN_TOXIC) & (F.col("weight") >= MIN_WEIGHT)).toPandas()
    weights = choose_terms(telling)
    heads = {t.strip()[:SHORTEST] for t in weights}
    if heads:
        near = counts.where((F.col("clean") >= MIN_CLEAN) & (F.col("weight") < MIN_WEIGHT / 2) & F.substring(F.trim("term"), 1, SHORTEST).isin(sorted(heads))).toPandas()
        for other in near["term"]:  # a longer clean word inside a term's reach
            if any(other.startswith(t) and other != t for t in (other[:n] for n in range(SHORTEST + 1, len(other))) if weights.get(t, 0) > 0):
                weights.setdefault(other, 0.0)
    for phrase in exceptions:
        weights[term(phrase)] = 0.0
    lexicon = Lexicon(weights)
    machine = lexicon.automaton()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [measures(t, machine)[:3] for t in part["text"]]
            yield pd.DataFrame(made, columns=["a", "b", "c"]).assign(y=part["_toxic"].to_numpy())

    seen = rows.mapInPandas(measure, "a double, b double, c double, y int").toPandas()  # at most about 2 * sample rows
    lexicon.curve = fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy())
    return lexicon


def choose_terms(telling: pd.DataFrame) -> dict[str, float]:
    """Of word beginnings with the same documents the longest, and none that a shorter one covers as well."""
    found = {r.term: (r.toxic, r.weight) for r in telling.itertuples() if not r.term.endswith(" ")}
    grown: dict[str, int] = {}
    for one, (toxic, _) in found.items():
        grown[one[:-1]] = max(grown.get(one[:-1], 0), toxic)
    taken: dict[str, float] = {}
    for one in sorted(found, key=len):
        toxic, weight = found[one]
        if grown.get(one, 0) >= 0.95 * toxic:
            continue
        parents = [taken[one[:n]] for n in range(SHORTEST + 1, len(one)) if one[:n] in taken]
        if not parents or weight > max(parents) + 0.5:
            taken[one] = float(weight)
    whole = {r.term: (r.toxic, r.weight) for r in telling.itertuples() if r.term.endswith(" ")}
    for one, (_, weight) in whole.items():  # words too short to have a beginning, or much more telling as a whole
        parents = [taken[one[:n]] for n in range(SHORTEST + 1, len(one)) if one[:n] in taken]
        if not parents or weight > max(parents) + 0.5:
            taken[one] = float(weight)
    return taken


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``n_matches`` and ``predicted``."""
    weights, curve = lexicon.weights, lexicon.curve

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        if not made:  # once per task
            made.append(Lexicon(weights).automaton())
        machine = made[0]
        rows = [measures(t, machine) for t in texts]
        scores = curve_scores(np.array([r[:3] for r in rows]).reshape(-1, 3), curve)
        return {"score": pa.array(scores), "n_matches": pa.array([r[3] for r in rows], pa.int64()), "predicted": pa.array((scores >= 0.5).astype(np.int32))}

    made: list = []
    return map_texts(docs, work, "score double, n_matches long, predicted int", text, keep_text=keep_text)
