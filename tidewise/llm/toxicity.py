"""Toxicity: a weighted lexicon, found by Aho-Corasick in folded text, normalised by length.

Folding lowers the case and maps look-alike letters, and digits and marks that stand for letters, to those letters; places stay.
Whether a hit is a whole word is judged by what stands in the text itself, so a digit or "!" after a word is no letter of it. Marks put
between letters are dropped for a second look, and an asterisk may stand for up to `MASKED` inner letters of a word. A lexicon of seed words is widened by words that mark the toxic class in a bounded labelled sample; weights
are log odds. Exception phrases cover harmless uses. A logistic curve, fitted on the same sample, maps the features to 0..1.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, fold, map_columns, parts, small_batches, stored

#: Bound of the labelled sample: documents of each class.
SAMPLE = 4_000
#: Seed words and phrases that hold one of them harmlessly.
SEEDS = (
    "idiot idiots idiotic moron morons moronic stupid worthless scum scumbag trash loser losers pathetic disgusting imbecile "
    "dumb dumbass jerk hate bastard bastards crap fool vermin parasite maggot swine cretin dimwit halfwit nitwit numbskull "
    "lowlife degenerate creep psycho lunatic coward dirtbag asshole bitch slut whore shit bullshit fuck fucking "
    "idiota imbécil estúpido estúpida basura asqueroso idiote imbécile crétin abruti ordure connard dummkopf abschaum arschloch trottel"
).split()
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "trash talk", "hate to say", "hate crime", "hate speech", "pond scum",
    "sore loser rule", "shut up shop", "fool proof", "april fool", "parasite host", "scared to death", "swine flu", "swine fever",
)
#: Characters that stand for a letter, by letter.
LOOKALIKES = {
    "a": "αа@4", "b": "в8", "c": "сϲ", "d": "ԁ", "e": "еε3€", "g": "ɡ9", "h": "һ", "i": "іι1!ı|", "j": "ј", "k": "к", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оο0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "т7+", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у", "z": "2",
}
FOLD = str.maketrans({c: letter for letter, chars in LOOKALIKES.items() for c in chars})
#: Marks that are put inside words; the first stands for letters, too.
MARKS = "*_\u200b\u200c\u200d\u00ad\u2060"
MASKED = 3
MARKED = re.compile(f"[{MARKS}]")
#: A word: letters, with look-alikes that are none between them; folded when it is read.
WORD = re.compile(r"[^\W\d_]+(?:[" + re.escape("".join(sorted({c for chars in LOOKALIKES.values() for c in chars if not c.isalpha()}))) + r"]+[^\W\d_]+)*")
LEAST_SEEN = 5
#: Letters of a stem that may be learned; a stem is written with an asterisk and finds the words that begin with it.
STEMS = range(4, 10)


def lowered(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] for c in text)


def masked_forms(word: str) -> list[str]:
    """A word with an asterisk, or as many, in place of up to `MASKED` letters that are neither its first nor its last."""
    inner = [(i, k) for k in range(1, MASKED + 1) for i in range(1, len(word) - k)]
    return [word[:i] + stars + word[i + k :] for i, k in inner for stars in {"*", "*" * k}] if len(word) >= 4 else []


@dataclass
class ToxicityModel:
    """Word weights, exception phrases, and the curve's coefficients for (1, density, sum, any)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self):  # noqa: ANN201
        """The automaton over words and their masked forms, and exception phrases; built once for each process."""
        if self._machine is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for w, x in self.weights.items():
                if not w.endswith("*"):
                    for form in masked_forms(w):
                        found.add_word(form, (len(form), False, x))
            for w, x in self.weights.items():
                found.add_word(w.rstrip("*"), (len(w.rstrip("*")), w.endswith("*"), x))
            for p in self.exceptions:
                found.add_word(p, (len(p), False, None))
            if len(found):
                found.make_automaton()
            self._machine = found
        return self._machine

    def _matches(self, low: str) -> Iterator[tuple[int, int, float | None]]:
        """(start, end, weight) of words, stems and exception phrases in a text in lower case, at the edges of words."""
        n = len(low)
        for last, (size, stem, weight) in self.machine().iter(low.translate(FOLD)):
            a, b = last - size + 1, last + 1
            if (a == 0 or not low[a - 1].isalpha()) and (stem or b == n or not low[b].isalpha()):
                yield a, b, weight

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) by place, of whole words or beginnings of words, none inside an exception phrase."""
        if not len(self.machine()):
            return []
        low = lowered(text)
        matches = set(self._matches(low))
        if MARKED.search(low):
            # Once more without the marks that stand between two letters; places are carried back.
            inside = lambda i: low[i] in MARKS and 0 < i < len(low) - 1 and (low[i - 1].isalnum() or low[i - 1] in MARKS) and (low[i + 1].isalnum() or low[i + 1] in MARKS)
            keep = [i for i in range(len(low)) if not inside(i)]
            matches |= {(keep[a], keep[b - 1] + 1, x) for a, b, x in self._matches("".join([low[i] for i in keep]))}
        found, safe = sorted(m for m in matches if m[2] is not None), sorted(m[:2] for m in matches if m[2] is None)
        if safe:
            # Phrases by start, and how far those up to each reach: one search for each hit.
            starts, reach = [x for x, _ in safe], [0, *accumulate((y for _, y in safe), max)]
            found = [h for h in found if reach[bisect_right(starts, h[0])] < h[1]]
        return found

    def measure(self, text: str | None) -> tuple[float, float, int, int]:
        """(weight by length, weight, hits, words); zeros for null or empty text."""
        if not text:
            return 0.0, 0.0, 0, 0
        found = self.hits(text)
        words = text.count(" ") + text.count("\n") + 1
        total = sum(w for _, _, w in found)
        return total / math.sqrt(words), total, len(found), words

    def score(self, measures: list[tuple[float, float, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(measures) @ np.asarray(self.curve), -30, 30)))


def _design(measures: list[tuple[float, float, int, int]]) -> np.ndarray:
    m = np.asarray(measures, dtype=float).reshape(-1, 4)
    return np.column_stack([np.ones(len(m)), np.minimum(m[:, 0], 20), np.log1p(np.maximum(m[:, 1], 0)), m[:, 2] > 0])


def held_words(text: str | None) -> set[str]:
    """The words of a text, and their beginnings as stems with an asterisk."""
    words = {w.translate(FOLD) for w in WORD.findall(lowered(text or ""))}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def lexicon(counts: dict[str, tuple[int, int]], documents: tuple[int, int], seeds: list[str] | None = None) -> dict[str, float]:
    """Weights by log odds of documents that hold a word, for seeds and for words or stems that toxic texts hold far more often.

    `counts` has, for a word or stem, the (clean, toxic) documents that hold it.
    """
    n = [max(1, x) for x in documents]
    seen = lambda w: counts.get(w, (0, 0))
    odds = lambda w: math.log(((seen(w)[1] + 0.5) / (n[1] + 1)) / ((seen(w)[0] + 0.5) / (n[0] + 1)))
    weights = {w: max(0.5, odds(w)) if sum(seen(w)) >= LEAST_SEEN else 1.0 for w in (SEEDS if seeds is None else seeds)}
    # Words and beginnings of words that mark the class beyond chance, at four times the rate; one of a family is enough.
    sure = lambda w: odds(w) / math.sqrt(1 / seen(w)[1] + 1 / (seen(w)[0] + 0.5))
    marks = [(sure(w), w) for w, (_, toxic) in counts.items() if toxic >= LEAST_SEEN and len(w) > 2 and odds(w) > math.log(4)]
    for z, w in sorted(marks, key=lambda m: (-m[0], -len(m[1]), m[1])):
        if z > 4 and not any(w.startswith(x.rstrip("*")) or x.startswith(w.rstrip("*")) for x in weights):
            weights[w] = odds(w)
    return weights


def with_curve(model: ToxicityModel, measures: list[tuple[float, float, int, int]], toxic: Iterable[int]) -> ToxicityModel:
    """The model with a logistic curve fitted to labelled measures; as it is if they are of one class only."""
    y = np.asarray([*toxic], dtype=float)
    if len(set(y)) < 2:
        return model
    x = _design(measures)
    b = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(b)), x.T @ (y - p) - 0.05 * b)
    return ToxicityModel(model.weights, model.exceptions, tuple(b))


#: The curve of a model that has seen no labels, and the words whose counts a task gathers before it passes them on.
PLAIN_CURVE, GATHERED = (-2.0, 1.0, 0.5, 0.5), 200_000


def word_counts(sample: DataFrame) -> DataFrame:
    """`word, clean, toxic`: how many documents of each class hold a word or stem, from (text, toxic). Added up in tasks, then by word."""
    small_batches(sample.sparkSession)
    schema = "word string, clean long, toxic long"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = [*(seen[0] | seen[1])]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], schema=arrow)

        for batch in batches:
            for part in parts(batch.column(1)):
                for toxic, text in zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), strict=True):
                    seen[toxic].update(held_words(text))
                    if len(seen[0]) + len(seen[1]) > GATHERED:
                        yield out()
                        seen = (Counter(), Counter())
        yield out()

    return sample.select("toxic", "text").mapInArrow(run, schema).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """A model from at most `SAMPLE` labelled documents of each class outside the held-out fold, whole texts.

    The documents are those with the least hash of their id; only their ids, at most 2 x SAMPLE, are broadcast to find their
    texts, of which Spark counts the words. The driver gets counts of words that mark the class, and four numbers a document.
    Of texts that share an id the least is taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [r for k in (0, 1) for r in rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not chosen:
        return ToxicityModel(lexicon({}, (0, 0)), exceptions, PLAIN_CURVE)
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(few, "doc_id")
    sample = stored(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    sizes = (sizes.get(0, 0), sizes.get(1, 0))
    # What can't become a weight stays with Spark: seeds, or words at four times the rate.
    rate = (F.col("toxic") + 0.5) / (max(1, sizes[1]) + 1) > 3.99 * (F.col("clean") + 0.5) / (max(1, sizes[0]) + 1)
    marks = word_counts(sample).where(F.col("word").isin(SEEDS) | ((F.col("toxic") >= LEAST_SEEN) & rate)).collect()
    model = ToxicityModel(lexicon({r["word"]: (r["clean"], r["toxic"]) for r in marks}, sizes), exceptions, PLAIN_CURVE)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(toxic: list, texts: list) -> dict:
        found = [sent.value.measure(t) for t in texts]
        return {"toxic": toxic, **{f"m{i}": [float(m[i]) for m in found] for i in range(4)}}

    found = map_columns(sample, ["toxic", "text"], "toxic int, m0 double, m1 double, m2 double, m3 double", measured).collect()
    return with_curve(model, [tuple(r)[1:] for r in found], [r["toxic"] for r in found])


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, score, predicted, n_hits` for each row, over whole texts; null and empty texts have no hit. Repeated rows repeat."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, predicted int, n_hits long"

    def rows(ids: list, texts: list) -> dict:
        own = sent.value
        found = [own.measure(t) for t in texts]
        score = own.score(found)
        return {id_col: ids, "score": score, "predicted": (score >= 0.5).astype("int32"), "n_hits": [m[2] for m in found]}

    return map_columns(df, [id_col, text_col], schema, rows)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` and the number of hits, for each document."""
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_hits")
