"""Language identification: a linear-chain conditional random field labels the words of a text, which may switch languages.

A word's features are its affixes and character n-grams, hashed into a table of weights, and its entry in a lexicon of the words
that training texts repeat. Transitions between labels and the weights of a first word are learned, by the gradient that
forward-backward gives. A text's language is the label with the largest share of its words' marginal probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import fold, hashed_sample, parts, small_batches

#: Words: runs of letters and the marks that combine with them; anything else parts them and has no label. A longer run, as in
#: scripts without spaces, is several words.
LONGEST_RUN = 24
LETTERS = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST_RUN - 1}}}")
PLAIN_LETTERS = re.compile(f"[a-z]{{1,{LONGEST_RUN}}}")
TABLE = 1 << 15
#: The row of weights, always 0, of what a word doesn't have; the lexicon comes after it.
NONE = TABLE
#: Bounds of the training sample: documents of a language, characters taken of each (from a place given by a hash of its id),
#: words in all of a language, which are dealt evenly to its documents.
PER_LANGUAGE, EXCERPT, WORDS_EACH = 200, 4_000, 15_000
#: Times that training texts must hold a word of the lexicon.
LEXICON_SEEN = 3
#: Texts are taken in pieces of so many words by the forward-backward scan, all pieces at once.
BLOCK = 32
#: Words that go through the chain at a time. A text of more is cut at multiples of PART, and each cut has so many words of what is before and after.
PART, BESIDE = 50_000, 256
UNKNOWN = "und"
KNOWN_WORDS = 100_000


def _hashes(letters: list[np.ndarray], kind: int) -> np.ndarray:
    """Table rows of runs of letters, given as an array for each place in the run."""
    out = np.full(len(letters[0]), np.uint64(kind))
    for x in letters:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out % np.uint64(TABLE)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weights for lower-case words: all words' trigrams one after another, where each word's begin, and one row a word of
    its prefixes and suffixes of 1 to 3 letters and its entry in the lexicon. `NONE` stands for what a word doesn't have.
    """
    # Words hold letters alone, so the marks at their ends are no letters of theirs.
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    inside = np.ones(len(marked), bool)
    inside[ends - 1] = inside[ends - 2] = False
    trigrams = _hashes([marked[:-2], marked[1:-1], marked[2:]], 0)[inside[:-2]]
    own = np.full((len(words), 7), NONE)
    for i, size in enumerate((2, 3, 4)):
        some = np.flatnonzero(sizes >= size)
        own[some, i] = _hashes([marked[begins[some] + k] for k in range(size)], 2 * size)
        own[some, 3 + i] = _hashes([marked[ends[some] - size + k] for k in range(size)], 2 * size + 1)
    own[:, 6] = [lexicon.get(w, NONE) for w in words]
    return trigrams, begins - 2 * np.arange(len(words)), own


def letter_runs(low: str) -> re.Pattern | regex.Pattern:
    """The pattern of a lower-case text's words: the quicker one where all is ASCII."""
    return PLAIN_LETTERS if low.isascii() else LETTERS


@dataclass
class LanguageModel:
    """Weights (TABLE + 1 + lexicon x labels, float32), log transitions (labels x labels), log start weights, and the lexicon's rows."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """words x labels scores."""
        trigrams, starts, own = features(words, self.lexicon)
        return np.add.reduceat(self.weights[trigrams], starts, axis=0) + self.weights[own].sum(axis=1)

    def messages(self, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages (words x labels, each row adds up to 1) of all texts' words at once; `first` marks the words that begin a text.

        The forward message holds the word's own score, the backward one doesn't. At a begin the start weights stand in for what
        came before, so texts don't touch. The chain is cut in pieces of `BLOCK`; each piece's transfer matrix is found for all
        pieces together, then pieces are chained.
        """
        n, k = emit.shape
        pad = -n % BLOCK
        emit = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        # What fills up the last piece is texts of their own.
        emit = np.concatenate([emit, np.ones((pad, k))]).reshape(-1, BLOCK, k)
        first = np.concatenate([first, np.ones(pad, bool)]).reshape(-1, BLOCK, 1)
        step, begin = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        blocks = len(emit)

        def ahead(at: np.ndarray, i: int) -> np.ndarray:
            at = np.where(first[:, i].reshape(-1, *[1] * (at.ndim - 1)), begin, at @ step) * emit[:, i].reshape(blocks, *[1] * (at.ndim - 2), k)
            return at / at.sum(axis=tuple(range(1, at.ndim)), keepdims=True)

        whole = np.broadcast_to(np.eye(k), (blocks, k, k))
        for i in range(BLOCK):
            whole = ahead(whole, i)
        into, out = np.empty((blocks, k)), np.empty((blocks, k))
        at = np.full(k, 1.0 / k)
        for b in range(blocks):
            into[b] = at
            at = at @ whole[b]
            at /= at.sum()
        at = np.full(k, 1.0 / k)
        for b in range(blocks - 1, -1, -1):
            out[b] = at
            at = whole[b] @ at
            at /= at.sum()
        forward, backward = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
        for i in range(BLOCK):
            into = ahead(into, i)
            forward[:, i] = into
        for i in range(BLOCK - 1, -1, -1):
            backward[:, i] = out
            out = np.where(first[:, i], 1.0, (out * emit[:, i]) @ step.T)
            out /= out.sum(axis=1, keepdims=True)
        return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n]

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's probabilities of the labels, given its whole text."""
        forward, backward = self.messages(emit, first)
        forward *= backward
        forward /= forward.sum(axis=1, keepdims=True)
        return forward

    def expected_moves(self, emit: np.ndarray, first: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Expected number of moves from label to label over all texts, from their messages."""
        inner = ~first[1:]
        after = np.exp(emit[1:] - emit[1:].max(axis=1, keepdims=True)) * backward[1:]
        pair = forward[:-1][inner][:, :, None] * np.exp(self.transitions - self.transitions.max()) * after[inner][:, None, :]
        return (pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """texts x labels: the mean of the words' marginals; rows of texts without a word are 0."""
        return Reader(self).judged(texts)[0]


class Reader:
    """A model at work: it keeps the scores of a bounded number of words it has seen. What it says of a text depends on that text alone."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.most = min(KNOWN_WORDS, (1 << 22) // max(1, len(model.labels)))
        self.scores = np.empty((self.most, len(model.labels)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(dict.fromkeys(words))
        if len(new) > self.most:
            return self.model.emissions(words)
        if new:
            first = len(known)
            self.scores[first : first + len(new)] = self.model.emissions(new)
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """`shares`, and for each text how sure its words are: the mean of each word's best marginal, whichever label it is for."""
        sums, total = np.zeros((len(texts), len(self.model.labels) + 1)), np.zeros(len(texts))
        words: list[str] = []
        rows: list[tuple[int, int, int, int]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            # A list is quicker; a text that would make a long one is gone through match by match.
            low = text.lower()
            found = iter(letter_runs(low).findall(low)) if len(text) <= 10 * PART else (m[0] for m in letter_runs(low).finditer(low))
            before, own = [], list(islice(found, PART + BESIDE))
            while own:
                core = own if len(own) <= PART + BESIDE // 2 else own[:PART]
                rows.append((i, len(before), len(core), len(before) + len(own)))
                words += before
                words += own
                if len(words) >= PART:
                    self._add(words, rows, sums, total)
                    words, rows = [], []
                before, own = core[-BESIDE:], own[len(core) :] and own[len(core) :] + list(islice(found, PART))
        if words:
            self._add(words, rows, sums, total)
        sums /= np.maximum(total, 1)[:, None]
        return sums[:, :-1], sums[:, -1]

    def _add(self, words: list[str], rows: list[tuple[int, int, int, int]], sums: np.ndarray, total: np.ndarray) -> None:
        """Add the marginals of each row's own words: (text, words before them, own words, words with those beside them)."""
        at, before, own, size = np.array(rows).T
        starts = np.r_[0, np.cumsum(size)[:-1]]
        first = np.zeros(len(words), dtype=bool)
        first[starts] = True
        found = self.model.marginals(self.emissions(words), first)
        found = np.column_stack([found, found.max(axis=1)])
        cuts = np.column_stack([starts + before, starts + before + own]).ravel()
        np.add.at(sums, at, np.add.reduceat(np.concatenate([found, np.zeros((1, found.shape[1]))]), cuts, axis=0)[::2])
        np.add.at(total, at, own)


def training_runs(texts: list[str], languages: list[str], rng: np.random.Generator) -> list[tuple[list[str], str]]:
    """Runs of 5 to 40 words of one text, and its language. Words are dealt evenly to a language's texts; copies of a text count once."""
    runs: list[tuple[list[str], str]] = []
    for label in sorted(set(languages)):
        own = [letter_runs(t.lower()).findall(t.lower()) for t in sorted({t for t, x in zip(texts, languages, strict=True) if x == label})]
        sizes = sorted(map(len, own))
        # The most words of a text such that all fit: texts of fewer words leave the rest to the others.
        left, most = WORDS_EACH, sizes[-1]
        for i, size in enumerate(sizes):
            if size > (share := left // (len(sizes) - i)):
                most = share
                break
            left -= size
        for words in own:
            a = int(rng.integers(0, max(1, len(words) - most + 1)))
            end = min(len(words), a + most)
            while a < end:
                size = min(int(rng.integers(5, 41)), end - a)
                runs.append((words[a : a + size], label))
                a += size
    return runs


def train_language_model(texts: list[str], languages: list[str], steps: int = 40, seed: int = 0) -> LanguageModel:
    """Fit by full-batch gradient (Adam) on sequences that switch between texts of different languages.

    Each sequence joins runs of texts in random order, about 400 words long, so transitions learn that labels persist.
    """
    labels = sorted(set(languages))
    rng = np.random.default_rng(seed)
    runs = training_runs(texts, languages, rng)
    order = rng.permutation(len(runs))
    words = [w for i in order for w in runs[i][0]]
    k = max(1, len(labels))
    if not words:
        return LanguageModel(labels, np.zeros((NONE + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    truth = np.concatenate([np.full(len(runs[i][0]), labels.index(runs[i][1])) for i in order])
    counts = Counter(words)
    lexicon = {w: NONE + 1 + i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEXICON_SEEN))}
    size = NONE + 1 + len(lexicon)
    model = LanguageModel(labels, np.zeros((size, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    first = np.zeros(len(words), dtype=bool)
    starts = np.r_[0, np.cumsum([len(runs[i][0]) for i in order])[:-1]]
    first[starts[:: max(1, len(starts) * 400 // len(words))]] = True
    vocabulary = {w: i for i, w in enumerate(counts)}
    ids = np.array([vocabulary[w] for w in words])
    trigrams, begins, own = features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(counts)), np.diff(np.r_[begins, len(trigrams)]))
    flat, owner = np.concatenate([trigrams, own.ravel()]), np.concatenate([owner, np.repeat(np.arange(len(counts)), own.shape[1])])
    seen, one_hot = np.zeros((k, k)), np.eye(k)[truth]
    inner = ~first[1:]
    np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1)
    values = [model.weights.astype(np.float64), model.transitions, model.start]
    moments, seconds = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for t in range(1, steps + 1):
        model.weights, model.transitions, model.start = values
        emit = (np.add.reduceat(model.weights[trigrams], begins, axis=0) + model.weights[own].sum(axis=1))[ids]
        forward, backward = model.messages(emit, first)
        moves = model.expected_moves(emit, first, forward, backward)
        off = forward * backward
        off = one_hot - off / off.sum(axis=1, keepdims=True)
        by_word = np.stack([np.bincount(ids, off[:, c], len(counts)) for c in range(k)], axis=1)
        by_feature = np.stack([np.bincount(flat, by_word[owner, c], size) for c in range(k)], axis=1)
        by_feature[NONE] = 0
        gradient = (by_feature / len(words) - 1e-6 * values[0], (seen - moves) / len(words) - 1e-4 * values[1], off[first].sum(axis=0) / len(words) - 1e-4 * values[2])
        rate = 0.2 if t < steps * 0.8 else 0.06
        for i, g in enumerate(gradient):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            seconds[i] = 0.99 * seconds[i] + 0.01 * g * g
            by = (moments[i] / (1 - 0.9**t)) / (np.sqrt(seconds[i] / (1 - 0.99**t)) + 1e-8)
            values[i] = values[i] + rate * (1.0 if i == 0 else 0.5) * by
    model.weights, model.transitions, model.start = values[0].astype(np.float32), values[1], values[2]
    return model


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> LanguageModel:
    """A model from a bounded sample of labelled rows outside the held-out fold, of all languages; see the bounds above."""
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(66)), F.greatest(F.length(text) - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    rows = df.select(F.col(id_col).alias("doc_id"), F.substring(text, start, F.lit(EXCERPT)).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where((fold(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = hashed_sample(rows, F.col("doc_id"), "lang", PER_LANGUAGE, salt=6).collect()
    return train_language_model([r["text"] for r in found], [r["lang"] for r in found])


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`df` with `lang_pred` and `score` (in place of columns of these names). Null texts and texts without a letter are "und", score 0.

    Whole texts are read, of any length, and only they go to Python; repeated rows give repeated rows. A model without labels
    calls everything "und".
    """
    rows = _found(df, model, text_col)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("lang_pred", "score")]
    return rows.select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))


def _found(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of `df` as `_row`, and `_found`: lang_pred, score, and sure, the mean of the words' best marginals."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, sure: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(sent.value)
        labels = reader.model.labels
        for texts in batches:
            names, scores, sures = [], [], []
            for part in parts(texts):
                own = texts[part].to_pylist()
                found, sure = reader.judged(own) if labels else (np.zeros((len(own), 1)), np.zeros(len(own)))
                some = found.max(axis=1, initial=0.0)
                names += [labels[b] if s > 0 else UNKNOWN for b, s in zip(found.argmax(axis=1), some, strict=True)]
                scores.append(np.minimum(some, 1.0))
                sures.append(np.minimum(sure, 1.0))
            none = np.empty(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([none, *scores])), pa.array(np.concatenate([none, *sures]))], names=["lang_pred", "score", "sure"])

    # Not to be moved or done twice by the optimiser: it is the dear part.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(text_col).alias("_text"))
    return rows.withColumn("_found", predict.asNondeterministic()(F.col("_text"))).drop("_text")


def language_report(df: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` for each document, by a model that learns from the other folds."""
    model = fit_language_model(df)
    found = identify_language(df.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `df` whose language, or mix of languages, is known: the words' best marginals are at least `least` in the mean.

    How many languages a text holds doesn't matter, nor what share the largest has. Columns stay.
    """
    found = _found(df, fit_language_model(df))
    return found.where((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.sure") >= least)).select("_row.*")
