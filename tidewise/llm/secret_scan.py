"""Secrets in text: fixed patterns, and credential values that would be hard to guess.

Every value in a credential context gets its guess cost, also where a fixed pattern holds it: the least total, over all ways to cut it
into segments, of what an attacker must try for each segment: common words by rank (a fixed list, then the whole words of a public
tokenizer's vocabulary, so that a text's result depends on that text alone), dates, repeats, walks on a keyboard, and brute force over
the characters' classes for the rest. Values that take at least 10^HARD guesses are spans of kind `guess`.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, parts, small_batches

# The patterns that the task gives, with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

#: Where a credential's value may stand: more names and looser marks than `ASSIGN`; the value is what the DP weighs.
CONTEXT = re.compile(
    r"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)"""
    r"""["']?[ \t]*(?:[:=]>?|\bis\b)[ \t]*["'`]?([^\s"'`<>]{6,})""",
    re.I | re.A,
)
#: Names and passwords in addresses, schemes of headers, and flags of commands, which blanks part from their values.
LOGIN = re.compile(r"""://[^\s/:@"'<>]*:([^\s/@"'<>]{6,})@""", re.A)
HEADER = re.compile(r"""(?<![a-z])(?:bearer|authorization["']?[ \t]*:[ \t]*["']?basic)[ \t]+([^\s"'`<>]{6,})""", re.I | re.A)
FLAG = re.compile(r"""(?<!\S)--?(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[ \t]+["']?([^\s"'`<>-][^\s"'`<>]{5,})""", re.I | re.A)
#: One of these, in lower case, is in whatever a pattern finds; a text with none is not searched by it.
NAMES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
CONTEXTS = ((CONTEXT, NAMES), (LOGIN, ("://",)), (HEADER, ("bearer", "basic")), (FLAG, ("-pass", "-pwd", "-secret", "-token", "-api", "-access", "-auth")))
LONGEST_WORD = 24
#: Words that passwords are made of, the most common first.
WORDS = (
    "password passwd pass admin root user login welcome letmein secret token changeme default example test guest master "
    "monkey dragon qwerty abc love shadow sunshine princess football baseball superman batman trustno hello freedom "
    "whatever michael jordan summer winter spring autumn monday friday january december please access server database "
    "mysql oracle public private key api dev prod staging local null none true false dummy sample placeholder your my the "
    "and for new old temp foo bar baz"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
#: A value that takes fewer guesses is a placeholder or prose.
HARD = 9.0
#: What each further segment adds: the attacker must also guess how the pieces are put together.
JOIN = 0.5


@cache
def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Ranks of `WORDS`, then of the whole words of a public tokenizer's rank file, which holds the more common ones first.

    A word is a token of a blank and three or more letters, in lower case. The default is the installed vocabulary for many languages.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = dict.fromkeys(WORDS)
    with open(vocabulary, "rb") as lines:
        for line in lines:
            word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").lower()
            if word[:1] == " " and 3 <= len(word) - 1 <= LONGEST_WORD and word[1:].isalpha():
                ranks.setdefault(word[1:])
    return {w: i + 1 for i, w in enumerate(ranks)}


@cache
def _next_to() -> frozenset[tuple[str, str]]:
    """Pairs of keys side by side, or one above the other on a staggered keyboard."""
    at = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return frozenset((a, b) for a, (x, y) in at.items() for b, (v, w) in at.items() if a != b and abs(y - w) <= 1 and abs(x - v) <= 1)


def _classes(value: str) -> float:
    """log10 of the characters that brute force must try at each place."""
    n = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    n += 10 * any("0" <= c <= "9" for c in value) + 33 * any(not c.isalnum() for c in value) + 100 * any(c > "\x7f" and c.isalnum() for c in value)
    return math.log10(max(n, 1))


def _segments(value: str, words: dict[str, int] | None = None) -> list[list[tuple[int, float]]]:
    """For each start, the (end, log10 guesses) of the segments with a pattern."""
    n, low = len(value), value.lower()
    plain, ranks, near = low.translate(LEET), words or word_ranks(), _next_to()
    found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                leet, upper = low[i:j] not in ranks, value[i:j] != low[i:j]
                found[i].append((j, math.log10(rank + 1) + 0.3 * leet + 0.3 * upper))
    for m in DATE.finditer(value):
        found[m.start()].append((m.end(), 2.1 if m.end() - m.start() == 4 else 4.6))
    for test, cost in ((lambda a, b: a == b, lambda k: math.log10(90 * k)), (lambda a, b: (a, b) in near, lambda k: math.log10(40 * 3.0 * k)), (lambda a, b: abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum(), lambda k: math.log10(62 * 2.0 * k))):
        i = 0
        while i < n:
            j = i + 1
            while j < n and test(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                found[i].append((j, cost(j - i)))
            i = j if j - i > 1 else i + 1
    return found


def guesses_log10(value: str, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses for `value` by the cheapest segmentation; 0 for an empty one. Linear in its length.

    Each state holds the best cost of a prefix; the second one ends in a brute-force span, which further characters extend.
    """
    n = len(value)
    each, found = _classes(value), _segments(value, words)
    closed, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    closed[0] = 0.0
    for i in range(n):
        best = min(closed[i], brute[i])
        brute[i + 1] = min(brute[i + 1], brute[i] + each, closed[i] + each + (JOIN if i else 0))
        for j, cost in found[i]:
            closed[j] = min(closed[j], best + cost + (JOIN if i else 0))
    return min(closed[n], brute[n])


def credential_values(text: str | None, words: dict[str, int] | None = None) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the values in credential contexts and in `ASSIGN`, by place; of those that begin alike the longest."""
    if not text:
        return []
    low, found = text.lower(), {}
    for pattern, names in CONTEXTS:
        if any(name in low for name in names):
            for m in pattern.finditer(text):
                value = m[1].rstrip(".,;:)]}!?")
                if len(value) >= 6:
                    found[m.start(1)] = max(found.get(m.start(1), 0), m.start(1) + len(value))
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.setdefault(m.start(2), m.end(2))
    return [(a, b, guesses_log10(text[a:b], words)) for a, b in sorted(found.items())]


def find_secrets(text: str | None, hard: float = HARD, words: dict[str, int] | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) by start, then kind as in `KINDS`; code points, end exclusive.

    Null or empty text has none. Spans of kind "guess" are credential values that take at least 10^hard guesses, with `words` by rank
    (those of `word_ranks` if there are none); they may lie within a fixed pattern's span, which stays.
    """
    if not text:
        return []
    return _with_values(text, credential_values(text, words), hard)


def _with_values(text: str, values: list[tuple[int, int, float]], hard: float) -> list[tuple[str, int, int, float | None]]:
    found: list[tuple[str, int, int, float | None]] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    found += [("guess", a, b, cost) for a, b, cost in values if cost >= hard]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "struct<spans: array<struct<kind: string, start: long, end: long, guesses_log10: double>>, costs: array<double>>"


def secret_spans(text: Column, hard: float = HARD, words: Broadcast | None = None) -> Column:
    """The spans (kind, start, end, guesses_log10) of a text column, and the cost of each credential value; empty for null text.

    `words` are ranks of words, broadcast.
    """

    kind = _arrow(f"s {SPANS}")[0].type
    names = ("kind", "start", "end", "guesses_log10")

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = words and words.value
        for texts in batches:
            found: list[dict] = []
            for part in parts(texts):
                for t in texts[part].to_pylist():
                    values = credential_values(t, ranks)
                    found.append({"spans": [dict(zip(names, x, strict=True)) for x in _with_values(t, values, hard)] if t else [], "costs": [v[2] for v in values]})
            yield pa.array(found, kind)

    return spans(text)


def redact(text: str | None, mark: str = "[SECRET]", hard: float = HARD, words: dict[str, int] | None = None) -> str | None:
    """The text with every span, and what overlaps it, replaced by one mark."""
    spans = find_secrets(text, hard, words)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """`df` with the secrets in `text_col` replaced; `chars_col`, if there, follows. Rows, nulls and other columns stay."""
    small_batches(df.sparkSession)
    words = df.sparkSession.sparkContext.broadcast(word_ranks(vocabulary))

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [pa.array([redact(t, words=words.value) for t in texts[part].to_pylist()], pa.string()) for part in parts(texts)]
            yield pa.concat_arrays(done or [pa.array([], pa.string())])

    names = df.columns
    out = df.withColumn(text_col, clean(F.col(text_col)))
    if chars_col in names:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(df.schema[chars_col].dataType)))
    return out.select(names)


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of `df`: counts by kind, a digest of the fixed patterns' spans, all spans as text, and the values' costs.

    Null and empty texts have no span: zero counts, the digest of an empty string, null costs. Repeated rows give repeated rows.
    """
    small_batches(df.sparkSession)
    words = df.sparkSession.sparkContext.broadcast(word_ranks(vocabulary))
    found = df.select(F.col(id_col), secret_spans(F.col(text_col), words=words).alias("_s")).select(id_col, F.col("_s.spans").alias("_spans"), F.col("_s.costs").alias("_costs"))
    joined = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("_spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        count("guess").alias("n_guess"),
        F.size("_costs").cast("long").alias("n_values"),
        F.array_max("_costs").alias("hardest_log10"),
        F.array_min("_costs").alias("easiest_log10"),
    )
