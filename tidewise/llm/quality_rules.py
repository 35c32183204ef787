"""Quality rules, by DataFrame functions only: counts of bad shape, and how far a text's histograms are from its language's.

Two histograms of a text are compared with each language's by Jensen-Shannon distance: the classes of its characters, and its
common words among all words. Languages' histograms are sums over all their documents. A text is dropped if its own language, or the
nearest where its language is not known, is too far; short texts are not judged by a histogram that they are too short for, nor
texts by the common words of a language that has next to none of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import SPACE, stored, words

WINDOW = 5
# The limits that the task gives.
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = r"[#*$%&|<>]"
# Frequent words of four languages.
COMMON = (
    "the of and to in a is that it for was on are as with by at from this be "
    "de la le et les des en un une du que est pour dans qui sur au avec par pas "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "el que y los del se las por para con una su al lo como más es"
).split()
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "point": r"""[.,;:!?'"()\-]""", "symbol": r"[#*$%&|<>@=+/\\_~^\[\]{}`]", "other": r"[^\x00-\x7F]"}
#: Least code points and words for a histogram to count, and the largest distances that pass.
LEAST_CHARS, LEAST_FOR_WORDS = 200, 80
FAR_CLASSES, FAR_WORDS = 0.30, 0.325
#: Words of a language in all its documents for a reference, however large the other languages are.
LEAST_REFERENCE = 5_000
#: Share of a language's words that the list must have for its texts to be judged by them.
LEAST_COMMON = 0.05


def repeated_words(tokens: Column) -> Column:
    """Words that stand in a 5-word window found twice or more, first ones included. Linear but for a sort, and only
    texts with an equal pair of windows go past the first test."""
    n = F.size(tokens)
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = F.when(n >= WINDOW, F.transform(F.array(hashes), lambda h: F.transform(F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + d) for d in range(1, WINDOW)))))[0])
    placed = lambda ws: F.sort_array(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    heavy = lambda ws: F.transform(F.transform(F.array(ws), placed), lambda s: covered(starts(s)))[0]
    found = F.transform(F.array(windows), lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), heavy(ws)).otherwise(F.lit(0)))[0]
    return F.when(n >= WINDOW, found).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the counts that the rules need; null text counts as empty."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_words", words(F.col("_text")))
    found = F.filter("_words", lambda w: w.isin(COMMON))
    df = df.withColumn("_common", found).withColumn("_joined", F.concat_ws("", "_words"))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_code_points": F.length("_text").cast("long"),
            "word_chars": F.length("_joined").cast("long"),
            "n_symbols": F.regexp_count("_joined", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": F.when(F.instr("_text", "\n") > 0, repeated_lines(F.col("_text"))).otherwise(F.lit(0).cast("long")),
            "n_repeat_words": repeated_words(F.col("_words")),
            "class_counts": F.array(*(F.regexp_count("_joined", F.lit(c)) for c in CLASSES.values())),
            "common_counts": F.array(*(F.size("_common") - F.size(F.array_remove("_common", w)) for w in dict.fromkeys(COMMON))),
        }
    ).drop("_text", "_words", "_common", "_joined")


def _plus_rest(counts: Column, total: Column) -> Column:
    """The histogram as shares of `total`, the last for what none of the counts holds."""
    rest = F.concat(counts, F.array(F.greatest(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("int")))
    return F.transform(rest, lambda x: x / F.greatest(total, F.lit(1)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2: 0 for equal ones, 1 for those that share nothing."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(counted: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """(class shares, common-word shares) of each language with at least `LEAST_REFERENCE` words, from all its documents."""
    sums = [F.sum(F.col(name)[i]).alias(f"{name}{i}") for name, n in (("class_counts", len(CLASSES)), ("common_counts", len(dict.fromkeys(COMMON)))) for i in range(n)]
    rows = counted.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.sum("n_words").alias("n"), F.sum("word_chars").alias("chars"), *sums)
    out = {}
    for r in rows.where(F.col("n") >= LEAST_REFERENCE).orderBy(F.desc("n"), lang_col).collect():
        a, b = ([r[f"{k}{i}"] for i in range(n)] for k, n in (("class_counts", len(CLASSES)), ("common_counts", len(dict.fromkeys(COMMON)))))
        out[r[lang_col]] = ([x / max(1, r["chars"]) for x in [*a, max(0, r["chars"] - sum(a))]], [x / r["n"] for x in [*b, r["n"] - sum(b)]])
    return out


def distance(counts: Column, total: Column, lang: Column, known: dict[str, list[float]]) -> Column:
    """Distance to the language's histogram, or to the nearest of all for a language that has none; null if there is none at all."""
    if not known:
        return F.lit(None).cast("double")
    of = lambda k: F.array(*map(F.lit, k))
    own = F.try_element_at(F.create_map(*(x for name, k in known.items() for x in (F.lit(name), of(k)))), lang)
    table = F.when(own.isNotNull(), F.array(own)).otherwise(F.array(*map(of, known.values())))
    return F.transform(F.array(_plus_rest(counts, total)), lambda p: F.array_min(F.transform(table, lambda q: divergence(p, q))))[0]


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `df`: the counts, the distances, and whether the rules keep it.

    Null and empty texts have no word and fail the base rule. Documents without a language give no reference but are judged by the
    nearest; those of a language that has no reference have distances but pass the histogram rule.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = stored(measured(rows).drop("text"), "quality")
    known = references(counted)
    classes, common = ({name: k[i] for name, k in known.items()} for i in (0, 1))
    common = {name: k for name, k in common.items() if 1 - k[-1] >= LEAST_COMMON}
    lang = F.col("lang")
    judged = lang.isNull() | ~lang.isin(list(known)) | lang.isin(list(common))
    out = counted.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "class_distance": F.when(F.col("n_code_points") >= LEAST_CHARS, distance(F.col("class_counts"), F.col("word_chars"), lang, classes)),
            "word_distance": F.when((F.col("n_words") >= LEAST_FOR_WORDS) & judged, distance(F.col("common_counts"), F.col("n_words"), lang, common)),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= FAR_CLASSES) & (F.coalesce("word_distance", F.lit(0.0)) <= FAR_WORDS)
    unknown = F.col("lang").isNotNull() & ~F.col("lang").isin(list(known))
    return out.withColumn("kept", ~F.col("base_failed") & (near | unknown)).select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def _sql() -> str:
    """`quality_report` without its distances in DuckDB's SQL, over a view `documents`."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    common = [*dict.fromkeys(COMMON)]
    classes = ", ".join(f"len(regexp_extract_all(joined, {quoted(c)}))" for c in CLASSES.values())
    totals = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]')} + {part('z[2]')})) / 2, 0))"
    shares = lambda counts, total: f"list_transform(list_append({counts}, greatest({total} - list_sum({counts}), 0)), lambda x: x / greatest({total}, 1)::DOUBLE)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {quoted("[^\\x20\\x09-\\x0D]+")}) AS ws FROM documents
), j AS (
  SELECT *, array_to_string(ws, '') AS joined, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted("[^\\x20\\x09-\\x0D]")})) AS lines FROM d
), p AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), v AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS five FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM v WHERE five IS NOT NULL
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM g, range(5) AS t(k) WHERE g.n > 1 GROUP BY r
), held AS (
  SELECT r, w, count(*) AS n FROM p WHERE w IN ({", ".join(map(quoted, common))}) GROUP BY r, w
), h AS (
  SELECT r, map(list(w), list(n)) AS m FROM held GROUP BY r
), c AS (
  SELECT j.r, doc_id, lang, length(text) AS n_chars, len(ws)::BIGINT AS n_words, length(joined)::BIGINT AS word_chars, len(regexp_extract_all(joined, {quoted(SYMBOLS)}))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, [{classes}] AS a,
    list_transform([{", ".join(map(quoted, common))}], lambda w: coalesce(h.m[w], 0)) AS b
  FROM j LEFT JOIN repeated ON j.r = repeated.r LEFT JOIN h ON j.r = h.r
), t AS (
  SELECT lang, sum(n_words) AS n, sum(word_chars) AS chars, {totals("a", len(CLASSES))} AS a, {totals("b", len(common))} AS b FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {LEAST_REFERENCE}
), f AS (
  SELECT lang, {shares("a", "chars")} AS a, {shares("b", "n")} AS b FROM t
), s AS (
  SELECT r, min({distance(shares("c.a", "c.word_chars"), "f.a")}) AS classes,
    min(CASE WHEN 1 - f.b[{len(common) + 1}] >= {LEAST_COMMON} THEN {distance(shares("c.b", "c.n_words"), "f.b")} END) AS words
  FROM c, f WHERE c.lang IS NULL OR c.lang = f.lang OR c.lang NOT IN (SELECT lang FROM f) GROUP BY r
), u AS (
  SELECT c.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    (CASE WHEN n_chars >= {LEAST_CHARS} THEN coalesce(s.classes, 0) ELSE 0 END <= {FAR_CLASSES} AND CASE WHEN n_words >= {LEAST_FOR_WORDS} THEN coalesce(s.words, 0) ELSE 0 END <= {FAR_WORDS})
      OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM f)) AS near
  FROM c LEFT JOIN s ON c.r = s.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM u
"""


SQL = _sql()
