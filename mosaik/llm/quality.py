r"""Line-first cleaning of documents, with DataFrame functions only.

Base measures of a whole text come first; a text of fewer than 10 words, or with over a fifth of its
words in 5-word windows found twice or more, fails. Then each line is judged on its own, and lines that
fail any rule are removed:
  punctuation  it holds no end of a sentence and ends in no mark, closing quote or bracket;
  navigation   it is divided by two or more bars, or three or more arrows or bullets;
  symbols      over a tenth of its word characters are of [#*$%&|<>];
  shouting     it has two or more capitals, no small letter of a-z, and three or more words;
  boilerplate  it names scripts, cookies, terms, rights or a licence.
A document whose kept lines hold less than LEAST_KEPT of the characters of its lines is rejected.

Words are [^\x20\x09-\x0D]+ and lines are split at \n. No shuffle: each document is judged in its row.

Defined results: a null text counts as empty and, like an empty one, fails for having no words. Equal
rows get equal verdicts. Other columns, whatever their names, pass
through kept_documents() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words
LEAST_KEPT = 0.5
WINDOW = 5

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SYMBOL = "[#*$%&|<>]"
#: Rules of a line as patterns that both Java and RE2 read alike.
SENTENCE = r"""[.!?;:"')\]…”’»。！？；：」』）؟؛۔।॥።][\x20\x09-\x0D]*$|[.!?…؟۔।॥።][\x20\x09-\x0D]|[。！？]"""
BARS = r"\|[^|]*\|"
BULLETS = r"(?:[›»·•→][^›»·•→]*){3}"
CAPITALS = r"[A-Z][^A-Z]*[A-Z]"
SMALL = r"[a-z]"
THREE_WORDS = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]"
BOILERPLATE = r"(?i)javascript|cookie|terms of (?:use|service)|privacy policy|all rights reserved|licensed under|lorem ipsum|skip to (?:main )?content|sign up for"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def line_passes(line: Column) -> Column:
    """Whether a line passes every rule. Lines without a word count for nothing either way."""
    few_symbols = ~line.rlike(SYMBOL) | ((F.length(line) - _without(line, SYMBOLS)) * 10 <= _without(line, SPACES))
    return (
        line.rlike(SENTENCE)
        & ~line.rlike(BARS)
        & ~line.rlike(BULLETS)
        & few_symbols
        & ~(line.rlike(CAPITALS) & ~line.rlike(SMALL) & line.rlike(THREE_WORDS))
        & ~line.rlike(BOILERPLATE)
    )


def _repeated(grams: Column) -> Column:
    """Words covered by windows that occur twice or more in the text."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))

        kept = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
        at = F.sort_array(F.transform(kept, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        # Each window adds what lies beyond the end of those before it.
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((a["n"] + i + F.lit(WINDOW) - F.greatest(a["end"], i)).alias("n"), (i + F.lit(WINDOW)).alias("end")),
            lambda a: a["n"],
        )

    # transform over a one-element array binds the sorted windows once.
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(F.transform(F.array(placed), covered)[0])


def _computed(df: DataFrame, **values: Column) -> DataFrame:
    """df with more columns, behind a generator: filters on them stay above it, so nothing is computed twice."""
    held = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("computed")
    return df.select("*", held).select(*df.columns, "computed.*")


def measured(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Two columns: row, the struct of the columns of docs, and q, a struct of n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and cleaned (the lines that passed)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    trimmed = F.btrim("t", F.lit(SPACES))
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    a = _computed(
        rows,
        w=F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        l=F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    )
    gram = F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    b = _computed(a, g=gram, k=F.filter("l", line_passes))
    c = _computed(
        b,
        n=F.size("w").cast("long"),
        r=_repeated(F.col("g")).cast("long"),
        all=F.aggregate("l", F.lit(0), lambda s, x: s + F.length(x)),
        held=F.aggregate("k", F.lit(0), lambda s, x: s + F.length(x)),
    )
    failed = (F.col("n") < LEAST_WORDS) | (F.col("r") * 100 > F.col("n") * MOST_REPEATED)
    q = F.struct(
        F.col("n").alias("n_words"),
        _without(F.col("t"), SPACES).cast("long").alias("word_chars"),
        F.when(F.col("t").rlike(SYMBOL), F.length("t") - _without(F.col("t"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("held") >= F.col("all") * F.lit(least_kept))).alias("kept"),
        F.array_join("k", "\n").alias("cleaned"),
    )
    return c.select("row", q.alias("q"))


def kept_documents(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The documents that are not rejected, with the text of the lines that passed; n_chars, if present, follows the text."""
    text = F.col("q.cleaned")
    of = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return measured(docs, least_kept).filter("q.kept").select(*[of.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


#: DuckDB's form of the query.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS r
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
k AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '{SENTENCE.replace("'", "''")}') AND NOT regexp_matches(x, '{BARS}')
             AND NOT regexp_matches(x, '{BULLETS}')
             AND length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 10 <= length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
             AND NOT (regexp_matches(x, '{CAPITALS}') AND NOT regexp_matches(x, '{SMALL}') AND regexp_matches(x, '{THREE_WORDS}'))
             AND NOT regexp_matches(x, '{BOILERPLATE}')) AS k FROM w),
m AS (SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
             coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total, coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) AS held
      FROM k LEFT JOIN cov ON k.doc_id = cov.doc_id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND held >= total * {LEAST_KEPT}::DOUBLE AS kept FROM f
"""
