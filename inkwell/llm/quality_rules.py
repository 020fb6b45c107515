"""Operator 3: quality rules with adaptive thresholds, in Spark expressions only.

Every document gets counts from its whole text. A fixed base rule rejects short and repetitive documents.
Instead of further fixed cutoffs, quantile sketches of four rates are built per language and source:
log-linear histograms (32 sub-buckets per power of two, relative error below 1/32), kept as rows
(lang, source, rate, bucket, count). Such sketches merge by adding counts, do not depend on the order of
the rows, and their size is bounded by the number of buckets, so a hot source costs no more than another.

A rate's upper fence is the larger of a Tukey fence on the quartiles and the quantile above which only a
given share of the documents lies (``RATES``, in thousandths); the lower fence mirrors it. So every cutoff
is read from a sketch; the shares only say how much of a source one rate may reject where its quartiles
coincide, as they do for rates that are mostly zero. Quantiles of a language are averaged with those of
everything, and quantiles of a source with those of its language, weighted by their numbers of documents
against ``weight`` documents of the wider sketch: thresholds move without a step as a source grows. The
thresholds are joined back to the counts; values meet fences as buckets.

Repeated windows are told by 64-bit fingerprints of words and windows: two different windows of one text
are taken as equal with a chance of 2^-64.

Defined cases: a null text has no words; null language or source are groups of their own; repeated rows
are judged alike and stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import fresh, let
from .workspace import Workspace, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Rates in thousandths, as integer expressions over the counts, and the share of documents (in thousandths)
#: that may lie beyond the fence on either side where the quartiles leave less room.
RATES = {
    "word_len": ("word_chars * 1000 DIV n_words", 20),
    "symbols": ("n_symbols * 1000 DIV n_words", 50),
    "dup_lines": ("n_dup_lines * 1000 DIV n_lines", 5),
    "repeats": ("n_repeat_words * 1000 DIV n_words", 5),
}


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first occurrence included."""

    def of_hashes(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twice = F.transform(
                s,
                lambda x, i: F.when(
                    (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

        def covered(at: Column) -> Column:
            steps = F.transform(
                at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(order, marked), covered)
        )

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]),
        )
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, of_hashes))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_words)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) to ``df``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = F.filter(F.split(whole, SPACE, -1), lambda x: x != "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    bare = F.length(F.translate(whole, " \t\n\x0b\f\r", ""))
    got = df.withColumns(
        {
            "_words": of_words,
            "_lines": of_lines,
            "word_chars": bare.cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        }
    )
    return got.withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "n_repeat_words": F.col("_words.r").cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_dup_lines": (F.col("_lines.n") - F.col("_lines.d")).cast("long"),
        }
    ).drop("_words", "_lines")


def bucket(value: Column) -> Column:
    """Lower end of a value's log-linear bucket: exact below 64, then six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % power


def sketch(df: DataFrame, groups: list[str]) -> DataFrame:
    """Histogram sketches of the rates of documents that pass the base rule: groups, rate, bucket, n."""
    rates = F.array(
        *[F.struct(F.lit(k).alias("rate"), F.col(k).alias("value")) for k in RATES]
    )
    return (
        df.filter("NOT base_failed")
        .select(*groups, F.explode(rates).alias("r"))
        .groupBy(*groups, F.col("r.rate").alias("rate"), bucket(F.col("r.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


QUANTILES = ("low", "q1", "q3", "high")


def quantiles(sketches: DataFrame, groups: list[str], suffix: str) -> DataFrame:
    """Merge sketches to ``groups`` and read buckets: groups, rate, size, quartiles q1 and q3, tails low and high."""
    merged = sketches.groupBy(*groups, "rate", "bucket").agg(F.sum("n").alias("n"))
    steps = merged.groupBy(*groups, "rate").agg(
        F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b")
    )
    share = F.create_map(*[x for k, (_, m) in RATES.items() for x in (F.lit(k), F.lit(m))])[F.col("rate")]

    def at(part) -> Column:
        found = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("q")),
            lambda a, x: F.struct(
                (a["n"] + x["n"]).alias("n"),
                F.coalesce(a["q"], F.when((a["n"] + x["n"]) * 1000 >= F.col("size") * part, x["bucket"])).alias("q"),
            ),
        )
        return found["q"]

    parts = zip(QUANTILES, (share, F.lit(250), F.lit(750), 1000 - share), strict=True)
    return steps.select(*groups, "rate", F.col("size").alias(f"size{suffix}"), *[at(p).alias(f"{k}{suffix}") for k, p in parts])


def thresholds(sketches: DataFrame, weight: int, reach: int) -> DataFrame:
    """lang, source, and low and high fences per rate."""
    own = quantiles(sketches, ["lang", "source"], "")
    lang = quantiles(sketches, ["lang"], "_l")
    every = quantiles(sketches, [], "_e")

    def mean(q: str) -> Column:
        wide = f"((size_l * {q}_l + {weight} * {q}_e) DIV (size_l + {weight}))"
        return F.expr(f"(size * {q} + {weight} * {wide}) DIV (size + {weight})").alias(q)

    room = (F.col("q3") - F.col("q1")) * reach
    found = (
        own.join(lang.withColumnRenamed("lang", "lang_l").withColumnRenamed("rate", "rate_l"),
                 F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("rate") == F.col("rate_l")))
        .join(every.withColumnRenamed("rate", "rate_e"), F.col("rate") == F.col("rate_e"))
        .select("lang", "source", "rate", *[mean(q) for q in QUANTILES])
        .select("lang", "source", "rate", F.least(F.col("q1") - room, "low").alias("low"), F.greatest(F.col("q3") + room, "high").alias("high"))
    )
    fence = F.struct("low", "high")
    one = [F.first(F.when(F.col("rate") == k, fence), ignorenulls=True).alias(f"{k}_fence") for k in RATES]
    return found.groupBy("lang", "source").agg(*one)


def quality_rules(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = 20,
    repeat_percent: int = 30,
    weight: int = 100,
    reach: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every document: doc_id, lang, source, columns to ``carry``, the counts, base_failed, kept."""
    counted = text_counts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "lang", "source", *carry))
    counted = counted.drop("text").withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent),
    )
    spark = df.sparkSession
    counts = Workspace(spark, "quality-rules").save(counted, "counts")
    rated = counts.withColumns(
        {k: F.when(~F.col("base_failed"), F.expr(e)).otherwise(F.lit(0).cast("long")) for k, (e, _) in RATES.items()}
    )
    fences = thresholds(sketch(rated, ["lang", "source"]), weight, reach).withColumnsRenamed(
        {"lang": "fence_lang", "source": "fence_source"}
    )
    inside = F.lit(True)
    for k in RATES:
        inside = inside & bucket(F.col(k)).between(F.col(f"{k}_fence.low"), F.col(f"{k}_fence.high"))
    return (
        rated.join(
            fences,
            F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")),
            "left",
        )
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop("fence_lang", "fence_source", *RATES, *[f"{k}_fence" for k in RATES])
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def verdict_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose document the rules keep, with their own columns.

    Each row is judged by its own text, language and source: rows with a null or repeated doc_id like all
    others. Repeated rows stay or go together; a null or blank text goes; an empty table gives no rows.
    """
    mark, *good_keys = fresh(docs, "text_print", "good_id", "good_lang", "good_source", "good_print")
    keys = ["doc_id", "lang", "source", mark]
    marked = docs.withColumn(mark, F.xxhash64("text"))
    good = quality_rules(marked, carry=(mark,)).filter("kept")
    good = good.select(*[F.col(k).alias(g) for k, g in zip(keys, good_keys, strict=True)]).distinct()
    same = F.lit(True)
    for k, g in zip(keys, good_keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(g))
    return marked.join(good, same, "left_semi").select(*docs.columns)


_BUCKET = "(v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)))"


_SHARE = "(CASE rate " + " ".join(f"WHEN '{k}' THEN {m}" for k, (_, m) in RATES.items()) + " END)"


def _quantile_sql(name: str, groups: str, source: str) -> str:
    keys = f"{groups}, rate" if groups else "rate"
    return f"""
{name}_c AS (SELECT {keys}, bucket, sum(n)::BIGINT AS n,
    (sum(sum(n)) OVER (PARTITION BY {keys} ORDER BY bucket))::BIGINT AS c,
    (sum(sum(n)) OVER (PARTITION BY {keys}))::BIGINT AS size FROM sk GROUP BY {keys}, bucket),
{name} AS (SELECT {keys}, any_value(size) AS size, min(bucket) FILTER (c * 1000 >= size * {_SHARE}) AS low,
    min(bucket) FILTER (c * 1000 >= size * 250) AS q1, min(bucket) FILTER (c * 1000 >= size * 750) AS q3,
    min(bucket) FILTER (c * 1000 >= size * (1000 - {_SHARE})) AS high FROM {name}_c GROUP BY {keys})"""


def _mean_sql(q: str) -> str:
    return f"(own.size * own.{q} + 100 * ((lng.size * lng.{q} + 100 * evy.{q}) // (lng.size + 100))) // (own.size + 100) AS {q}"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS r
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (SELECT doc_id, lang, source, unnest([
        {{'rate': 'word_len', 'v': word_chars * 1000 // n_words}}, {{'rate': 'symbols', 'v': n_symbols * 1000 // n_words}},
        {{'rate': 'dup_lines', 'v': n_dup_lines * 1000 // n_lines}}, {{'rate': 'repeats', 'v': n_repeat_words * 1000 // n_words}}
        ], recursive := true) FROM b WHERE NOT base_failed),
sk AS (SELECT lang, source, rate, {_BUCKET} AS bucket, count(*) AS n FROM m GROUP BY ALL),
{_quantile_sql('own', 'lang, source', 'sk')}, {_quantile_sql('lng', 'lang', 'sk')}, {_quantile_sql('evy', '', 'sk')},
p AS (SELECT own.lang, own.source, own.rate, {', '.join(map(_mean_sql, QUANTILES))}
      FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.rate = lng.rate JOIN evy ON own.rate = evy.rate),
f AS (SELECT lang, source, rate, least(q1 - 3 * (q3 - q1), low) AS lo, greatest(q3 + 3 * (q3 - q1), high) AS hi FROM p),
bad AS (SELECT DISTINCT doc_id FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang
        AND m.source IS NOT DISTINCT FROM f.source AND m.rate = f.rate WHERE {_BUCKET} < lo OR {_BUCKET} > hi)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""
