"""Operator 6: URL filters: rules, and a logistic regression on hashed character n-grams.

Host and path are cut from the URL as text. Where a rule (host, path) fits - the host is the rule's or a
subdomain of it, and the path starts with the rule's - the longest fitting rule decides; elsewhere a
linear model on the character n-grams, one to four characters long, of host and path decides. The model is trained
on a small labelled table (url, label), at most ``MAX_LABELLED`` rows, both labels with equal weight in all.
:func:`labelled_urls` makes the table that the query uses from two lists of host words. The unwanted ones have no
four characters in a row in common with any unwanted host of the synthetic pages, so what the model says of those
comes from shorter pieces, above all from the hyphen between two words, which is more frequent in the unwanted names.

Rules are a table of any size. They are looked up, not tried: each host of the pages asks for the rules of
itself and of the domains above it, by name, once however many URLs it has; its URLs then try the paths of those.

Defined cases: null URLs and labels in the labelled table are left out; a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by
the model; repeated URLs are judged alike and stay; equally long rules: the one that sorts last; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import fit, hashed, score
from .workspace import table

MAX_LABELLED, SIZE = 10_000, 1 << 14
#: Of 1e-5 to 0.3 the best on words of the labelled table that were left out of training.
REG = 1e-3
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The host words of the small labelled table.
UNWANTED = (
    "lotto-jackpot", "poker-bonus", "roulettetips", "slots-royal", "bingo-cash", "payday-loans", "quickcredit", "forex-profit", "crypto-double", "rich-quick",
    "fake-watches", "replicabags", "diploma-mill", "warez-zone", "serial-keygen", "torrentrip", "porn-tube", "nudecams", "escort-girls", "xxx-clips",
    "viagra-shop", "steroidstore", "diet-miracle", "slim-tea", "popup-banner", "clickbait", "link-exchange", "seo-booster", "proxy-unblock", "hacktools",
)
WANTED = (
    "library", "museum", "weather", "garden", "history", "science", "kitchen", "teacher", "village", "journal",
    "archive", "theatre", "mountain", "railway", "painting", "orchestra", "harbour", "bakery", "cycling", "chemistry",
    "geology", "furniture", "football", "language", "poetry", "parliament", "hospital", "university", "recipes", "astronomy",
    "wildlife", "carpentry", "translation", "dictionary", "printing", "lighthouse", "festival", "ceramics", "economics", "philosophy",
    "grammar", "nursery", "bicycle", "concert", "medicine", "fisheries", "insurance", "textiles", "climbing", "gallery",
    "observatory", "folklore", "heritage", "beekeeping", "charity", "fashion", "engineering", "community", "newspaper", "research",
    "town-library", "art-school", "bird-atlas", "jazz-festival", "rail-maps", "old-prints",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label): each host word under a few prefixes, domains and paths; label 1 is unwanted."""
    words = spark.createDataFrame([(w, 1.0) for w in UNWANTED] + [(w, 0.0) for w in WANTED], "word string, label double")
    return words.selectExpr("word", "label", "explode(sequence(0, 3)) AS j", "pmod(crc32(word), 9000) AS k").selectExpr(
        """concat('https://', element_at(array('', 'www.', 'm.', 'blog.'), j + 1), word, '.example.',
            element_at(array('com', 'org', 'net', 'com'), j + 1), '/', element_at(array('en', 'fr', 'de', 'es'), int(pmod(j + k, 4)) + 1), '/',
            k + 11 * j, element_at(array('', '.html', '/', '?page=2'), int(pmod(j + k DIV 4, 4)) + 1)) AS url""",
        "label",
    )


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """verdict, host, path of rules, given as such a table or as a list."""
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host and path; null where none does."""
    one = F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict", "path")
    known = rules.dropna().groupBy(F.col("host").alias("_domain")).agg(F.collect_set(one).alias("_rules"))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1  # no rule has a longer name
    labels = F.split("_host", r"\.")
    above = F.transform(F.sequence(F.greatest(F.size(labels) - depth + 1, F.lit(1)), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select(F.col("host").alias("_host")).distinct().select("_host", F.explode(above).alias("_domain"))
    asked = hosts.join(known, "_domain").groupBy("_host").agg(F.flatten(F.collect_list("_rules")).alias("_rules"))
    fits = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    found = rows.join(asked, F.col("host") == F.col("_host"), "left").withColumn("_best", best)
    return found.withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_host", "_rules", "_best")


def url_rules(df: DataFrame, key: str = "page_id", url: str = "url", rules: DataFrame | Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict of every URL."""
    host, path = url_parts(F.col(url))
    return with_rules(df.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")), rule_table(df.sparkSession, rules))


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams, from one to four characters, of the text between two marks, as tokens."""

    def cut(c: Column) -> Column:
        def of(n: int) -> Column:
            at = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.concat(F.lit(mark), *[F.get(c, i + j) for j in range(n)]))

        return F.concat(*[of(n) for n in range(1, 5)])

    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda x: x != "")
    return F.transform(F.array(chars), cut)[0]


def with_features(df: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    parts = df.withColumns({"host": host, "path": path})
    tokens = parts.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return hashed(tokens, "_grams", "_features", SIZE, binary=True).drop("_grams")


def url_filter(
    df: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: DataFrame | Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """Judge every URL: key, host, path, rule, score (probability of unwanted), verdict."""
    labelled = labelled_urls(df.sparkSession) if labelled is None else labelled
    train = labelled.select("url", F.col("label").cast("double").alias("label")).dropna()
    if not 0 < train.limit(MAX_LABELLED + 1).count() <= MAX_LABELLED:
        raise ValueError(f"1 to {MAX_LABELLED} labelled URLs")
    kinds = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two labels
    balance = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, sum(kinds.values()) / (len(kinds) * n))])
    known = with_features(train.coalesce(1), "url").withColumn("_weight", balance[F.col("label")])
    model = fit(known, "_features", "label", weight="_weight", reg=REG, iterations=60)
    rows = with_features(df.select(F.col(key).alias("page_id"), F.col(url).alias("url")), "url")
    found = with_rules(score(model, rows, "_features", "score").drop("_features", "url"), rule_table(df.sparkSession, rules))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the filter that SQL can say: host, path, and what the rules decide."""
    return url_rules(table(spark, sf_dir, "pages"))


OP6_RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(verdict, h, t) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path, arg_max(h || t, length(h || t)) AS rule, arg_max(verdict, length(h || t)) AS rule_verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY page_id, host, path
"""
