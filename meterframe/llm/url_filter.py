"""URL verdicts: longest matching rule first, logistic regression on hashed character n-grams for the rest.

DataFrame functions and Spark ML only: nothing runs in Python on the executors.

The small labelled URL table is the bounded sample of URLs that a rule decides (``TRAIN_URLS`` of them,
the lowest by hash, so reruns agree): the rules are trusted labels, and the model carries them to hosts
and paths that no rule names.  Its features are hashed 3- and 4-grams of ``^host/`` and of the path.

Defined results: a null URL, or one without ``://``, has empty host and path; no rule fits an empty host,
and its verdict is the model's for empty text.  Of rules that fit, the one with the longest text wins
(ties by text).  If the labelled URLs hold one class or none, the model answers with that class (allow
if none).  Rows repeated whole stay repeated.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import ascii_lower, stored

#: (verdict, host, path prefix) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TRAIN_URLS = 5000
FEATURES = 1 << 14
ROUNDS = 30


def split_url(c: str) -> tuple[Column, Column]:
    """(host, path): the host A-Z lower-cased, the path without query and fragment."""
    at = F.instr(F.col(c), "://")
    rest = F.when(at > 0, F.substr(F.col(c), at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = none
    # Shortest first, so that each longer rule overrides what was found before it.
    for verdict, rhost, rpath in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        out = F.when(fits, F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(c: Column, sizes=(3, 4)) -> Column:
    """All character n-grams of a string as one array."""
    parts = []
    for n in sizes:
        last = F.length(c) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, lambda i, n=n: F.substring(c, i, F.lit(n))))
    return F.concat(*parts)


def featurise(df: DataFrame) -> DataFrame:
    """Add ``features``: binary hashed n-grams; host and path grams carry different prefixes."""
    host = F.transform(_grams(F.concat(F.lit("^"), F.col("host"), F.lit("/"))), lambda g: F.concat(F.lit("h:"), g))
    path = F.transform(_grams(F.col("path")), lambda g: F.concat(F.lit("p:"), g))
    tf = HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return tf.transform(df.withColumn("_grams", F.concat(host, path))).drop("_grams")


def labelled_urls(ruled: DataFrame, bound: int = TRAIN_URLS) -> DataFrame:
    """At most ``bound`` distinct (host, path, label) that a rule decides, lowest hash first."""
    pool = ruled.filter("rule is not null").groupBy("host", "path").agg(F.max(F.expr("cast(verdict = 'block' as double)")).alias("label"))
    return pool.orderBy(F.xxhash64("host", "path"), "host", "path").limit(bound)


def judge(pages: DataFrame, rules=RULES, bound: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the model's probability of block)."""
    host, path = split_url("url")
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("_r", best_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict")
    )
    # Stored and read as one partition: the sums behind the fit then come in one order, so reruns agree.
    train = stored(labelled_urls(ruled, bound).coalesce(1), "url-labels").coalesce(1)
    classes = [r[0] for r in train.select("label").distinct().limit(2).collect()]
    if len(classes) < 2:
        score = F.lit(classes[0] if classes else 0.0)
        scored = ruled.withColumn("block_score", score)
    else:
        model = LogisticRegression(maxIter=ROUNDS, regParam=1e-4, standardization=False, featuresCol="features", labelCol="label").fit(featurise(train))
        scored = model.transform(featurise(ruled)).withColumn("block_score", vector_to_array("probability")[1])
    method = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "block_score")
