"""URL decisions: fixed rules first, then logistic regression on hashed character n-grams.

The model sees the character n-grams of host and path, hashed into a fixed number of features
with host and path kept apart, and is trained on a small labelled URL table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, below paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched(rules: list[Rule], host_col: Column, path_col: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(host_col: Column, path_col: Column) -> Column:
    """N-grams of both parts; a look-ahead finds the overlapping ones in one pass over the text."""

    def found(tag: str, part: Column, n: int) -> Column:
        grams = F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
        return F.transform(grams, lambda gram: F.concat(F.lit(tag), gram))

    return F.concat(*[found(tag, part, n) for tag, part in (("h:", host_col), ("p:", path_col)) for n in GRAMS])


def _vectors(df: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    return hashed.transform(df.withColumn("_grams", _grams(F.col("_host"), F.col("_path"))))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> LogisticRegressionModel | float:
    """A model of the share of blocked URLs; just that share if the labels don't hold both kinds.

    Rows with null url or label teach nothing; repeated rows count again. Without any row the share is 0.
    """
    known = labelled.select(
        host(F.col(url_col)).alias("_host"), path(F.col(url_col)).alias("_path"),
        F.col(label_col).cast("double").alias("_label"),
    ).where(F.col(url_col).isNotNull() & F.col("_label").isNotNull())
    share = known.agg(F.avg("_label")).first()[0] or 0.0
    if share in (0.0, 1.0):
        return share
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1e-3, maxIter=60, predictionCol="_p",
                             probabilityCol="_probability", rawPredictionCol="_raw")
    return fit.fit(_vectors(known))


def judge(urls: DataFrame, rules: list[Rule], model: LogisticRegressionModel | float, id_col: str = "page_id",
          url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block): one row per row of ``urls``.

    The verdict is the longest fitting rule's, else block when the model's probability reaches
    ``threshold``. A null URL or one without :// has an empty host and path, fits no rule and is
    judged by the model. Repeated rows stay; extra columns are ignored.
    """
    split = urls.select(
        F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col).cast("string")).alias("_host"),
        path(F.col(url_col).cast("string")).alias("_path"),
    )
    if isinstance(model, float):
        scored = split.withColumn("p_block", F.lit(model))
    else:
        scored = model.transform(_vectors(split)).withColumn("p_block", vector_to_array("_probability")[1])
    by_rule = matched(rules, F.col("_host"), F.col("_path"))
    by_model = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.withColumn("_rule", by_rule).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "p_block",
    )
