"""URL filter: rules first, else a logistic regression on hashed character n-grams of host and path.

The model is Spark ML's, trained on a small table of labelled URLs; features are computed by column functions, so
pages are judged in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14  # slots of the hashed n-grams
GRAMS = (3, 4, 5)

#: (pattern, verdict): host suffix and start of the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Labelled URLs to learn from: hosts and paths of the usual unwanted kinds, and of plain sites.
BLOCKED = [
    "http://cheap-pills.example.com/en/12", "https://www.cheap-pills.example.org/shop/buy", "http://discount-pills.example.org/order",
    "https://online-pharmacy-pills.example.com/viagra", "https://casino-win.example.org/en/7", "http://www.casino-win.example.com/play",
    "https://best-casino.example.com/slots/jackpot", "http://m.win-casino-bonus.example.org/fr/3", "https://free-bets.example.com/en/9",
    "http://m.free-bets.example.org/odds", "https://sports-bets.example.com/betting/tips", "http://bets-online.example.org/de/4",
    "https://spam-farm.example.org/en/1", "http://www.spam-farm.example.com/links", "https://link-farm.example.com/seo/backlinks",
    "http://spam-links.example.org/page/2", "https://ads-track.example.org/en/5", "http://ads-track.example.com/click",
    "https://track-ads.example.com/pixel/banner", "http://adserver.example.org/popup/ads", "https://xxx-adult-video.example.com/porn",
    "http://free-porn.example.org/xxx/live", "https://payday-loans.example.com/fast-cash", "http://replica-watches.example.org/cheap",
]
ALLOWED = [
    "https://www.news-daily.example.com/en/article/12", "http://blog.garden.example.org/es/978", "https://m.library.example.com/fr/25",
    "https://therin.example.com/en/770", "http://ththed.example.org/en/453", "https://blog.thertion.example.org/es/7",
    "http://www.therti.example.org/en/334/", "https://thther.example.org/en/762", "http://m.tiontion.example.com/de/252.html",
    "https://docs.project.example.org/guide/install", "http://wiki.science.example.com/physics/waves", "https://school.example.org/history/lesson/3",
    "http://www.museum.example.com/collection/1847", "https://city-council.example.org/minutes/2020", "http://weather.example.com/forecast/week",
    "https://recipes.kitchen.example.com/bread/rye", "http://blog.travel.example.org/en/rivers", "https://forum.code.example.com/questions/81",
    "http://ththwh.example.org/en/471", "https://www.theren.example.com/en/148.html", "https://health-ministry.example.org/en/advice",
    "http://music-school.example.com/concert/9", "https://blog.ththly.example.org/en/777", "http://university.example.org/papers/statistics",
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, A-Z in lower case; then up to ``? #``. Else both empty."""
    begins = F.instr(url, "://")
    rest = F.when(begins > 0, F.substring(url, begins + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    text = F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    return text, F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; ties: the first in the list.

    A rule ``domain/start`` fits the domain and its subdomains where the path starts with ``/start``.
    """
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0]), k))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for k in reversed(order):
        pattern, verdict = rules[k]
        domain, _, start = pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(pattern).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, mark: str) -> Column:
    """Character n-grams of ``^text$``, each marked; linear in the length of the text for each n."""
    chars = F.split(F.concat(F.lit("^"), F.lower(text), F.lit("$")), "")
    chars = F.filter(chars, lambda c: c != "")
    out = []
    for n in GRAMS:
        gram = chars
        for k in range(1, n):
            gram = F.zip_with(gram, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
        out.append(F.transform(F.filter(gram, lambda g: g.isNotNull()), lambda g: F.concat(F.lit(mark), g)))
    return F.concat(*out)


def featured(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``grams`` and the vector ``features``."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(
        urls.withColumn("grams", F.concat(grams(F.col("host"), "h:"), grams(F.col("path"), "p:")))
    )


def train(spark: SparkSession, labelled: list[tuple[str, float]] | None = None) -> LogisticRegressionModel:
    """A regression from (url, 1 to block or 0) pairs; the table is small and stays in one partition."""
    pairs = labelled or [(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED]
    host, path = parts(F.col("url"))
    table = spark.createDataFrame(pairs, "url string, label double").coalesce(1).select(host.alias("host"), path.alias("path"), "label")
    return LogisticRegression(regParam=0.005, maxIter=60, standardization=False).fit(featured(table).select("features", "label"))


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url).

    The longest rule that fits decides; else the model blocks at ``threshold``. ``score`` is the model's probability of
    blocking, for all rows. A null url, or one without ``://``, has an empty host and path, fits no rule and is judged
    by the model as such. Repeated rows are judged alike; rows without page_id are returned; other columns are ignored;
    an empty table gives an empty result. Upper-case letters other than A-Z stay as they are in ``host``.
    """
    model = model or train(pages.sparkSession)
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = model.transform(featured(cut)).select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), vector_to_array("probability")[1].alias("score")
    )
    judged = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), judged.alias("verdict"), "score")
