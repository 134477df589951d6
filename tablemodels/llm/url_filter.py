"""Allow or block web addresses by rules and, where none fits, by a logistic regression on character n-grams.

The n-grams of host and path (three to five characters) are hashed into a fixed
number of features; the regression learns from a small labelled table of
addresses. Rules are (verdict, "host/path"): a rule fits its host and all
subdomains if the path starts with the rule's; the longest wins, and blocking
wins between equally long ones. Everything runs as expressions and Spark ML
inside the JVM.

A null address, or one without ``://``, has an empty host and path, which no
rule fits; the regression judges it like any other. Repeated rows are judged
each. Empty tables give no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
SIZES = (3, 4, 5)
MOST_RULES = 500  # they are part of the expression

# Labelled addresses, one example of each kind of host.
BLOCKED = """
casino-win.example.com/en/12 www.casino-win.example.net/de/7.html best-casino.example.com/fr/1 casino-bonus.example.org/en/3/
mega-casino.example.net/en/44 online-casino.example.com/es/5 m.casino-royal.example.net/en/6 casino.example.com/en/8
free-bets.example.com/en/9 www.free-bets.example.net/fr/2/ sport-bets.example.com/de/3 best-bets.example.com/en/4
live-bets.example.org/en/5 bets-online.example.net/en/6#top poker-room.example.com/en/7 free-poker.example.net/es/8
slots-win.example.com/en/9 free-spins.example.com/en/10 jackpot-win.example.net/fr/11 lotto-win.example.com/de/12
cheap-pills.example.com/en/1 www.cheap-pills.example.net/de/2 buy-pills.example.com/en/3 diet-pills.example.org/fr/4
pills-online.example.net/en/5 cheap-meds.example.com/en/6 cheap-viagra.example.com/es/7 cheap-replica.example.net/en/8
spam-farm.example.com/en/1 www.spam-farm.example.net/en/2 link-farm.example.com/de/3 content-farm.example.org/en/4
spam-mail.example.com/en/5 spam-links.example.net/fr/6 like-farm.example.com/en/7 click-farm.example.net/en/8
adult-x.example.com/en/1 www.adult-x.example.net/en/2 adult-cam.example.com/de/3 adult-dating.example.org/en/4
xxx-video.example.com/en/5 free-xxx.example.net/fr/6 porn-x.example.com/en/7 free-porn.example.net/es/8
ads-track.example.com/en/1 m.ads-track.example.net/en/2 ads-server.example.com/de/3 track-click.example.net/en/4
click-track.example.com/en/5 ads-click.example.org/fr/6 pop-ads.example.com/en/7 ads-pixel.example.net/en/8
quick-loan.example.com/en/1 payday-loan.example.net/en/2 free-money.example.com/en/3 crypto-win.example.net/en/4
""".split()
ALLOWED = """
www.thering.example.org/en/1291/ tiontion.example.net/de/6137 m.ththes.example.org/en/873 blog.theror.example.com/de/1373#top
therhe.example.org/en/8423 ththan.example.com/en/7944 therst.example.net/fr/4163 blog.tionsh.example.com/fr/7424.html
ththble.example.com/fr/7376#top tionble.example.org/en/482/ www.ththing.example.net/en/7442.html ththre.example.com/fr/825
news.example.com/en/1 www.library.example.org/en/2 museum.example.net/fr/3 university.example.org/de/4 science.example.com/en/5
history.example.net/es/6 weather.example.com/en/7.html blog.garden.example.com/en/8 kitchen.example.net/en/9/ travel.example.com/fr/10
music.example.org/en/11 m.cinema.example.com/de/12 theatre.example.net/en/13 school.example.org/es/14 health.example.com/en/15
hospital.example.net/en/16 city-hall.example.org/de/17 open-data.example.com/en/18 daily-news.example.net/fr/19 math-notes.example.com/en/20
book-review.example.org/en/21 code-docs.example.com/en/22 local-paper.example.net/es/23 art-gallery.example.com/en/24 wiki.example.org/en/25
forum.example.net/de/26 sports.example.com/en/27 football.example.net/en/28 chess-club.example.org/fr/29 recipes.example.com/en/30
nature.example.com/en/31/ physics.example.org/en/32 biology.example.net/de/33 law-journal.example.com/en/34 economy.example.net/fr/35
lighthouse.example.com/en/36 mountain.example.org/es/37 river-guide.example.net/en/38 maps.example.com/de/39 trains.example.net/en/40
ondre.example.com/en/41 inglyth.example.net/fr/42 stereat.example.org/en/43 ndther.example.com/de/44 erationsh.example.net/en/45
ouener.example.org/es/46 blehion.example.com/en/47 hathst.example.net/en/48 edionre.example.com/fr/49 lyinst.example.org/en/50
""".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(length, block, rule) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules do not fit into one expression")
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rest = rule.partition("/")
        own = (host == rule_host) | host.endswith("." + rule_host)
        found = F.struct(
            F.lit(len(rule)).alias("length"), F.lit(verdict == "block").alias("block"), F.lit(rule).alias("rule")
        )
        fits.append(F.when(own & path.startswith(slash + rest), found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, block: boolean, rule: string>")


def grams(host: Column, path: Column) -> Column:
    """Distinct n-grams of host and path, each told from the other."""

    def cut(mark: str, text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        found = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))

    texts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    return F.array_distinct(F.concat(*[cut(mark, text, n) for mark, text in texts for n in SIZES]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 is block."""
    rows = [F.struct(F.lit("http://" + u).alias("url"), F.lit(float(y)).alias("label"))
            for y, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """The regression of a small table (url, label)."""
    features = _features(labelled, F.col("url")).select("label", "_features").coalesce(1)
    return LogisticRegression(featuresCol="_features", maxIter=100, regParam=0.005, standardization=False).fit(features)


def _features(df: DataFrame, url: Column) -> DataFrame:
    text = F.coalesce(url.cast("string"), F.lit(""))
    with_grams = df.withColumn("_grams", grams(host_of(text), path_of(text)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(with_grams)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]]) -> DataFrame:
    """The rows with columns host, path, rule and verdict."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    model.setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_blocked")
    scored = model.transform(_features(pages, F.col("url")))
    out = scored.withColumns({"host": host_of(url), "path": path_of(url)})
    out = out.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    block = F.coalesce(F.col("_rule.block"), F.col("_blocked") > 0.5)
    out = out.withColumns({"rule": F.col("_rule.rule"), "verdict": F.when(block, "block").otherwise("allow")})
    return out.drop("_rule", "_raw", "_probability", "_blocked", "_grams", "_features")
