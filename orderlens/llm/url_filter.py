"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest.

Everything runs as DataFrame functions and pyspark.ml stages in the JVM; judging is map-only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule): a host, then a path prefix from the first slash on.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Lengths of the n-grams; hashed features; probability from which a URL is blocked.
GRAMS, BINS, BLOCK_FROM = (3, 4, 5), 1 << 16, 0.5
#: Weight of an ordinary URL (a quarter of the table): most of what is judged is ordinary, and unknown n-grams decide nothing.
GOOD_WEIGHT = 50.0

#: The small labelled table: hosts and paths that sell gambling, drugs, loans and the like, and ordinary ones.
BAD_HOSTS = (
    "casino-win.example.com", "www.casino-royal.example.net", "m.online-casino.example.org", "best-casino.example.com", "free-bets.example.com",
    "sports-bets.example.net", "www.betting-today.example.org", "cheap-pills.example.com", "www.buy-pills.example.net", "pills-online.example.org",
    "m.diet-pills.example.com", "adult-cams.example.com", "www.hot-cams.example.net", "xxx-videos.example.org", "xxx-adult.example.com",
    "payday-loans.example.com", "quick-loans.example.net", "www.loans-now.example.org", "replica-watches.example.com", "www.cheap-replica.example.net",
    "win-prizes.example.com", "m.free-prizes.example.org", "lottery-winner.example.net", "www.lottery-jackpot.example.com", "jackpot-slots.example.org",
    "poker-slots.example.com", "www.poker-bonus.example.net", "viagra-sale.example.com", "cheap-viagra.example.org", "crack-keygen.example.net",
    "spam-mail.example.com", "www.link-farm.example.net", "spam-farm.example.org", "popup-ads.example.com", "warez-crack.example.net", "m.porn-tube.example.org",
    "bigcasino.example.net", "onlinebets.example.org", "freeporn.example.com", "escort-girls.example.net",
)
GOOD_HOSTS = (
    "news.example.com", "www.library.example.org", "m.museum.example.net", "school.example.com", "www.cityhall.example.org", "weather.example.net",
    "blog.garden.example.com", "www.recipes.example.net", "science.example.org", "m.history.example.com", "www.travel.example.net", "music.example.org",
    "docs.python.example.com", "www.university.example.org", "m.health.example.net", "blog.painting.example.com", "www.railway.example.org", "maps.example.net",
    "city-news.example.com", "www.book-club.example.org", "open-library.example.net", "red-cross.example.org", "m.art-museum.example.com", "high-school.example.net",
    "blog.lemon.example.com", "www.mountain.example.org", "harbour.example.net", "theatre.example.com", "www.ministry.example.org", "orchestra.example.net",
    "m.tribune.example.com", "farmers-market.example.org", "www.cycling.example.net", "chess-club.example.com", "blog.notebook.example.org", "astronomy.example.net",
    "the-times.example.com", "www.nature-trust.example.org", "station.example.net", "blog.winter.example.com",
)
BAD_PATHS = (
    "/casino/bonus", "/online-casino-games.html", "/poker-bonus", "/slots/free-spins", "/jackpot", "/win-prizes.php", "/sports-betting/odds", "/bets/today",
    "/buy-viagra", "/cheap-pills/order", "/viagra-sale.html", "/diet-pills", "/xxx/videos", "/adult/cams", "/porn/free.html", "/hot-cams/live",
    "/payday-loans", "/quick-loans/apply", "/replica-watches", "/cheap-replica/handbags", "/crack-keygen.exe", "/warez/download", "/lottery-winner", "/escort-girls",
)
GOOD_PATHS = (
    "/", "/index.html", "/about", "/contact.html", "/news/2024/05/council-meeting", "/weather/forecast", "/recipes/apple-cake", "/library/opening-hours",
    "/museum/tickets.html", "/history/middle-ages", "/docs/tutorial/functions", "/music/concerts", "/travel/train-journeys", "/blog/my-garden", "/science/physics/light", "/school/timetable.pdf",
    "/en/825", "/de/1373", "/fr/4163.html", "/es/66/", "/en/3413", "/fr/7817", "/article/12345", "/people/staff",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the built-in table: every host with every path; a URL is bad (1) if its host or its path is."""
    hosts = [(h, y) for group, y in ((BAD_HOSTS, 1.0), (GOOD_HOSTS, 0.0)) for h in group]
    paths = [(p, y) for group, y in ((BAD_PATHS, 1.0), (GOOD_PATHS, 0.0)) for p in group]
    return spark.createDataFrame([(f"https://{h}{p}", max(x, y)) for h, x in hosts for p, y in paths], "url string, label double").coalesce(2)


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; null urls and those without `://` have both empty."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def grams(text: Column, lengths: tuple[int, ...] = GRAMS) -> Column:
    """Distinct character n-grams."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    each = [of(n) for n in lengths]
    return F.array_distinct(F.concat(*each))


def features(urls: DataFrame) -> DataFrame:
    """Adds the array `grams`: the host's, without the usual first labels, and the path's marked as such."""
    name = F.regexp_replace("host", r"^(www|m|blog)[.]", "")
    parts = F.concat(grams(F.concat(F.lit("^"), name, F.lit("$"))), F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("/:"), g)))
    return with_parts(urls).withColumn("grams", parts)


def train(labelled: DataFrame, bins: int = BINS) -> PipelineModel:
    """Fits on a small table (url, label 0 or 1); rows with a null in either teach nothing."""
    rows = features(labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null and label is not null"))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(GOOD_WEIGHT))
    stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=bins, binary=True), LogisticRegression(regParam=0.003, maxIter=40, standardization=False, weightCol="weight")]
    return Pipeline(stages=stages).fit(rows)


def fits(rule: str) -> Column:
    """Whether a rule's host is the URL's or above it, and the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    under = (F.col("host") == host) | F.col("host").endswith(f".{host}")
    return under & F.col("path").startswith(slash + path) if slash else under


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and probability.

    The longest rule that fits decides (ties: the first in order of text); where none fits, the model does.
    Null urls and urls without `://` have empty parts, fit no rule with a host, and are allowed. The rules are a
    list in the plan. Columns called like the results are replaced; others pass through, repeated rows too.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    pages = pages.drop("host", "path", "rule", "verdict", "probability")
    # Packed, so that no column is taken for one of the model's.
    rows = train(labelled).transform(features(pages.select(F.struct("*").alias("page"), "url"))).withColumn("probability", vector_to_array("probability")[1])
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("host") != "") & (F.col("probability") >= BLOCK_FROM), "block").otherwise("allow")
    for what, text in reversed(ordered):
        rule, verdict = F.when(fits(text), text).otherwise(rule), F.when(fits(text), what).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict).select("page.*", "host", "path", "rule", "verdict", "probability")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """`judge` of all page URLs by the built-in rules and labelled table; nulls, empties and repeats as it says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "probability")
