"""URL filters: host and path rules, and a logistic regression on hashed character n-grams where no rule fits.

Everything is SQL expressions.  The model is trained by a fold over epochs inside
one ``aggregate`` expression; its ``DIMENSIONS`` weights and bias are then a
constant of the scoring plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules, in order of their text.
RULES = (
    ("com/de/", "block"),
    ("com/fr/", "allow"),
    ("example.org/en/1", "block"),
    ("example.org/es/", "block"),
    ("org/", "allow"),
)

# The labelled URLs, none on a host that is judged; first those to allow, then those to block.  Both
# have many domains, so that an ending alone says nothing, and most words of junk have an innocent look-alike.
ALLOWED = (
    "http://news.example.com/world/2021/article.html",
    "https://crates.io/crates/serde",
    "https://itch.io/games",
    "https://readthedocs.io/projects",
    "https://sentry.io/welcome/",
    "https://20minutos.es/noticias",
    "https://www.sussex.ac.uk/study",
    "https://wessex-trains.co.uk/en/4",
    "https://netbsd.example.net/ports",
    "https://hs.fi/kotimaa",
    "https://blast.ncbi.nlm.nih.gov/Blast.cgi",
    "https://theatre.example.net/de/8",
    "https://ether-lab.example.net/en/31",
    "https://trackside-cafe.example.net/menu",
    "https://rackets.example.com/tennis/3",
    "https://cheapside-books.example.com/en/9",
    "https://today-in-history.example.com/en/7",
    "https://live-concerts.example.com/dates",
    "https://alphabets.example.net/fonts/4",
    "https://sheets-and-towels.example.com/en/4",
    "https://the-thinker.example.net/es/5",
    "https://docs.example.net/guide/start",
    "https://library.example.edu/catalog/item/31",
    "http://m.example.com/en/960",
    "https://www.example.com/about",
    "https://forum.example.com/t/8812",
    "http://museum.example.net/es/533/",
    "https://recipes.example.net/fr/soup?page=2",
    "http://www.weather-report.example.com/de/204",
    "https://blog.garden-notes.example.net/en/77/",
    "https://blog.riverside.example.com/en/5",
    "http://m.city-times.example.com/fr/31.html",
    "http://anderson.example.net/es/98",
    "http://blog.thornton.example.com/de/1523/",
    "http://m.northland.example.net/de/77",
    "https://en.wikipedia.org/wiki/Main_Page",
    "https://www.python.org/doc/",
    "https://pypi.org/project/numpy/",
    "https://gitlab.com/groups/explore",
    "https://bitbucket.org/product",
    "https://developer.mozilla.org/en-US/docs/Web",
    "https://www.nytimes.com/section/science",
    "https://www.theguardian.com/international",
    "https://www.lemonde.fr/planete/",
    "https://www.zeit.de/wissen/index",
    "https://www.corriere.it/cronache/",
    "https://www.elmundo.es/deportes.html",
    "https://www.nhk.or.jp/news/",
    "https://www.abc.net.au/news/",
    "https://www.cbc.ca/news/canada",
    "https://www.irs.gov/forms-pubs",
    "https://www.noaa.gov/weather",
    "https://www.nih.gov/health-information",
    "https://ec.europa.eu/info/index_en",
    "https://www.bund.de/Content/DE/Home/home_node.html",
    "https://www.service-public.fr/particuliers",
    "https://www.parliament.uk/business/",
    "https://www.who.int/health-topics",
    "https://www.un.org/en/our-work",
    "https://www.mit.edu/research/",
    "https://www.stanford.edu/academics/",
    "https://www.ox.ac.uk/admissions",
    "https://www.ethz.ch/en/studies.html",
    "https://www.tum.de/en/studies",
    "https://www.u-tokyo.ac.jp/en/",
    "https://www.science.org/journal/science",
    "https://link.springer.com/article/10.1007",
    "https://www.sciencedirect.com/browse",
    "https://www.jstor.org/stable/2098",
    "https://www.gutenberg.org/ebooks/1342",
    "https://archive.org/details/texts",
    "https://www.imdb.com/title/tt0111161/",
    "https://www.goodreads.com/book/show/11",
    "https://www.amazon.co.jp/dp/4101",
    "https://www.ebay.co.uk/b/Books",
    "https://www.ikea.com/se/sv/cat/",
    "https://www.booking.com/city/it/rome.html",
    "https://www.linkedin.com/learning",
    "https://www.youtube.com/playlist?list=1",
    "https://vimeo.com/channels/staffpicks",
    "https://soundcloud.com/discover",
    "https://open.spotify.com/album/3",
    "https://www.instagram.com/explore/",
    "https://medium.com/topic/design",
    "https://www.quora.com/topic/History",
    "https://superuser.com/questions/tagged",
    "https://askubuntu.com/questions/1",
    "https://www.debian.org/distrib/",
    "https://www.kernel.org/doc/html/",
    "https://httpd.apache.org/docs/",
    "https://kubernetes.io/docs/home/",
    "https://www.postgresql.org/docs/",
    "https://huggingface.co/datasets",
    "https://www.kaggle.com/competitions",
    "https://news.ycombinator.com/item?id=1",
    "https://www.chess.com/lessons",
    "https://www.allrecipes.com/recipe/16354",
    "https://www.timeanddate.com/worldclock/",
    "https://www.openstreetmap.org/way/5",
    "https://www.bahn.de/angebot/international",
    "https://www.sncf-connect.com/en-en/",
    "https://www.iea.org/reports",
    "https://farmers-market.example.net/stalls/3",
    "https://www.adultliteracy.example.edu/classes",
    "https://freedom-press.example.net/essays/4",
    "https://trackandfield.example.com/results/9",
    "https://www.winter-trails.example.net/en/21",
    "https://betty-smith.example.com/poems/2",
    "https://www.pillsbury-bakers.example.com/en/7",
    "https://the-castle-inn.example.net/rooms",
    "https://www.addison.example.com/history/1",
)
BLOCKED = (
    "https://www.spam.example.com/click/9?utm_source=feed",
    "https://m.spam-links.example.info/en/5",
    "https://www.link-farm.example.com/out/31",
    "https://content-farm.xyz/page/9",
    "http://casino-bonus.example.org/win/free-spins",
    "https://www.royal-casino.eu/lobby",
    "https://casino-club.de/de/8",
    "https://www.online-casino.co.uk/en/51",
    "https://blog.vegas-casino.fr/fr/jeux",
    "https://free-casino.example.com/jackpot",
    "https://www.win-cash.com/en/4",
    "https://m.daily-win.top/spin/12",
    "https://www.best-pills.com/buy/now",
    "https://buy-pills.ru/order/33",
    "https://diet-pills.de/de/33",
    "https://www.cheap-meds.org/order/7",
    "https://cheap-viagra.net/shop",
    "https://www.cheap-loans.info/apply",
    "http://blog.adult-cams.com/live",
    "https://adult-dating.com/join/3",
    "https://www.adult-videos.xyz/fr/615",
    "https://m.live-adult.example.org/en/3",
    "https://www.xxx-video.example.com/watch/1",
    "https://hot-xxx.tv/clip/77",
    "https://x-rated.com/es/4",
    "https://www.sex-chat.com/rooms/5",
    "https://payday-loans.co.uk/apply-now",
    "https://www.fast-loans.org/en/6",
    "https://blog.seo-backlinks.com/order",
    "https://malware-download.com/crack/setup.exe",
    "https://www.crack-keys.net/serial/9",
    "https://m.warez-free.org/get/3",
    "https://www.poker-win.example.org/en/88",
    "https://poker-stars-bonus.com/es/6",
    "https://sports-bets.com/fr/19",
    "https://www.bets-bonus.org/es/7/",
    "https://bets24.example.info/en/3",
    "https://www.live-bets.es/es/9",
    "https://blog.free-bets-today.ru/en/1",
    "https://free-slots.example.com/en/402",
    "https://www.mega-slots.net/play/8",
    "https://m.free-iphone-prize.top/claim",
    "https://www.you-win-prize.example.com/claim/2",
    "https://replica-watches.cn/en/6",
    "https://cheap-replica.example.com/en/6",
    "https://www.ads-server.com/en/91",
    "https://ads-popup.com/es/70.html",
    "https://www.pop-ads.xyz/click/4",
    "https://blog.adserve-track.com/c/8",
    "https://click-track.example.com/de/8",
    "https://www.track-clicks.net/r/19",
    "https://m.email-tracker-ads.info/en/2",
    "https://www.spam-offers.example.com/en/12",
    "https://bulk-spam.ru/send/3",
    "https://get-rich-quick.biz/join",
    "https://www.crypto-doubler.org/invest",
    "https://miracle-cure.info/buy/1",
    "https://www.hot-singles.com/en/9",
    "https://www.spam-mails.com/en/6",
    "https://www.click-farm.com/fr/3",
    "https://www.cheap-tablets.com/en/8",
    "https://www.no-prescription-pills.com/de/4",
    "https://blog.adult-stories.net/fr/2",
    "https://adult-only.net/en/9",
    "https://blog.adult-diary.com/en/5",
    "https://www.sex-toys.net/shop",
    "https://www.pill-store.com/order/5",
    "https://ads-network.org/en/7",
    "https://warez-world.com/get/8",
    "https://blog.adult-tales.example.com/es/3",
    "https://www.xxx-clips.example.com/en/2",
    "https://todays-bets.com/en/4",
    "https://pills-online.com/order/2",
    "https://adult-live-show.com/en/8",
    "https://cheap-loan.org/fr/9",
    "https://slots-mania.org/play",
)
LABELLED = (*((u, 0) for u in ALLOWED), *((u, 1) for u in BLOCKED))

DIMENSIONS = 32_768
GRAMS = (3, 4)
#: The path's share beside the host's: pages of one host mostly go together.
PATH = 0.15
EPOCHS = 420
RATE = 5.0
L2 = 5e-4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there to ``?``, ``#`` or the end.

    A null url and one without ``://`` have neither: both are empty.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null: its host is the url's or a parent of it, its path starts the url's."""
    fits = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        fits = F.when(fit, F.lit(text)) if fits is None else fits.when(fit, F.lit(text))
    return fits


def buckets(text: Column, kind: str) -> Column:
    """The different hash buckets of the character n-grams of a host or path, marked with its ends."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))

    return F.array_distinct(F.concat(*map(of_size, GRAMS)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _norm(found: Column) -> Column:
    return F.sqrt(F.greatest(F.size(found), F.lit(1)))


def logit(weights: Column, host: Column, path: Column) -> Column:
    """Bias and the summed weights of the buckets of host and path, each over the root of their number; the bias stands last."""
    part = lambda found: _sum(F.transform(found, lambda b: F.get(weights, b))) / _norm(found)
    return F.get(weights, F.lit(DIMENSIONS)) + part(host) + PATH * part(path)


def trained(spark: SparkSession, labelled=LABELLED) -> list[float]:
    """Weights of a penalised logistic regression over the labelled URLs, by gradient steps.

    The weights are a sum of the rows' indicators, so the steps move one number a
    row; a row's products with all others are computed once.  All of it is one row
    of as many arrays as there are labelled URLs.
    """
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    host, path = host_and_path(F.col("url"))
    named = rows.select("i", "y", buckets(host, "host").alias("h"), buckets(path, "path").alias("p"))
    one = named.agg(F.sort_array(F.collect_list(F.struct("i", "y", "h", "p"))).alias("rows"))
    shared = lambda a, b: F.size(F.array_intersect(a, b)) / (_norm(a) * _norm(b))
    products = F.transform("rows", lambda a: F.transform("rows", lambda b: 1 + shared(a["h"], b["h"]) + PATH**2 * shared(a["p"], b["p"])))
    n = len(labelled)

    def step(moved: Column, products: Column) -> Column:
        margin = lambda own: _sum(F.zip_with(own, moved, lambda k, m: k * m))
        error = F.zip_with(products, "rows", lambda own, r: r["y"] - 1 / (1 + F.exp(-margin(own))))
        return F.zip_with(moved, error, lambda m, e: m * (1 - RATE * L2) + RATE / n * e)

    start = F.array_repeat(F.lit(0.0), n)
    # bound by a one-element array, so that the products aren't made anew for each step
    bound = F.transform(F.array(products), lambda own: F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, lambda m, _: step(m, own)))
    solved = one.select("rows", F.get(bound, F.lit(0)).alias("m"))
    each = solved.select(F.explode(F.arrays_zip("rows", "m")).alias("r")).select("r.rows.*", "r.m")
    spread = lambda found, share: F.transform(found, lambda b: F.struct(b.alias("b"), (F.col("m") * share / _norm(found)).alias("v")))
    bias = F.array(F.struct(F.lit(DIMENSIONS).alias("b"), F.col("m").alias("v")))
    parts = each.select(F.explode(F.concat(spread(F.col("h"), 1.0), spread(F.col("p"), PATH), bias)).alias("w"))
    found = dict(parts.groupBy("w.b").agg(F.sum("w.v")).collect())  # at most DIMENSIONS + 1 rows
    return [found.get(b, 0.0) for b in range(DIMENSIONS + 1)]


def judged(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the probability of block).

    The longest fitting rule decides; without one, block if the score is over a
    half.  A null or empty url has an empty host and path and is judged by them;
    repeated rows have a row each, null page_ids stay null, other columns aren't read.
    """
    weights = F.from_json(F.lit(json.dumps(trained(pages.sparkSession))), "array<double>")
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    score = 1 / (1 + F.exp(-logit(weights, buckets(F.col("host"), "host"), buckets(F.col("path"), "path"))))
    verdict = None
    for text, say in RULES:
        verdict = F.when(F.col("rule") == text, F.lit(say)) if verdict is None else verdict.when(F.col("rule") == text, F.lit(say))
    scored = ruled.withColumn("score", score)
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        verdict.otherwise(F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "score",
    )
