"""A small labelled URL table: words of the names of sites, and paths as their pages have, each with a verdict.

Hosts and paths carry the label both: a share of the rows pairs a telling host with a plain path or the other way round,
so that the model must learn from each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names whose pages are kept out of a training corpus, and names of ordinary sites.
BLOCKED = """casino-bonus free-casino online-poker sports-bets payday-loans fast-loans replica-watches discount-viagra
pills-online adult-cams xxx-videos porn-tube sexy-chat hot-singles link-farm seo-links buy-links click-bait
free-download-crack warez-keygen torrent-crack win-prizes lottery-winner bitcoin-doubler get-rich-quick
work-from-home-cash cheap-tickets-deal coupon-spam essay-mill buy-followers miracle-diet weight-loss-pills penny-stocks
forex-signals adult-dating escort-girls phishing-login free-gift-cards spam-links cheap-meds pill-store""".split()
ALLOWED = """news weather library museum university school science history gardening recipes cooking travel
maps music theatre cinema football athletics health hospital council parliament court archive dictionary
encyclopedia journal review blog notes docs manual tutorial forum community photos nature birds physics
mathematics chemistry software engineering geography astronomy literature poetry language translation
weather-station city-council open-data home-garden daily-news local-history farm-shop chess-club""".split()
# Paths by verdict; # stands for a number. The last list occurs with both.
BLOCKED_PATHS = """/win/bonus/# /aff/click/#/go /out?to=# /buy-now/#/checkout.php /cheap/#/order /xxx/gallery/# /free-spins-# /track/#/r
/promo/code-#/win.html /download/crack/#.exe /redirect/#/offer /hot/#/live /loan/apply/# /pills/order-#""".split()
ALLOWED_PATHS = """/articles/2021/0#/title.html /docs/guide/chapter-#.html /wiki/Topic_# /research/paper-#.pdf /about/history/#
/lessons/#/notes /news/local/#.html /recipes/soup-# /archive/199#/index.html /events/calendar/# /help/faq.html /api/v#/reference""".split()
PLAIN_PATHS = """/ /en/# /de/#.html /fr/#/ /es/# /index.html /p/# /a/b/c/d/#""".split()
# What stands before and behind a name.
BEFORE = ("", "www.", "blog.", "m.", "cdn2.")
BEHIND = (".example.com", ".example.org", ".example.net", ".example.co.uk", ".example.io:8080", "77.example.info", ".shop.example.de")


def labelled_urls(spark: SparkSession, forms: int = 8) -> DataFrame:
    """url, label (1 block, 0 allow), held_out: each name under ``forms`` domains with a path each.

    Of eight rows of a name four have a path of their label and four a plain one. Every fifth name is held out.
    """
    rows = ", ".join(f"('{w}', {label}, {n % 5 == 0})" for label, words in ((1, BLOCKED), (0, ALLOWED)) for n, w in enumerate(words))
    names = spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, label, held_out)")
    pick = lambda values, salt: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(F.lit(salt), "name", "form"), F.lit(len(values))).cast("int"))
    number = F.pmod(F.xxhash64(F.lit("number"), "name", "form"), F.lit(900)).cast("string")
    own = F.when(F.col("label") == 1, pick(BLOCKED_PATHS, "path")).otherwise(pick(ALLOWED_PATHS, "path"))
    path: Column = F.replace(F.when(F.col("form") % 2 == 0, own).otherwise(pick(PLAIN_PATHS, "path")), F.lit("#"), number)
    # A plain host with a telling path: every fourth form.
    name = F.when(F.col("form") % 4 == 0, F.concat(F.lit("site"), number)).otherwise(F.col("name"))
    each = names.withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(forms - 1))))
    url = F.concat(F.when(F.col("form") % 3 == 0, "http://").otherwise("https://"), pick(BEFORE, "before"), name, pick(BEHIND, "behind"), path)
    return each.select(url.alias("url"), F.col("label").cast("int").alias("label"), "held_out")
