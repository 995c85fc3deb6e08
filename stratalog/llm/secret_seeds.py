"""Labelled samples of strings: random ones as keys and tokens are, and names, numbers and words as code and prose have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that names are put together from, of code and of four languages.
WORDS = """user name account order item price list table index value count total state event handler request response
client server config option file path folder image button window layer service manager factory builder parser reader
writer buffer stream queue worker thread session message content header footer section page view model controller
module package version update create delete remove insert select filter search result error warning default internal
external public private static function method class object string number date time format convert validate
the and there another information international development understanding responsibility government environment
nicht eine wird werden zwischen gesellschaft entwicklung verwaltung geschichte wissenschaft schrift keit lich heit ung
dans pour avec nous gouvernement administration environnement connaissance naissance ment elle tion eaux
para como desde entre gobierno desarrollo conocimiento universidad mente cion aciones todos""".split()


def labelled_strings(spark: SparkSession, each: int = 900) -> DataFrame:
    """text, label (1 random, 0 ordinary), held_out: ``each`` strings of every form.

    Random: base 64, hexadecimal in either case, base 32 and letters with digits, 16 to 64 characters, made of hashes.
    Ordinary: two to five words as code writes names, as paths, or run together, and numbers, dates and rules.
    Every fifth number is held out, and so are the names of every fifth word.
    """
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "form"), F.lit(n)).cast("int")
    rows = spark.range(each).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(11))))
    digest = F.concat(*[F.sha2(F.concat(F.lit(f"{k}-"), F.col("id").cast("string"), F.lit("-"), F.col("form").cast("string")), 256) for k in range(2)])
    size = number("size", 49) + 16
    dense = F.base64(F.unhex(digest))
    random = (
        F.when(F.col("form") == 0, digest)
        .when(F.col("form") == 1, F.upper(digest))
        .when(F.col("form") == 2, dense)
        .when(F.col("form") == 3, F.translate(dense, "+/", "-_"))
        .when(F.col("form") == 4, F.translate(dense, "+/=", ""))
        .otherwise(F.translate(F.upper(dense), "0189+/=", ""))
    )
    word = lambda k: F.get(F.array(*[F.lit(w) for w in WORDS]), F.when(F.lit(k == 0), F.col("id") % len(WORDS)).otherwise(number(f"word{k}", len(WORDS))).cast("int"))
    words = F.slice(F.array(*[word(k) for k in range(5)]), 1, number("words", 4) + 2)
    capital = F.transform(words, lambda w: F.initcap(w))
    digits = F.substring(F.concat(*[F.conv(F.substring(digest, 12 * k + 1, 12), 16, 10) for k in range(3)]), 1, 10)
    long_number = F.substring(F.concat(digits, F.reverse(digits), digits), 1, 16)
    ordinary = (
        F.when(F.col("form") == 6, F.array_join(words, "_"))
        .when(F.col("form") == 7, F.concat(F.get(words, F.lit(0)), F.array_join(F.slice(capital, 2, 9), "")))
        .when(F.col("form") == 8, F.concat(F.when(F.col("id") % 2 == 0, F.array_join(words, "-")).otherwise(F.array_join(words, "/")), F.when(F.col("id") % 3 == 0, number("n", 100).cast("string")).otherwise("")))
        .when(F.col("form") == 9, F.when(F.col("id") % 2 == 0, F.upper(F.array_join(words, "_"))).otherwise(F.array_join(words, "")))
        .when(F.col("form") == 10, F.when(F.col("id") % 2 == 0, long_number).otherwise(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))))
        .otherwise(F.when(F.col("id") % 2 == 0, F.repeat(F.substring(F.lit("-=_+/"), 1 + number("rule", 5), F.lit(1)), size)).otherwise(F.array_join(capital, "")))
    )
    text: Column = F.when(F.col("form") < 6, F.substring(random, F.lit(1), size)).otherwise(ordinary)
    held = F.when(F.col("form").between(6, 9), F.col("id") % len(WORDS) % 5 == 0).otherwise(F.col("id") % 5 == 0)
    return rows.select(text.alias("text"), (F.col("form") < 6).cast("int").alias("label"), held.alias("held_out"))
