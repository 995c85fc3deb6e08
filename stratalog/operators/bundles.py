"""Modules of script bundles: an Arrow table function, one bundle in and a row for each of its modules out.

    bundles.register(spark)
    spark.sql("SELECT * FROM split_bundle(TABLE(SELECT path AS bundle, app, body FROM bodies))")
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes that a name and a module have at most, and those within which an arrow must follow.
LONGEST_NAME, LARGEST_MODULE = 256, 1 << 20
_CALL = b'__d("'
_NAMED = re.compile(rb'__d\("([^"]{0,%d})"' % LONGEST_NAME)
_ENTRY = re.compile(rb"[{,]([0-9]+):")
#: What a factory begins with: ``function``, parameters and an arrow within 64 bytes, or one parameter and an arrow within 32.
_FACTORY = re.compile(rb"function.|\(.{0,60}?\)=>|(?=.{4})[a-z].{0,29}?=>", re.DOTALL)

_COLUMNS = "bundle string, kind string, name string, offset long, size long"


def named_modules(body: bytes) -> Iterator[tuple[str, int, int]]:
    """Modules of ``__d("Name", ...)`` calls: name, offset of the name, bytes up to the next call."""
    at = 0
    while m := _NAMED.search(body, at):
        start, at = m.start(1), m.end(1)
        following = body.find(_CALL, at)
        end = len(body) if following < 0 else following
        yield m[1].decode("utf-8", "replace"), start, min(end - start, LARGEST_MODULE)


def numbered_modules(body: bytes, app: str) -> Iterator[tuple[str, int, int]]:
    """Modules of a map of numbers to factories: name by application and number, offset behind the colon, bytes up to the
    next entry from the colon on. An entry that is no factory is none, but ends the module before it."""
    entries = list(_ENTRY.finditer(body))
    for m, following in zip_longest(entries, entries[1:]):
        colon = m.end() - 1
        if _FACTORY.match(body, colon + 1):
            end = following.start() if following else len(body)
            yield f"{app}_module_{m[1].decode()}", colon + 1, min(end - colon, LARGEST_MODULE)


class SplitBundle:
    """Table function over rows (bundle, app, body): bundle, kind, name, offset, size (bytes) of every module.

    The state is the place within one body; bodies are taken one at a time from the batch, so a worker holds one of them and
    its modules. Null bodies have no modules.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for bundle, app, body in zip(named["bundle"], named["app"], named["body"], strict=True):
            text = body.as_py()
            if text is None:
                continue
            data = text if isinstance(text, bytes) else text.encode()
            found = [("named", *m) for m in named_modules(data)] + [("numbered", *m) for m in numbered_modules(data, app.as_py() or "")]
            if found:
                kinds, names, offsets, sizes = zip(*found, strict=True)
                yield pa.table({"bundle": pa.array([bundle.as_py()] * len(found), pa.string()), "kind": pa.array(kinds, pa.string()), "name": pa.array(names, pa.string()), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64())})


def _function():
    return F.arrow_udtf(SplitBundle, returnType=_COLUMNS)


def register(spark: SparkSession, name: str = "split_bundle") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, _function())


def split_bundles(rows: DataFrame, bundle: str, app: str, body: str) -> DataFrame:
    """bundle, kind (named, numbered), name, offset, size of the modules of every row; each partition on its own, no shuffle."""
    narrow = rows.select(F.col(bundle).cast("string").alias("bundle"), F.col(app).cast("string").alias("app"), F.col(body).alias("body"))
    return _function()(narrow.asTable())


def name_prefix(name: Column) -> Column:
    """The first two parts of a name that begins with ``WAWeb``; empty for others."""
    return F.regexp_extract(name, "^(WAWeb(?:.[^A-Z]*)?)", 1)


def module_body(body: Column, offset: Column, size: Column, most: int) -> Column:
    """The bytes of a module, ``most`` at most, of a binary body."""
    return F.substr(body, (offset + 1).cast("int"), F.least(size, F.lit(most)).cast("int"))


# Where names of recovered modules come from, by the kind of their bundle.
RECOVERED = ("webpack", "vite", "esbuild", "rollup")


def recovered_modules(spark: SparkSession, path: str) -> DataFrame:
    """Modules of recovered bundles below ``path``: bundle (folder), name, size, name_quality.

    A bundle is a folder with ``modules/**/*.js``, and a ``manifest.json`` whose ``bundle_kind`` says how names were
    recovered; without one, or with an unknown kind, they are ``raw``. Of the scripts only names and sizes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{js,JS,Js,jS}").load(path)
    place = F.col("path")
    files = files.where(place.rlike("/modules/")).select(
        F.regexp_extract(place, "^(.*?)/modules/", 1).alias("bundle"), F.regexp_extract(place, r"([^/]+)\.[jJ][sS]$", 1).alias("name"), F.col("length").alias("size")
    )
    manifests = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(path)
    kind = F.lower(F.get_json_object(F.decode("content", "UTF-8"), "$.bundle_kind"))
    quality = F.when(kind.isin(*RECOVERED), F.concat(F.lit("recovered_"), kind)).otherwise("raw")
    manifests = manifests.select(F.regexp_extract("path", "^(.*)/manifest.json$", 1).alias("bundle"), quality.alias("name_quality"))
    return files.join(manifests, "bundle", "left").withColumn("name_quality", F.coalesce("name_quality", F.lit("raw")))
