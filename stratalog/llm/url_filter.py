"""URL filter: rules on host and path, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import ascii_lower

#: Labelled URLs are trained on in full up to this number; a larger table is sampled down to it by hash.
MAX_LABELLED = 50_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and all paths that start with ``path``."""

    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no host part."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits (host and path together; then the longer host, then the smaller string), or null."""
    if not rules:
        return F.lit(None).cast("struct<order:int,host_order:int,rule:string,verdict:string>")
    fits = F.filter(
        F.array(
            *[
                F.when(
                    ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                    F.struct(
                        F.lit(-len(r.host + r.path)).alias("order"),
                        F.lit(-len(r.host)).alias("host_order"),
                        F.lit(r.host + r.path).alias("rule"),
                        F.lit(r.verdict).alias("verdict"),
                    ),
                )
                for r in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_min(fits)


def _features(urls: DataFrame, host: Column, path: Column) -> DataFrame:
    """Host and path as arrays of characters with their ends marked."""
    marked = {"host_chars": F.concat(F.lit("^"), host, F.lit("$")), "path_chars": F.concat(F.lit("^"), ascii_lower(path), F.lit("$"))}
    return urls.withColumns({k: F.filter(F.split(v, ""), lambda c: c != "") for k, v in marked.items()})


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "label", sizes: Sequence[int] = (3, 4), features: int = 1 << 14) -> PipelineModel:
    """Logistic regression on indicators of hashed character n-grams of host and path.

    ``label`` is 1 for block and 0 for allow; rows with a null url or label are left out. Training is on at most
    MAX_LABELLED rows, which is the documented bound of this model.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull())
    rows = rows.orderBy(F.xxhash64(url), url).limit(MAX_LABELLED)
    rows = _features(rows.select(F.col(label).cast("double").alias("label"), host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p")), F.col("h"), F.col("p"))
    steps, parts = [], []
    for part in ("host", "path"):
        for n in sizes:
            grams, hashed = f"{part}_grams{n}", f"{part}_tf{n}"
            steps += [NGram(n=n, inputCol=f"{part}_chars", outputCol=grams), HashingTF(numFeatures=features, binary=True, inputCol=grams, outputCol=hashed)]
            parts.append(hashed)
    steps.append(VectorAssembler(inputCols=parts, outputCol="features"))
    steps.append(LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, maxIter=30, standardization=False))
    return Pipeline(stages=steps).fit(rows)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel, url: str = "url", cut: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``block_score`` and ``verdict`` (block or allow) to every row.

    The longest fitting rule decides; without one the model blocks at a score of ``cut``. A null url, or one
    without ``://``, has empty host and path and is judged by the model on these. Columns of ``pages`` with one of
    the new names are replaced. Repeated rows are judged alike. Urls of any length are judged whole: the work grows with
    their characters, the features do not. An empty table gives an empty table.
    """
    new = ("host", "path", "rule", "block_score", "verdict")
    kept = [c for c in pages.columns if c not in new]
    packed = pages.select(F.struct(*kept).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = model.transform(_features(packed, F.col("host"), F.col("path")))
    found = scored.select(
        "row",
        "host",
        "path",
        matching_rule(F.col("host"), F.col("path"), rules).alias("found"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("block_score"),
    )
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        "block_score",
        F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") >= cut, "block").otherwise("allow")).alias("verdict"),
    )
