"""Entity resolution: names in claims against the names of a program, by exact, alias, fuzzy and partial match.

mentions(file_id, text, expected_type) against vocab(file_id, category, name). Each distinct mention is resolved once. The
cheap equi-joins come first; only mentions that they leave open meet the vocabulary of their own file in a similarity join
(equi-key file_id, category and band of length, score as residual), so no join runs across files.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions.names import normal
from factgrid.functions.similarity import indel_ratio, length_ratio, levenshtein_ratio

# Spoken names of special entities, candidates in order.
ALIASES = {
    "init": ("__init__",),
    "constructor": ("__init__",),
    "yapıcı": ("__init__",),
    "str": ("__str__",),
    "repr": ("__repr__",),
    "main": ("main", "__main__"),
    "ana": ("main",),
    "self": ("self",),
}
FUZZY_THRESHOLD = 75
PARTIAL_THRESHOLD = 0.6
ALIAS_CONFIDENCE = 0.95
CATEGORIES = ("function", "class", "method", "variable", "import")


def vocabulary(functions: DataFrame, classes: DataFrame, variables: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, category, name, entity_type: a name's type is that of the last category that has it."""
    kinds = (
        functions.select("file_id", F.lit("function").alias("category"), "name"),
        classes.select("file_id", F.lit("class").alias("category"), "name"),
        classes.select("file_id", F.lit("method").alias("category"), F.explode("methods").alias("name")),
        variables.select("file_id", F.lit("variable").alias("category"), "name"),
        imports.select("file_id", F.lit("import").alias("category"), F.col("module").alias("name")),
    )
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return typed(out)


def typed(names: DataFrame) -> DataFrame:
    """Distinct file_id, category, name with entity_type."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    names = names.dropDuplicates(["file_id", "category", "name"])
    types = names.groupBy("file_id", "name").agg(F.max_by("category", rank).alias("entity_type"))
    return names.join(types, ["file_id", "name"]).select("file_id", "category", "name", "entity_type")


def graph_vocabulary(nodes: DataFrame) -> DataFrame:
    """The vocabulary of a combined graph: functions, classes and variables (local ones too); other nodes have category other."""
    kind = F.when(F.col("node_type").isin("function", "class"), F.col("node_type")).when(F.col("node_type").isin("variable", "local_variable"), F.lit("variable")).otherwise(F.lit("other"))
    return nodes.where("graph = 'combined'").select("file_id", kind.alias("category"), F.col("id").alias("name"), F.col("node_type").alias("entity_type"))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, c, k) for a, names in ALIASES.items() for k, c in enumerate(names)], "alias string, candidate string, place int")


def _in_category(vocab: DataFrame) -> DataFrame:
    """vocab with `wanted`: each name under its category, and under '' for mentions of any type."""
    return vocab.select("file_id", F.explode(F.array("category", F.lit(""))).alias("wanted"), "name", "entity_type").distinct()


def _wanted() -> Column:
    return F.when(F.col("expected_type").isin(*CATEGORIES), F.col("expected_type")).otherwise(F.lit(""))


def _length_ratio(score: Callable[[Column, Column], Column], fuzzy_threshold: int, partial_threshold: float) -> float | None:
    """How much longer one of two names can be that match at all; None if the score sets no bound. A score is rounded, so half a point less may do."""
    least = fuzzy_threshold - 0.5
    bounds = {indel_ratio: 200 / least - 1, levenshtein_ratio: 100 / least} if least > 0 and partial_threshold > 0 else {}
    return max(bounds[score], 1 / partial_threshold) if score in bounds else None


def _of_like_length(open_: DataFrame, names: DataFrame, ratio: float | None) -> DataFrame:
    """Open mentions with the names of their file and category; if lengths can differ by a ratio at most, with those of the neighbouring bands of length alone."""
    if ratio is None or ratio <= 1.01:
        return open_.join(names, ["file_id", "wanted"])
    band = lambda c: F.floor(F.log(F.length(c)) / math.log(ratio)).cast("int")
    own = names.where("name_low <> ''").withColumn("band", band("name_low"))
    asked = open_.withColumn("band", F.explode(F.array(*(band("low") + k for k in (-1, 0, 1)))))
    return asked.join(own, ["file_id", "wanted", "band"]).drop("band")


def resolved(mentions: DataFrame, vocab: DataFrame, score: Callable[[Column, Column], Column] = indel_ratio, fuzzy_threshold: int = FUZZY_THRESHOLD, partial_threshold: float = PARTIAL_THRESHOLD) -> DataFrame:
    """The distinct mentions with code_entity, match_type, confidence, entity_type. Of equally good names the least one is taken."""
    spark = mentions.sparkSession
    asked = mentions.select("file_id", "text", "expected_type").distinct().withColumn("low", normal(F.col("text"))).withColumn("wanted", _wanted())
    names = _in_category(vocab).withColumn("name_low", F.lower("name"))
    key = ["file_id", "wanted", "low"]
    open_ = asked.where(F.coalesce("low", F.lit("")) != "").select(*key).distinct()

    exact = open_.join(names.withColumnRenamed("name_low", "low"), key).groupBy(*key).agg(F.min(F.struct("name", "entity_type")).alias("b"))
    found = exact.select(*key, "b.*", F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"))
    open_ = open_.join(found, key, "left_anti")

    by_alias = open_.join(F.broadcast(alias_table(spark)), F.col("low") == F.col("alias"))  # the table is fixed and tiny
    by_alias = by_alias.join(names.withColumnRenamed("name", "candidate"), ["file_id", "wanted", "candidate"])
    best = by_alias.groupBy(*key).agg(F.min(F.struct("place", "candidate", "entity_type")).alias("b"))
    found = found.unionByName(best.select(*key, F.col("b.candidate").alias("name"), "b.entity_type", F.lit("alias").alias("match_type"), F.lit(ALIAS_CONFIDENCE).alias("confidence")))
    open_ = open_.join(best, key, "left_anti")

    near = _of_like_length(open_, names, _length_ratio(score, fuzzy_threshold, partial_threshold))
    # a ratio of r needs lengths within 200 / r - 1 of each other: that is checked before any score
    shorter, longer = F.least(F.length("low"), F.length("name_low")), F.greatest(F.length("low"), F.length("name_low"))
    fuzzy = near.where(200 * shorter >= (fuzzy_threshold - 1) * (shorter + longer)) if score is indel_ratio else near
    fuzzy = fuzzy.withColumn("score", score(F.col("low"), F.col("name_low"))).where(F.col("score") >= fuzzy_threshold)
    best = fuzzy.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("worse"), "name", "entity_type")).alias("b"))
    found = found.unionByName(best.select(*key, "b.name", "b.entity_type", F.lit("fuzzy").alias("match_type"), (-F.col("b.worse") / 100.0).cast("double").alias("confidence")))

    part = near.join(best, key, "left_anti").where(F.contains("low", F.col("name_low")) | F.contains("name_low", F.col("low")))
    part = part.withColumn("ratio", length_ratio(F.col("low"), F.col("name_low"))).where(F.col("ratio") >= partial_threshold)
    best = part.groupBy(*key).agg(F.min(F.struct((-F.col("ratio")).alias("worse"), "name", "entity_type")).alias("b"))
    found = found.unionByName(best.select(*key, "b.name", "b.entity_type", F.lit("partial").alias("match_type"), (-F.col("b.worse")).alias("confidence")))

    out = asked.join(found, key, "left")
    return out.select("file_id", "text", "expected_type", F.col("name").alias("code_entity"), F.coalesce("match_type", F.lit("no_match")).alias("match_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "entity_type")


def statistics(matches: DataFrame) -> DataFrame:
    """Counts by match type over distinct mentions."""
    return matches.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


def entity_exists(mentions: DataFrame, vocab: DataFrame) -> DataFrame:
    """mentions (file_id, name) with entity_exists and entity_type."""
    own = vocab.select("file_id", "name", "entity_type").distinct()
    return mentions.join(own, ["file_id", "name"], "left").withColumn("entity_exists", F.col("entity_type").isNotNull())
