"""Metrics of verdicts: rates, coverage, coherence, grades and recommendations, for each key (a run, a user, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.operators.verify import is_hallucination, is_valid

GOOD_HALLUCINATION, BAD_HALLUCINATION = 0.1, 0.3
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.3, 0.7
# Grades and their colours, best first.
GRADES = (("MÜKEMMEL", "green"), ("İYİ", "yellow"), ("ORTA", "orange"), ("ZAYIF", "red"))
# Recommendations.
RECOMMENDATIONS = {
    "high_hallucination": "⚠️  Yüksek halüsinasyon oranı! LLM çıktılarına güvenmeyin. Daha spesifik promptlar kullanmayı deneyin.",
    "some_hallucination": "📝 Orta düzeyde halüsinasyon oranı. Kritik kararlar için LLM çıktılarını manuel doğrulayın.",
    "low_validity": "❌ Düşük geçerlilik oranı. LLM'nin kod anlayışı yetersiz. Daha basit kod yapıları veya daha güçlü model deneyin.",
    "low_coverage": "📊 Düşük kapsam. LLM kodun sadece bir kısmını analiz etti. Tüm yapıları sorgulamak için ek promptlar kullanın.",
    "bad_type": "🔍 '%s' türündeki iddialar için yüksek hata oranı. Bu tür iddiaları özellikle doğrulayın.",
    "good": "✅ LLM çıktıları genel olarak güvenilir görünüyor. Yine de kritik kararlar için manuel doğrulama önerilir.",
}


def share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def rates(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_claims, hallucination_rate, validity_rate."""
    r = F.col("result")
    return verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_claims"), share(is_hallucination(r)).alias("hallucination_rate"), share(is_valid(r)).alias("validity_rate"))


def coverage(mentioned: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_entities, mentioned_entities, coverage: mentioned and vocab have keys and name; a key without vocabulary has coverage 0 and comes from mentioned."""
    known = vocab.select(*keys, "name").distinct()
    hits = known.join(mentioned.select(*keys, "name").distinct(), [*keys, "name"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("mentioned_entities"))
    total = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_entities"))
    out = mentioned.select(*keys).distinct().join(total, keys, "full").join(hits, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(*keys, zero("total_entities").alias("total_entities"), zero("mentioned_entities").alias("mentioned_entities"), F.coalesce(F.try_divide(zero("mentioned_entities").cast("double"), F.col("total_entities")), F.lit(0.0)).alias("coverage"))


def mentioned(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the distinct code names that claims were matched to."""
    names = F.explode(F.array("subject_match.code_entity", "object_match.code_entity")).alias("name")
    return verdicts.select(*keys, names).where("name is not null").distinct()


def step_validity(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, steps, step_validity: the mean of the steps' validity, each step with the same weight."""
    steps = verdicts.groupBy(*keys, "source_step").agg(share(is_valid(F.col("result"))).alias("rate"))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.avg("rate").alias("step_validity"))


def type_breakdown(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, claim_type, total, valid, hallucination, other, validity_rate, hallucination_rate."""
    r = F.col("result")
    return verdicts.groupBy(*keys, "claim_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_valid(r)).alias("valid"), F.count_if(is_hallucination(r)).alias("hallucination"), F.count_if(~is_valid(r) & ~is_hallucination(r)).alias("other"),
        share(is_valid(r)).alias("validity_rate"), share(is_hallucination(r)).alias("hallucination_rate"),
    )


def confidence_distribution(verdicts: DataFrame, keys: list[str], confidence: str = "verdict_confidence") -> DataFrame:
    c = F.col(confidence)
    return verdicts.groupBy(*keys).agg(
        F.avg(c).alias("average"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c < LOW_CONFIDENCE).alias("low"),
        F.count_if((c >= LOW_CONFIDENCE) & (c < HIGH_CONFIDENCE)).alias("medium"), F.count_if(c >= HIGH_CONFIDENCE).alias("high"),
    )


def chain_coherence(verdicts: DataFrame, keys: list[str], order: tuple[str, ...] = ("source_step", "ord")) -> DataFrame:
    """keys, transitions, coherent, chain_coherence: the share of neighbours that are alike valid or not; 1 with fewer than two."""
    before = F.lag(is_valid(F.col("result"))).over(Window.partitionBy(*keys).orderBy(*order))
    pairs = verdicts.withColumn("_alike", before == is_valid(F.col("result")))
    out = pairs.groupBy(*keys).agg(F.count("_alike").alias("transitions"), F.count_if("_alike").alias("coherent"))
    return out.withColumn("chain_coherence", F.coalesce(F.try_divide(F.col("coherent").cast("double"), F.col("transitions")), F.lit(1.0)))


def _grade(h: Column, v: Column, values: tuple[str, ...]) -> Column:
    return F.when((h < 0.1) & (v > 0.8), values[0]).when((h < 0.2) & (v > 0.6), values[1]).when(h < 0.3, values[2]).otherwise(values[3])


def graded(summary: DataFrame) -> DataFrame:
    """summary (hallucination_rate, validity_rate) with overall_assessment and assessment_color."""
    h, v = F.col("hallucination_rate"), F.col("validity_rate")
    return summary.withColumn("overall_assessment", _grade(h, v, tuple(g for g, _ in GRADES))).withColumn("assessment_color", _grade(h, v, tuple(c for _, c in GRADES)))


def recommended(summary: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, rule, recommendation, from summary (hallucination_rate, validity_rate, coverage) and type_breakdown; one good word if no rule holds."""
    h, v, c = F.col("hallucination_rate"), F.col("validity_rate"), F.col("coverage")
    rule = lambda name, place, when: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(name).alias("rule"), F.lit("").alias("of")))
    rules = F.filter(F.array(rule("high_hallucination", 0, h > 0.3), rule("some_hallucination", 0, (h > 0.1) & (h <= 0.3)), rule("low_validity", 1, v < 0.5), rule("low_coverage", 2, c < 0.5)), lambda x: x.isNotNull())
    bad = types.where("hallucination_rate > 0.4").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.lit(3).alias("place"), F.lit("bad_type").alias("rule"), F.col("claim_type").alias("of")))).alias("_bad"))
    every = F.concat(F.col("_own"), F.coalesce(F.col("_bad"), F.array().cast("array<struct<place:int,rule:string,of:string>>")))
    good = F.array(F.struct(F.lit(4).alias("place"), F.lit("good").alias("rule"), F.lit("").alias("of")))
    out = summary.withColumn("_own", rules).join(bad, keys, "left").withColumn("_all", every)
    out = out.select(*keys, F.inline(F.when(F.size("_all") > 0, F.col("_all")).otherwise(good)))
    texts = F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])
    return out.select(*keys, "place", "rule", "of", F.replace(F.element_at(texts, F.col("rule")), F.lit("%s"), F.col("of")).alias("recommendation"))


def percentage(value: Column) -> Column:
    """One decimal, halves to even. A half is what is one as a double times ten, as for round_even in SQL; bround goes by the decimal form."""
    return F.format_string("%.1f%%", F.rint(value * 100 * 10) / 10)


def as_rows(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, name, value: a row for each metric."""
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))))


def value_of(metrics: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the value of a metric, 0 where there is none."""
    return metrics.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0)).alias(name))
