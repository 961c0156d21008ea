"""Evidence appraisal: votes to grades, grades to statements' confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("Very low", "Low", "Moderate", "High")


def level_index(level: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0)).cast("int") - 1


def level_name(i: Column) -> Column:
    return F.when(i.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (i + 1).cast("int")))


NOT_APPRAISABLE = "Not appraisable"
#: A design may start above Moderate only if these questions are answered so.
START_NEEDS = {"systematic-review": {"q6": ("yes",), "q7": ("yes", "partly")}}


def grade(answers: DataFrame) -> DataFrame:
    """(paper, profile, grade) of answers (paper, profile, design, start, question, dim, critical, answer), a row for each question of the
    profile; answer: yes, partly, not found, or null and can't tell. critical belongs to the dimension.

    Over half can't tell: not appraisable. Else the design's start level, Moderate at most where START_NEEDS aren't met. A critical dimension
    is unmet without a yes or partly and with a not found: one caps at Low, more at Very low. Each critical dimension of nothing but
    can't tell lowers by one, and so do two or more not found elsewhere; never below the lowest."""
    a = F.coalesce("answer", F.lit("can't tell"))
    needs = F.lit(True)
    for design, questions in START_NEEDS.items():
        met = [F.coalesce(F.bool_or((F.col("question") == q) & a.isin(*ok)), F.lit(False)) for q, ok in questions.items()]
        for m in met:
            needs = needs & ((F.coalesce(F.max("design"), F.lit("")) != design) | m)
    dims = answers.groupBy("paper", "profile", "dim").agg(
        F.max(F.coalesce("critical", F.lit(False))).alias("critical"), F.count("*").alias("n"), F.count_if(a == "can't tell").alias("open"), F.count_if(a.isin("yes", "partly")).alias("met"), F.count_if(a == "not found").alias("lost"),
    )
    counts = dims.groupBy("paper", "profile").agg(
        F.sum("n").alias("n"), F.sum("open").alias("open"),
        F.count_if(F.col("critical") & (F.col("met") == 0) & (F.col("lost") > 0)).alias("unmet"), F.count_if(F.col("critical") & (F.col("open") == F.col("n"))).alias("unclear"),
        F.sum(F.when(~F.col("critical"), F.col("lost")).otherwise(0)).alias("missing"),
    )
    starts = answers.groupBy("paper", "profile").agg(F.max("start").alias("start"), needs.alias("shown"))
    first = level_index(F.col("start"))
    first = F.when(F.col("shown"), first).otherwise(F.least(first, F.lit(2)))
    cap = F.when(F.col("unmet") >= 2, 0).when(F.col("unmet") == 1, 1).otherwise(3)
    i = F.greatest(F.lit(0), F.least(first, cap) - F.col("unclear") - F.when(F.col("missing") >= 2, 1).otherwise(0))
    none = (2 * F.col("open") > F.col("n")) | F.col("start").isNull()
    return counts.join(starts, ["paper", "profile"]).select("paper", "profile", F.when(none, NOT_APPRAISABLE).otherwise(level_name(i)).alias("grade"))


def weaker(grades: DataFrame) -> DataFrame:
    """(paper, grade): of a paper's strands the weaker one stands; those not appraisable count only if there is no other."""
    return grades.groupBy("paper").agg(F.coalesce(level_name(F.min(level_index(F.col("grade")))), F.lit(NOT_APPRAISABLE)).alias("grade"))


#: Origins that only pass something on.
RELAYED = ("reported", "background")
#: Evidence and agreement to confidence.
CONFIDENCE = {"limited": ("very low", "low", "medium"), "medium": ("low", "medium", "high"), "robust": ("medium", "high", "very high")}


def confidence(evidence: DataFrame) -> DataFrame:
    """(statement, studies, papers, evidence, agreement, confidence) of evidence (statement, paper, lead, verdict, gap, origin, grade, runs),
    a row for each cited passage; runs: the verdicts of several runs, where there are such.

    Independent studies are lead authors (a paper of its own without a lead) of passages that support, fully or partly, and aren't relayed;
    each has its best grade. robust: three or more, two of them Moderate or better; medium: two, or one High; else limited. Agreement is low
    if a passage doesn't support or over half only partly do; medium if any is partly or has a gap, or with one study alone; else high.
    Without any verdict: runs disagreed, or not checked; with none but "does not support": not supported by its passages."""
    backs = F.coalesce(F.col("verdict").isin("supports", "partly") & F.col("origin").isNotNull() & ~F.col("origin").isin(*RELAYED), F.lit(False))
    leads = evidence.where(backs).groupBy("statement", F.coalesce(F.nullif("lead", F.lit("")), F.col("paper").cast("string")).alias("who")).agg(F.max(level_index(F.col("grade"))).alias("best"))
    studies = leads.groupBy("statement").agg(F.count("*").alias("studies"), F.count_if(F.col("best") >= 2).alias("good"), F.count_if(F.col("best") == 3).alias("high"))
    verdict = F.col("verdict")
    split = F.size(F.array_distinct(F.filter("runs", lambda v: v.isNotNull()))) > 1
    rows = evidence.groupBy("statement").agg(
        F.count("verdict").alias("checked"), F.count_if(verdict == "partly").alias("partly"), F.count_if(verdict == "does not support").alias("against"),
        F.count_if(F.coalesce("gap", F.lit("none")) != "none").alias("gaps"), F.coalesce(F.bool_or(split), F.lit(False)).alias("split"), F.countDistinct(F.when(backs, F.col("paper"))).alias("papers"),
    )
    joined = rows.join(studies, "statement", "left").na.fill(0, ["studies", "good", "high"])
    ev = F.when((F.col("studies") >= 3) & (F.col("good") >= 2), "robust").when((F.col("studies") >= 2) | ((F.col("studies") == 1) & (F.col("high") == 1)), "medium").otherwise("limited")
    ag = F.when((F.col("against") > 0) | (2 * F.col("partly") > F.col("checked")), "low").when((F.col("partly") > 0) | (F.col("gaps") > 0) | (F.col("studies") < 2), "medium").otherwise("high")
    real = (F.col("checked") > 0) & (F.col("against") < F.col("checked"))
    joined = joined.withColumns({"evidence": F.when(real, ev), "agreement": F.when(real, ag)})
    rank = F.when(F.col("agreement") == "low", 1).when(F.col("agreement") == "medium", 2).otherwise(3)
    label = F.when(F.col("checked") == 0, F.when(F.col("split"), "runs disagreed").otherwise("not checked")).when(~real, "not supported by its passages")
    for name, labels in CONFIDENCE.items():
        label = label.when(F.col("evidence") == name, F.element_at(F.array(*[F.lit(x) for x in labels]), rank))
    counted = lambda c: F.when(real, F.col(c)).otherwise(0).alias(c)
    return joined.select("statement", counted("studies"), counted("papers"), "evidence", "agreement", label.alias("confidence"))


def plain(evidence: DataFrame) -> DataFrame:
    """(statement, papers, studies, same_lead, relayed_only, countries): the fields that a reader sees."""
    return evidence.groupBy("statement").agg(
        F.countDistinct("paper").alias("papers"), F.countDistinct("lead").alias("studies"),
        (F.countDistinct("lead") < F.countDistinct("paper")).alias("same_lead"), F.bool_and(F.coalesce("relayed", F.lit(True))).alias("relayed_only"),
        F.array_join(F.array_sort(F.collect_set("country")), ";").alias("countries"),
    )


def recency(year: Column, month: Column, now_year: int, now_month: int, months: int = 24) -> Column:
    return (now_year - year) * 12 + (now_month - month) < months


def citation_tier(cited: Column, rank: Column, n: Column, recent: Column) -> Column:
    """too recent, the most cited one, the first ten, the upper or the lower half."""
    return F.when(recent, F.lit("too recent")).when(cited.isNull(), "unknown").when(rank == 1, "top 1").when(rank <= 10, "top 10").when(2 * rank <= n, "upper half").otherwise("lower half")
