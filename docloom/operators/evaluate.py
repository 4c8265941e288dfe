"""Evaluation of runs: passing, tri-state ratios, comparison with baselines.

A null boolean is an observation that was not made; it is never read as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def passed(tier: int) -> Column:
    """Whether a question is in a good state at a tier."""
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    if tier < 1:
        return ~F.col("answerable") | ok("retrieval_hit")
    if tier < 2:
        return ~F.col("answerable") | ok("rerank_hit")
    return F.when(F.col("answerable"), ok("rerank_hit") & ok("sufficient")).otherwise(~F.coalesce(F.col("sufficient"), F.lit(True)))


def outcome_flags(results: DataFrame) -> DataFrame:
    """refusal_correct (null if unobserved), false_refusal, false_answer and wrong_authority."""
    said = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return results.withColumns({
        "refusal_correct": F.col("sufficient") == F.col("answerable"),
        "false_refusal": F.col("answerable") & said("sufficient", False),
        "false_answer": ~F.col("answerable") & said("sufficient", True),
        "wrong_authority": F.col("answerable") & said("sufficient", True) & said("cited_expected", False),
    })


def hits(retrieved: Column, expected: Column) -> Column:
    return F.arrays_overlap(retrieved, expected)


def first_rank(ranked: Column, expected: Column) -> Column:
    """The first place (from 1) of an expected id, or null."""
    at = F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    return F.array_min(at)


def suite_metrics(results: DataFrame, tier: int = 2, by: str = "suite") -> DataFrame:
    """Counts and observed ratios of each suite: never across suites."""
    r = outcome_flags(results).withColumn("ok", passed(tier))
    ratio = lambda c: [F.count_if(F.col("answerable") & F.col(c)).alias(f"{c}_passed"), F.count(F.when(F.col("answerable"), F.col(c))).alias(f"{c}_total")]
    out = [
        F.count("*").alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("out_of_scope"), F.count_if("ok").alias("passed"),
        *ratio("retrieval_hit"), *ratio("rerank_hit"), *ratio("rerank_top1"),
    ]
    if tier >= 2:
        out += [
            F.count_if("refusal_correct").alias("refusal_correct_passed"), F.count("refusal_correct").alias("refusal_correct_total"), F.count_if("false_refusal").alias("false_refusal"), F.count_if("false_answer").alias("false_answer"),
            F.count_if("wrong_authority").alias("wrong_authority"), F.sum("ungrounded").alias("ungrounded_claims"), F.count_if(F.col("ungrounded") > 0).alias("answers_with_ungrounded"),
            F.count_if(F.col("refused_by_grounding") & F.col("answerable")).alias("grounding_refused_answerable"), F.count_if(F.col("refused_by_grounding") & ~F.col("answerable")).alias("grounding_refused_out_of_scope"),
            F.count_if("answer_quality").alias("answer_quality_passed"), F.count("answer_quality").alias("answer_quality_total"), F.count_if(F.col("sufficient") & F.col("answer_quality").isNull()).alias("not_judged"),
        ]
    return r.groupBy(by).agg(*out)


def rollup_suites(results: DataFrame, tier: int = 1, by: str = "suite") -> DataFrame:
    """Questions and passes by suite, with one row over all (suite null) for old readers only."""
    return results.withColumn("ok", passed(tier)).rollup(by).agg(F.count("*").alias("questions"), F.count_if("ok").alias("passed"), F.grouping(by).cast("int").alias("overall"))


def defect_histogram(results: DataFrame) -> DataFrame:
    """Defects of judged answers that failed, the most frequent first."""
    bad = results.where(F.col("answer_quality").isNotNull() & ~F.col("answer_quality") & F.col("judge_defect").isNotNull())
    return bad.groupBy("judge_defect").agg(F.count("*").alias("n")).withColumn("rk", F.row_number().over(Window.orderBy(F.col("n").desc(), "judge_defect")))


def compare_runs(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, change) of (id, suite, ok): regressed, improved, new or removed; unchanged ones are left out.

    Baseline questions of suites that did not run are not removed ones.
    """
    ran = current.select("suite").distinct()
    base = baseline.join(ran, "suite", "left_semi").select("id", F.col("ok").alias("was"))
    both = current.select("id", F.col("ok").alias("now")).join(base, "id", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was") & F.col("now"), "improved")
    return both.select("id", change.alias("change")).where("change is not null")


def metric_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(suite, metric, before, after, delta) in percent of (suite, metric, passed, total); metrics nobody observed are left out."""
    b = baseline.select("suite", "metric", F.expr("try_divide(100.0D * passed, total)").alias("before"))
    a = current.where("total > 0").select("suite", "metric", F.expr("try_divide(100.0D * passed, total)").alias("after"))
    return a.join(b, ["suite", "metric"]).where("before is not null").select("suite", "metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def promotion_refusal() -> Column:
    """Why a run may not become a baseline, the first reason that holds, or null.

    Columns: has_scope, tier, selected_ids, one_document, reranked, rewrite,
    pipeline_rewrite, rerank_rewrites, cache_hits.
    """
    return (
        F.when(~F.col("has_scope") | F.col("tier").isNull(), "no scope recorded")
        .when(F.col("selected_ids"), "selected questions only")
        .when(F.col("one_document"), "one document only")
        .when(~F.coalesce(F.col("reranked"), F.lit(True)), "reranking was off")
        .when(F.coalesce("rewrite", F.lit(False)) != F.coalesce("pipeline_rewrite", F.lit(False)), "rewriting differs from the pipeline")
        .when(F.coalesce("rewrite", F.lit(False)) & (F.col("tier") >= 1) & ~F.coalesce("rerank_rewrites", F.lit(False)), "reranker did not read the rewrites")
        .when(F.col("cache_hits") > 0, "cached results")
    )


def incomparable_reasons() -> Column:
    """Why a run's difference to its baseline (b_* columns) is no plain regression, as a list of names.

    The two models and the collection count where both sides name them, and so
    does the tier. ``reranked`` counts where this run had it off, whatever the
    baseline had. Rewriting and the reranker's reading of it count as booleans,
    an absent one as false.
    """
    named = lambda c: F.when((F.coalesce(F.col(c), F.lit("")) != "") & (F.coalesce(F.col(f"b_{c}"), F.lit("")) != "") & (F.col(c) != F.col(f"b_{c}")), c)
    switched = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)) != F.coalesce(F.col(f"b_{c}"), F.lit(False)), c)
    found = [*map(named, ("embedding_model", "reranker_model", "collection")), F.when(F.col("tier") != F.col("b_tier"), "tier"), F.when(~F.col("reranked"), "reranked"), *map(switched, ("rewrite", "rerank_rewrites"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def verdict_error() -> Column:
    """A verdict's error: its own, or that its findings are not as many as the claims it was given (``n_claims``)."""
    n = F.coalesce(F.size("findings"), F.lit(0))
    counted = F.concat(F.lit("checked "), n.cast("string"), F.lit(" of "), F.col("n_claims").cast("string"), F.lit(" claims"))
    return F.coalesce(F.col("error"), F.when((F.col("n_claims") > 0) & (n != F.col("n_claims")), counted))


def quality() -> Column:
    """A verdict's quality: null on errors or unread verdicts; else responsive, without defect, all claims stated."""
    return F.when(F.col("error").isNotNull() | F.col("responsive").isNull(), F.lit(None).cast("boolean")).otherwise(
        F.col("responsive") & F.coalesce(F.col("defect") == "none", F.lit(False)) & F.forall("findings", lambda x: F.coalesce(x == "stated", F.lit(False))))


def headline() -> Column:
    """The defect to show: null on errors, an answer's own before the first failing claim's, "none" for a sound answer."""
    bad = F.filter("findings", lambda x: F.coalesce(x != "stated", F.lit(True)))
    flaw = F.when(F.coalesce(F.col("defect"), F.lit("none")) != "none", F.col("defect"))
    return F.when(F.col("error").isNotNull(), F.lit(None).cast("string")).when(flaw.isNotNull(), flaw).when(~F.col("responsive"), "unresponsive").when(F.size(bad) > 0, F.try_element_at(bad, F.lit(1))).otherwise("none")


def agreement(checks: DataFrame, by: str = "case") -> DataFrame:
    """(case, agreed, checks) of (case, expected, found); claims without an expectation are not scored, a null finding never agrees."""
    return checks.where(F.col("expected").isNotNull()).groupBy(by).agg(F.count_if(F.coalesce(F.col("expected") == F.col("found"), F.lit(False))).alias("agreed"), F.count("*").alias("checks"))


def missing_expected(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, expected) that the corpus lacks; ``questions(id, expect_any_of)``, ``corpus(chunk_id)``. An empty corpus has nothing to check against."""
    some = corpus.select(F.lit(True).alias("some")).limit(1)
    lacking = questions.select("id", F.explode("expect_any_of").alias("expected")).join(corpus, F.col("expected") == F.col("chunk_id"), "left_anti")
    return lacking.join(F.broadcast(some)).drop("some")  # one row at most


def of_document(questions: DataFrame, document: str) -> DataFrame:
    """Questions that expect a chunk of any version of ``document``."""
    return questions.where(F.exists("expect_any_of", lambda x: F.startswith(x, F.lit(f"{document}@"))))


def question_errors(questions: DataFrame) -> DataFrame:
    """(id, problem) of ``questions(id, question, answerable, expect_any_of)``; an empty set is one row with a null id."""
    listed = F.coalesce(F.size("expect_any_of"), F.lit(0)) > 0
    found = F.array(
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no text"), F.when(F.col("answerable") & ~listed, "nothing expected"), F.when(~F.col("answerable") & listed, "expected out of scope"))
    each = questions.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
    repeated = questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    kind = questions.schema["id"].dataType
    empty = questions.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(kind).alias("id"), F.lit("no questions").alias("problem"))
    return each.unionByName(repeated).unionByName(empty)


def decide_intent(inputs: DataFrame, centroids: DataFrame | None, default: str, margin: float = 0.05) -> DataFrame:
    """(id, intent, by) of ``inputs(id, text, v)``: a known phrase decides first, then the centroids, else ``default``.

    ``by`` is exact, centroid or default. Without centroids (an encoder that
    failed), and for inputs without a vector, what no phrase decides goes to
    ``default``; so does an empty text.
    """
    from docloom.functions.text import exact_intent

    known = inputs.withColumn("exact", exact_intent(F.coalesce("text", F.lit(""))))
    if centroids is None:
        return known.select("id", F.coalesce("exact", F.lit(default)).alias("intent"), F.when(F.col("exact").isNotNull(), "exact").otherwise("default").alias("by"))
    said = known.where("exact is not null").select("id", F.col("exact").alias("intent"), F.lit("exact").alias("by"))
    other = known.where("exact is null")
    near = classify_by_centroid(other.where("v is not null and size(v) > 0").select("id", "v"), centroids, default, margin)
    far = other.where("v is null or size(v) = 0").select("id", F.lit(default).alias("intent"), F.lit("default").alias("by"))
    return said.unionByName(near.select("id", "intent", F.lit("centroid").alias("by"))).unionByName(far)


def intent_report(rows: DataFrame, default) -> DataFrame:
    """One row over ``rows(expected, got, margin)``: how routing went, and the margins on both sides.

    ``dangerous`` rows should have gone to ``default`` and did not, ``costly``
    ones went there for nothing, ``cosmetic`` ones are on the right side.
    """
    to, went = F.col("expected") == F.lit(default), F.col("got") == F.lit(default)
    wrong, side = F.col("expected") != F.col("got"), lambda f, c, n: f(F.when(c, F.col("margin"))).alias(n)
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(~wrong).alias("exact"), F.count_if(to == went).alias("routed"), F.count_if(wrong & to).alias("dangerous"), F.count_if(wrong & ~to & went).alias("costly"), F.count_if(wrong & ~to & ~went).alias("cosmetic"),
        side(F.min, ~to, "other_min"), side(F.max, ~to, "other_max"), side(F.min, to, "default_min"), side(F.max, to, "default_max"),
    )


def case_checks(cases: DataFrame) -> DataFrame:
    """(case, pos, agreed) of ``cases(case, expect_quality, judged, expects, findings)``: the answer (pos 0), then each claim with an expectation.

    A claim expected ``flagged`` agrees with any finding but ``stated``, one
    expected ``sound`` with ``stated``; what was not judged never agrees.
    """
    answer = cases.select("case", F.lit(0).alias("pos"), F.col("judged").eqNullSafe(F.col("expect_quality")).alias("agreed"))
    claims = cases.select("case", "findings", F.posexplode("expects").alias("at", "expect")).where(F.col("expect").isin("flagged", "sound"))
    finding = F.try_element_at("findings", F.col("at") + 1)
    agreed = F.coalesce((finding != "stated") == (F.col("expect") == "flagged"), F.lit(False))
    return answer.unionByName(claims.select("case", (F.col("at") + 1).alias("pos"), agreed.alias("agreed")))


def review_sample(rows: DataFrame, limit: int, by: str = "id") -> DataFrame:
    """Failures first, at most half of ``limit`` (one at least), filled with passes; ``rows`` has ok.

    The first ``limit`` of each kind are cut where they lie, so the ranking sees twice ``limit`` rows.
    """
    fails, passes = rows.where("not ok").orderBy(by).limit(max(1, limit // 2)), rows.where("ok").orderBy(by).limit(limit)
    rank = F.row_number().over(Window.orderBy("ok", by))
    return fails.unionByName(passes).withColumn("rank_", rank).where(F.col("rank_") <= limit).drop("rank_")


def label_suites(suites: dict[str, DataFrame]) -> DataFrame:
    """One table of several question sets, each row with the name of its set (``suite``)."""
    out = None
    for name, rows in suites.items():
        own = rows.withColumn("suite", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def tag_suites(results: DataFrame, questions: DataFrame, default: str = "statutory") -> DataFrame:
    """``results(id, ...)`` with the suite of their question (of several, the first by name); those of none are ``default``'s."""
    return results.join(questions.groupBy("id").agg(F.min("suite").alias("suite")), "id", "left").withColumn("suite", F.coalesce("suite", F.lit(default)))


def of_suite(results: DataFrame, suite: str) -> DataFrame:
    """One suite's share of a run, in the shape of a whole run."""
    return results.where(F.col("suite") == suite)


def pick_questions(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The questions that ``wanted(id)`` names; an id that no question has is an error."""
    known = wanted.select(F.col("id").alias("want")).distinct().join(questions.select("id", F.lit(True).alias("known")).distinct(), F.col("want") == F.col("id"), "left").select("want", "known")
    sure = known.select(F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown question id "), F.col("want").cast("string")))).otherwise(F.col("want")).alias("want"))
    return questions.join(sure, F.col("id") == F.col("want"), "left_semi")


def latest_runs(runs: DataFrame, by: tuple[str, ...] = ("suite", "tier"), order: str = "at") -> DataFrame:
    """The last run of each suite and tier; equal times go to the larger run id. A row a group is partly reduced before the shuffle."""
    newest = F.max_by(F.struct(*[F.col(c) for c in runs.columns]), F.struct(order, "run"))
    return runs.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(newest.alias("r")).select("r.*")


def replace_baselines(stored: DataFrame, runs: DataFrame, by: tuple[str, ...] = ("suite", "tier")) -> DataFrame:
    """``stored`` baselines, replaced by the promoted ones of ``runs``: those without a ``refusal``, the last of each suite and tier."""
    new = latest_runs(runs.where("refusal is null"), by).select(*stored.columns)
    return stored.join(new.select(*by), list(by), "left_anti").select(*stored.columns).unionByName(new)


#: Classes that are broadcast, at most.
CLASSES = 1024


def classify_by_centroid(vectors: DataFrame, centroids: DataFrame, default: str, margin: float = 0.05) -> DataFrame:
    """(id, intent, margin_): the nearest class unless ``default`` comes within ``margin``; ``centroids(intent, c)`` are a few unit vectors.

    The centroid table has a row a class, so it is gathered into one row and
    broadcast; more than ``CLASSES`` rows are an error. Ties go to the class first by name.
    """
    from docloom.functions.vectors import dot, l2_normalise, norm

    few = centroids.limit(CLASSES + 1).agg(F.array_sort(F.collect_list(F.struct("intent", "c"))).alias("all"))
    gathered = few.select(F.when(F.size("all") <= CLASSES, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {CLASSES} classes"))).alias("all"))
    # The norm is a column of its own: inside the lambda it would be summed anew for each component.
    scored = vectors.withColumn("n_", norm(F.col("v"))).join(F.broadcast(gathered)).withColumn("u", l2_normalise(F.col("v"), F.col("n_")))
    scored = scored.withColumn("s", F.transform("all", lambda x: F.struct(F.round(dot(F.col("u"), x["c"]), 6).alias("sim"), x["intent"].alias("intent"))))
    other = F.filter("s", lambda x: x["intent"] != default)
    best = F.array_max(F.transform(other, lambda x: x["sim"]))
    name = F.element_at(F.filter(other, lambda x: x["sim"] == best), 1)["intent"]
    base = F.element_at(F.filter("s", lambda x: x["intent"] == default), 1)["sim"]
    gap = F.round(best - base, 6)
    return scored.select("id", F.when(gap < margin, F.lit(default)).otherwise(name).alias("intent"), gap.alias("margin_"))


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, c): the mean vector of each class at unit length; components meet in partly summed averages."""
    from docloom.functions.vectors import l2_normalise, norm

    parts = vectors.select(by, F.posexplode("v").alias("p", "x")).groupBy(by, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("c"))
    return mean.withColumn("n_", norm(F.col("c"))).withColumn("c", l2_normalise(F.col("c"), F.col("n_"))).drop("n_")
