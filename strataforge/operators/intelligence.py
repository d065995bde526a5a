"""Scores of repositories: complexity, risk exposure, health, critical components, story."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.synthesis import criticality
from strataforge.rules import (
    CONCERN, DESCRIBED_PATTERN, DESCRIPTIONS, EXPOSURE_SCALE, FRAMEWORK_CATEGORIES, HEALTH_RATINGS, HEALTH_WEIGHTS, LINTERS, PROJECT_TYPES, SEVERITY_WEIGHTS, STORY, TEST_FRAMEWORKS,
)


def rounded(x: Column, scale: int = 1) -> Column:
    """Half up at 1/scale."""
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def complexity_profile(entities: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """One row per group; one aggregation that folds map-side."""
    c = F.col("complexity")
    into, out = F.size("depended_on_by"), F.size("depends_on")
    instability = F.when(into + out > 0, out / (into + out)).otherwise(0.0)
    return entities.groupBy(*keys).agg(
        rounded(F.avg(c), 100).alias("average_complexity"), F.max(c).alias("max_complexity"), F.min_by("path", F.struct(-c, "path")).alias("most_complex"),
        F.count_if(c <= 5).alias("low"), F.count_if((c > 5) & (c <= 15)).alias("medium"), F.count_if((c > 15) & (c <= 30)).alias("high"), F.count_if(c > 30).alias("critical"),
        rounded(F.count_if(c > 15) / F.count(F.lit(1)) * 100, 10).alias("complex_percentage"), rounded(F.avg(into), 100).alias("afferent"), rounded(F.avg(out), 100).alias("efferent"),
        rounded(F.avg(instability), 100).alias("instability"),
    )


def weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv]), severity)


def risk_exposure(risks: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., exposure): 100 (1 - exp(-sum of weight x distinct affected / 25)), rounded."""
    each = weight(F.col("severity")) * F.greatest(F.lit(1), F.size(F.array_distinct("affected")))
    return risks.groupBy(*keys).agg(F.floor(100 * (1 - F.exp(-F.sum(each) / EXPOSURE_SCALE)) + 0.5).cast("int").alias("exposure"))


def risk_assessment(risks: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    each = weight(F.col("severity")) * F.greatest(F.lit(1), F.size(F.array_distinct("affected")))
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return risks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *map(of, SEVERITY_WEIGHTS), F.floor(100 * (1 - F.exp(-F.sum(each) / EXPOSURE_SCALE)) + 0.5).cast("int").alias("exposure")
    )


def risks_by_category(risks: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    return risks.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def top_risks(risks: DataFrame, k: int = 10, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """The ``k`` weightiest risks of each group (weight, distinct affected, id): a top-k report. The limit is pushed below
    the shuffle, so no group is gathered."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_w"), F.desc("n_affected"), "id")
    out = risks.withColumn("_w", weight(F.col("severity"))).withColumn("n_affected", F.size(F.array_distinct("affected")))
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(*keys, "place", "id", "type", "severity", "n_affected")


def health(entities: DataFrame, architecture: DataFrame, exposure: DataFrame, knowledge: DataFrame | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Five dimensions and the weighted total of each group with entities.

    ``architecture`` (keys..., confidence, n_layers), ``exposure`` (keys..., exposure), ``knowledge`` (keys..., path): attributed notes.
    """
    out = F.size("depends_on")
    agg = entities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(out).alias("avg_deps"), F.max(out).alias("max_deps"), F.avg("complexity").alias("avg_c"), (F.count_if(F.col("complexity") > 20) / F.count(F.lit(1))).alias("high_c")
    )
    a = F.floor(F.least(F.lit(100.0), F.coalesce("confidence", F.lit(0.0)) * 70 + F.least(F.lit(1.0), F.coalesce("n_layers", F.lit(0)) / 3) * 30) + 0.5)
    d = clamp(F.lit(100) - F.when(F.col("avg_deps") > 15, 30).when(F.col("avg_deps") > 10, 20).when(F.col("avg_deps") > 5, 10).otherwise(0) - F.when(F.col("max_deps") > 30, 20).when(F.col("max_deps") > 20, 10).otherwise(0))
    c = clamp(F.lit(100) - F.when(F.col("avg_c") > 20, 40).when(F.col("avg_c") > 10, 20).when(F.col("avg_c") > 5, 5).otherwise(0) - F.when(F.col("high_c") > 0.3, 30).when(F.col("high_c") > 0.1, 15).otherwise(0))
    joined = agg.join(architecture, list(keys), "left").join(exposure, list(keys), "left")
    if knowledge is not None:
        per = knowledge.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("_k"))
        noted = entities.select(*keys, "path").join(per, [*keys, "path"]).groupBy(*keys).agg(F.sum(F.least(F.lit(1.0), F.col("_k") / 5)).alias("_density"), F.count(F.lit(1)).alias("_covered"), F.sum("_k").alias("_notes"))
        joined = joined.join(noted, list(keys), "left").na.fill(0, ["_density", "_covered", "_notes"])
        k = F.floor(F.col("_density") / F.col("n") * 50 + F.col("_covered") / F.col("n") * 30 + F.least(F.lit(1.0), F.col("_notes") / F.col("n")) * 20 + 0.5)
    else:
        k = F.lit(0)
    dims = joined.select(*keys, a.cast("int").alias("architecture"), d.cast("int").alias("dependency"), c.cast("int").alias("complexity"), k.cast("int").alias("knowledge"), (100 - F.coalesce("exposure", F.lit(0))).cast("int").alias("risk"))
    total = sum((F.col(n) * w for n, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    return dims.withColumn("overall", F.floor(total + 0.5).cast("int"))


def critical_components(entities: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Entities whose composite score is at least 0.3, with factors, criticality and reason. The bounds are one row per group."""
    into, out, c = F.size("depended_on_by"), F.size("depends_on"), F.col("complexity")
    top = entities.groupBy(*keys).agg(F.greatest(F.max(into), F.lit(1)).alias("_i"), F.greatest(F.max(out), F.lit(1)).alias("_o"), F.greatest(F.max(c), F.lit(1)).alias("_c"))
    e = entities.join(top, list(keys))
    fi, fo, fc, imp = into / F.col("_i"), out / F.col("_o"), c / F.col("_c"), F.col("importance")
    score = imp * 0.3 + fi * 0.25 + fo * 0.15 + fc * 0.2 + 0.05
    level = criticality(F.col("_score"))
    why = F.concat_ws(
        ", ",
        F.when(F.col("fan_in") > 0.7, F.concat(F.lit("high fan-in ("), into, F.lit(" dependents)"))), F.when(F.col("cx") > 0.7, F.concat(F.lit("high complexity ("), c, F.lit(")"))),
        F.when(imp > 0.7, F.lit("high graph centrality")), F.when(F.col("fan_out") > 0.7, F.concat(F.lit("high fan-out ("), out, F.lit(" dependencies)"))),
    )
    e = e.withColumns({"_score": score, "fan_in": fi, "fan_out": fo, "cx": fc}).filter("_score >= 0.3")
    reason = F.when(why == "", F.concat(level, F.lit(" criticality based on composite scoring"))).otherwise(F.concat(level, F.lit(" criticality due to "), why))
    r3 = lambda x: rounded(x, 1000)
    return e.select(*keys, "path", level.alias("criticality"), r3(F.col("_score")).alias("score"), r3(imp).alias("centrality"), r3(F.col("fan_in")).alias("fan_in"), r3(F.col("fan_out")).alias("fan_out"), r3(F.col("cx")).alias("complexity"), reason.alias("reason"))


def filled(template: str, *values: Column) -> Column:
    """A text of the rules with its places filled."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for part, value in zip(parts[1:], values, strict=True):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def counted(name: str, n: Column, *values: Column) -> Column:
    """The story's text for one or many."""
    return F.when(n == 1, filled(STORY[f"{name}_one"], *values)).otherwise(filled(STORY[f"{name}_many"], *values))


def identity(repositories: DataFrame, best: DataFrame, profile: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """What each repository is: name, project_type, frameworks (name, category), test_framework, package_manager, description and signs of maturity.

    ``repositories`` (keys..., root_path, frameworks array<string>, package_manager, has_package_json, has_readme, version), ``best`` (keys..., pattern),
    ``profile`` (keys..., languages). Null frameworks count as none. Signs that would need a listing of the files (CI, changelog, contributing, containers) are false.
    """
    rows = repositories.join(best.select(*keys, "pattern"), list(keys), "left").join(profile.select(*keys, "languages"), list(keys), "left")
    names = F.coalesce("frameworks", F.array().cast("array<string>"))
    has = lambda parts: F.exists(names, lambda f: has_part(f, parts))
    has_part = lambda f, parts: F.lower(f).rlike("|".join(parts))
    kind = F.lit(None).cast("string")
    for name, parts in reversed(PROJECT_TYPES):
        kind = F.when(has(parts), name).otherwise(kind)
    kind = F.coalesce(kind, F.when(F.col("pattern") == "monolith", "application"), F.when(F.col("has_package_json"), "library"), F.lit("unknown"))
    tests = F.lit(None).cast("string")
    for name in reversed(TEST_FRAMEWORKS):
        tests = F.when(has((name,)), name).otherwise(tests)

    def category(f: Column) -> Column:
        out = F.lit("other")
        for name, parts in reversed(FRAMEWORK_CATEGORIES.items()):
            out = F.when(has_part(f, parts), name).otherwise(out)
        return out

    first = F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("unknown"))
    words = F.lit(None).cast("string")
    for name, text in DESCRIPTIONS.items():
        words = F.when(F.col("project_type") == name, filled(text, first)).otherwise(words)
    described = F.when(F.coalesce("pattern", F.lit("unknown")) != "unknown", filled(DESCRIBED_PATTERN, words, F.col("pattern"))).otherwise(words)
    path = F.filter(F.split("root_path", r"[/\\\\]"), lambda x: x != "")
    return rows.withColumn("project_type", kind).select(
        *keys, F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("unknown")).alias("name"), "project_type", F.transform(names, lambda f: F.struct(f.alias("name"), category(f).alias("category"))).alias("frameworks"),
        tests.alias("test_framework"), "package_manager", described.alias("description"), tests.isNotNull().alias("has_tests"), has(LINTERS).alias("has_linting"), F.coalesce("has_readme", F.lit(False)).alias("has_documentation"),
        F.col("version").isNotNull().alias("uses_semver"), *[F.lit(False).alias(c) for c in ("has_ci", "has_changelog", "has_contributing", "has_docker")],
    )


def story(
    who: DataFrame, profile: DataFrame, best: DataFrame, layers: DataFrame, domains: DataFrame, scores: DataFrame, critical: DataFrame, assessment: DataFrame, top: DataFrame, keys: Sequence[str] = ("repo_id",)
) -> DataFrame:
    """Narrative sentences of each group, out of its summary rows: summary, architecture, domains, health, critical path and risks.

    ``who`` are rows of :func:`identity`, ``scores`` of :func:`health`, ``critical`` of :func:`critical_components`, ``assessment`` of :func:`risk_assessment`,
    ``top`` of :func:`top_risks` (its type stands for a description). Each group's lists are bounded: layers by the rules, names to five, top risks to three.
    """
    lay = layers.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("_layers"))
    dom = domains.groupBy(*keys).agg(F.count(F.lit(1)).alias("_domains"))
    worst = critical.filter("criticality = 'critical'")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "path"))
    named = worst.withColumn("_n", place).filter("_n <= 5").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: F.element_at(F.split(x["path"], "/"), -1)).alias("_names"))
    cri = worst.groupBy(*keys).agg(F.count(F.lit(1)).alias("_critical")).join(named, list(keys))
    risk = assessment.select(*keys, F.col("total").alias("_total"), F.col("exposure").alias("_exposure"), F.col("critical").alias("_worst"), F.col("high").alias("_high"))
    first = top.filter("place <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "severity", "type", "n_affected"))).alias("_top"))
    rows = who.drop("package_manager")
    for part in (profile.select(*keys, "repository_size", "languages"), best.select(*keys, "pattern", "confidence"), lay, dom, scores, cri, risk, first):
        rows = rows.join(part, list(keys), "left")
    n_lang = F.size(F.coalesce("languages", F.array().cast("array<string>")))
    lang = F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("unknown"))
    using = F.array_join(F.transform(F.slice("frameworks", 1, 3), lambda f: f["name"]), ", ")
    start = F.concat(
        filled(STORY["project"], F.col("name"), F.coalesce("repository_size", F.lit("tiny")), F.col("project_type")),
        F.when(n_lang == 1, filled(STORY["one_language"], lang)).otherwise(counted("languages", n_lang - 1, lang, n_lang - 1)), F.when(using != "", filled(STORY["frameworks"], using)).otherwise(""), F.lit(STORY["end"]),
    )
    summary = F.concat(start, F.when((F.col("description") != "") & (F.col("description") != start), filled(STORY["description"], F.col("description"))).otherwise(""))
    held = F.coalesce("_layers", F.array().cast("array<string>"))
    pct = F.floor(F.coalesce("confidence", F.lit(0.0)) * 100 + 0.5)
    arch = F.concat(
        filled(STORY["pattern"], F.coalesce("pattern", F.lit("unknown"))), F.when(pct > 0, filled(STORY["match"], pct)).otherwise(""), F.when(F.size(held) > 0, counted("layers", F.size(held), F.size(held), F.array_join(held, ", "))).otherwise(""), F.lit(STORY["end"])
    )
    d = F.coalesce("_domains", F.lit(0))
    dom_text = F.when(d == 0, F.lit(STORY["no_domains"])).otherwise(counted("domains", d, d))
    o = F.col("overall")
    rating = F.lit("critical")
    for least, name in reversed(HEALTH_RATINGS):
        rating = F.when(o >= least, name).otherwise(rating)
    dims = F.array(*[F.struct(F.col(n).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(HEALTH_WEIGHTS)])
    weakest = F.array_min(dims)
    none = o.isNull() | ((o == 0) & F.forall(dims, lambda x: x["v"] == 0))
    health_text = F.when(none, F.lit(STORY["no_health"])).otherwise(F.concat(filled(STORY["health"], o, rating), F.when(weakest["v"] < CONCERN, filled(STORY["concern"], weakest["n"], weakest["v"])).otherwise("")))
    c = F.coalesce("_critical", F.lit(0))
    crit = F.when(c == 0, F.lit(STORY["no_critical"])).otherwise(counted("critical", c, c, F.array_join(F.coalesce("_names", F.array().cast("array<string>")), " -> ")))
    n = F.coalesce("_total", F.lit(0))
    details = F.transform(F.coalesce("_top", F.array().cast("array<struct<place:int,severity:string,type:string,n_affected:int>>")), lambda x: counted("top", x["n_affected"], F.upper(x["severity"]), x["type"], x["n_affected"]))
    lines = F.array(counted("risks", n, n, F.col("_exposure")), F.when(F.col("_worst") > 0, counted("critical_risks", F.col("_worst"), F.col("_worst"))), F.when(F.col("_high") > 0, counted("high_risks", F.col("_high"), F.col("_high"))))
    risks = F.when(n == 0, F.array(F.lit(STORY["no_risks"]))).otherwise(F.concat(F.filter(lines, lambda x: x.isNotNull()), details))
    return rows.select(*keys, summary.alias("summary"), arch.alias("architecture"), dom_text.alias("domains"), health_text.alias("health"), crit.alias("critical"), risks.alias("risks"))
