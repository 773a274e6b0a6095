"""Highlights of repositories: what was built, with what, for which domain."""

from pyspark.sql import DataFrame, functions as F

from codelode import lexicons as lx
from codelode.operators import history, repo_docs as docs, rules
from codelode.operators.ranking import side_by_side
from codelode.sources.shared import write_shared


def _ordered(df: DataFrame, order: str, value, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy("repo_id").agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def highlights(files: DataFrame, commits: DataFrame, repos: DataFrame, hits: DataFrame | None = None, newest: int | None = 200) -> DataFrame:
    """One row per repository: features, integrations, achievements, domain, scale, skills, context.

    Achievements are those of the ``newest`` commits of each repository, or of all its commits where that is None.

    ``hits`` (``rules.file_rule_hits``) is written once, since features, evidence, integrations,
    scale and domain all read it; a stored table of hits can be passed in its place.
    """
    hits = write_shared(rules.file_rule_hits(files), "rule-hits") if hits is None else hits
    features = rules.detect_features(hits)
    integrations = rules.detect_integrations(hits)
    evidence = rules.feature_evidence(hits, features, 3).groupBy("repo_id", "feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda e: e["path"]).alias("evidence")
    )
    skill_lists = F.create_map(*[
        x for key, info in lx.FEATURE_INFO.items() for x in (F.lit(key), F.array(*map(F.lit, info[1])))
    ])
    built = features.join(evidence, ["repo_id", "feature"], "left").withColumn(
        "item",
        F.struct(
            F.col("title").alias("name"), F.concat(F.lit("Implemented "), F.lower("title")).alias("description"),
            F.bround("confidence", 2).alias("confidence"), skill_lists[F.col("feature")].alias("skills"),
            F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence_files"),
        ),
    )
    used = integrations.withColumn(
        "item",
        F.struct(
            F.col("integration").alias("name"), F.concat(F.lit("Integrated "), F.col("integration")).alias("description")
        ),
    )
    skills = rules.skills(features, integrations).groupBy("repo_id").agg(
        F.array_sort(F.collect_set("skill")).alias("skills_demonstrated")
    )
    out = side_by_side(repos.select("repo_id", "name"), "repo_id", [
        _ordered(built, "position", F.col("item"), "features"),
        _ordered(used, "rule_pos", F.col("item"), "integrations"),
        _ordered(history.achievements(commits, newest), "position", F.col("subject"), "achievements"),
        rules.detect_domain(hits, repos),
        _ordered(rules.scale_indicators(hits), "rule_pos", F.col("indicator"), "scale_indicators"),
        skills,
        docs.readme_excerpt(files),
    ])
    for name, kind in {
        "features": "array<struct<name:string,description:string,confidence:double,skills:array<string>,evidence_files:array<string>>>",
        "integrations": "array<struct<name:string,description:string>>",
        "achievements": "array<string>", "scale_indicators": "array<string>", "skills_demonstrated": "array<string>",
    }.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return out.select(
        "repo_id", "name", "features", "integrations",
        F.slice("achievements", 1, 10).alias("achievements"), "domain", "scale_indicators", "skills_demonstrated",
        summary_context().alias("summary_context"),
    )


def summary_context():
    """Context text of a row with readme, features, integrations, domain, scale and achievements."""

    def joined(items, n, sep=", "):
        return F.array_join(F.slice(items, 1, n), sep)

    def some(column):
        return F.size(column) > 0

    names = lambda c: F.transform(c, lambda x: x["name"])
    # concat_ws leaves out the parts that are NULL
    return F.concat_ws(
        "\n\n",
        F.when(F.col("readme") != "", F.concat(F.lit("README:\n"), "readme", F.lit("\n"))),
        F.when(some("features"), F.concat(F.lit("Features built: "), joined(names("features"), 5))),
        F.when(some("integrations"), F.concat(F.lit("Integrations: "), joined(names("integrations"), 5))),
        F.when(F.col("domain") != "", F.concat(F.lit("Domain: "), "domain")),
        F.when(some("scale_indicators"), F.concat(F.lit("Scale indicators: "), F.array_join("scale_indicators", ", "))),
        F.when(
            some("achievements"),
            F.concat(
                F.lit("Key achievements from commits:\n"),
                joined(F.transform("achievements", lambda a: F.concat(F.lit("- "), a)), 10, "\n"),
            ),
        ),
    )


def resume_bullets(found: DataFrame) -> DataFrame:
    """Bullet points of the strongest highlights."""
    skills = lambda f: F.array_join(F.slice(f["skills"], 1, 3), ", ")
    strong = F.filter(F.slice("features", 1, 5), lambda f: f["confidence"] >= 0.5)
    bullets = F.transform(
        strong,
        lambda f: F.concat(
            F.lit("• "), f["description"], F.when(skills(f) != "", F.concat(F.lit(" ("), skills(f), F.lit(")"))).otherwise("")
        ),
    )
    vendors = F.array_join(F.slice(F.transform("integrations", lambda i: i["name"]), 1, 5), ", ")
    # One line per scale group that has one.
    scale = {
        "high_traffic": "• Built for high-traffic production environment",
        "performance": "• Implemented performance optimizations",
        "reliability": "• Designed for high availability and fault tolerance",
    }
    more = [F.when(F.size("integrations") > 0, F.concat(F.lit("• Integrated with "), vendors))]
    more += [F.when(F.array_contains("scale_indicators", key), F.lit(line)) for key, line in scale.items()]
    return found.select("repo_id", F.array_join(F.concat(bullets, F.array(*more)), "\n").alias("bullets"))
