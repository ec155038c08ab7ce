"""Task scoring by keyword, routing rules, and assignment of agents. Keyword tables are literals in the plan, so scoring is one map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines of code that a description adds by naming any of the words.
LINES = [(500, ["auth", "authentication"]), (300, ["db", "database"]), (200, ["api"]), (400, ["ui", "interface"])]
OUTSIDE = ["integration", "external", "third-party", "api", "service"]
#: Keyword and risk, in the order in which risks are listed.
RISKS = {
    "security": "Security implementation required",
    "performance": "Performance optimization needed",
    "scalability": "Scalability considerations",
    "legacy": "Legacy system integration",
    "data migration": "Data migration required",
}
#: Skills of a category in alphabetical order.
SKILLS = {
    "frontend": ["css", "html", "javascript", "react", "vue"],
    "backend": ["api", "database", "java", "node", "python"],
    "devops": ["ci/cd", "deployment", "docker", "kubernetes"],
    "security": ["authentication", "encryption", "security"],
    "testing": ["qa", "quality", "test", "validation"],
}
HOURS = {"feature": 8, "bugfix": 4, "documentation": 2, "code_review": 1, "refactor": 6}
#: Level, most hours, most components, most skills; the first that holds.
LEVELS = [("simple", 6, 1, 2), ("moderate", 20, 3, 4), ("complex", 50, 8, 6)]
RETRIES = {"quality_gate_failure": (1, 1.0), "resource_unavailable": (5, 1.2), "agent_failure": (2, 1.5), "agent_timeout": (3, 2.0)}


def has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def lines_of_code(text: Column) -> Column:
    return sum((F.when(has(F.lower(text), w), n).otherwise(0) for n, w in LINES), F.lit(0)).cast("long")


def outside_dependencies(requirements: Column) -> Column:
    """Pairs of a requirement and a keyword that it holds."""
    return F.aggregate(requirements, F.lit(0).cast("long"), lambda n, r: n + sum((F.contains(F.lower(r), F.lit(w)).cast("long") for w in OUTSIDE), F.lit(0).cast("long")))


def risks(text: Column) -> Column:
    return F.filter(F.array(*(F.when(F.contains(text, F.lit(k)), v) for k, v in RISKS.items())), lambda x: x.isNotNull())


def skills(text: Column) -> Column:
    """Of each category the first two skills, in alphabetical order."""
    of = lambda names: F.slice(F.filter(F.array(*map(F.lit, names)), lambda s: F.contains(text, s)), 1, 2)
    return F.array_distinct(F.concat(*map(of, SKILLS.values())))


def case(key: Column, table: dict, default) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), table.items(), F).otherwise(default)


def scored(tasks: DataFrame) -> DataFrame:
    """loc, components, outside, hours, n_skills, complexity, pattern beside the task's columns (description, requirements, task_type)."""
    full = F.concat(F.lower("description"), F.lit(" "), F.lower(F.array_join("requirements", " ")))
    tasks = tasks.withColumn("__full", full)  # a column of its own, since some thirty tests read it
    full = F.col("__full")
    t = tasks.withColumns({"loc": lines_of_code(F.col("description")), "components": F.greatest(F.lit(1), F.size("requirements")).cast("long"), "outside": outside_dependencies(F.col("requirements")), "risks": risks(full), "skills": skills(full)}).drop("__full")
    t = t.withColumn("hours", case(F.col("task_type"), HOURS, 4).cast("double") * (1 + F.col("loc") / 5000 + F.col("outside") * 0.2)).withColumn("n_skills", F.size("skills").cast("long"))
    level = reduce(lambda c, r: c.when((F.col("hours") <= r[1]) & (F.col("components") <= r[2]) & (F.col("n_skills") <= r[3]), r[0]), LEVELS, F).otherwise("enterprise")
    t = t.withColumn("complexity", level)
    c, many = F.col("complexity"), F.col("components") > 1
    return t.withColumn("pattern", F.when((c == "simple") | ((c == "moderate") & ~many), "sequential").when(c == "moderate", "pipeline").when((c == "complex") & (F.col("outside") > 0), "fan_out_in").when(c == "complex", "parallel").otherwise("conditional"))


def recovery(error: Column, retries: Column) -> Column:
    return F.when((error == "agent_timeout") & (retries < RETRIES["agent_timeout"][0]), "retry_with_backoff").when(error.isin("agent_timeout", "agent_failure"), "fallback_agent").when(error == "resource_unavailable", "wait_and_retry").otherwise("escalate_to_human")


def back_off_of(error: Column, retries: Column) -> Column:
    return F.pow(case(error, {k: v[1] for k, v in RETRIES.items()}, 1.0).cast("double"), retries.cast("double"))


def priority(value: Column) -> Column:
    """low to critical as 1 to 5 in any case; whatever else is medium."""
    return case(F.lower(value), {"low": 1, "medium": 2, "high": 3, "urgent": 4, "critical": 5}, 2).cast("long")


def quality(success: Column, deliverables: Column) -> Column:
    return F.least(F.lit(100.0), F.when(success, 85.0).otherwise(30.0) + deliverables * 5.0)


def satisfaction(success: Column, quality_score: Column) -> Column:
    return quality_score * F.when(success, 0.9).otherwise(0.6)


def primary_agent(kind: Column) -> Column:
    return case(kind, {"feature": "developer_1", "bugfix": "developer_1", "documentation": "documentation_agent", "code_review": "code_reviewer"}, "project_manager")


def best_agents(phases: DataFrame, agents: DataFrame) -> DataFrame:
    """Of the enabled agents of a phase's type the one of the highest performance / (1 + load); the first by name in a tie."""
    score = F.col("performance") / (1 + F.col("load"))
    best = agents.filter("enabled").groupBy("agent_type").agg(F.max_by(F.struct("agent", score.alias("score")), F.struct(score, F.lit(0) - F.col("rank"))).alias("b"))
    return phases.join(best, "agent_type").select(*phases.columns, "b.agent", "b.score")


def overloaded(work: DataFrame, agent: str, duration: str, times: float = 1.5) -> DataFrame:
    """Sum by agent, and whether it is over so many times the mean of all agents. The mean comes from the sums, a row an agent."""
    load = work.groupBy(agent).agg(F.round(F.sum(duration), 6).alias("load"))
    mean = load.agg(F.avg("load").alias("mean"))
    return load.crossJoin(mean).select(agent, "load", (F.col("load") > F.col("mean") * times).alias("overloaded"))


#: Prompt variations by kind: template, what goes before the prompt, what goes after, what is done to it. No more than these change a prompt.
VARIATIONS = {
    "tone_adjustment": [
        ("professional", "", "", "formal"),
        ("friendly", "", "Always maintain a friendly and approachable tone in your interactions.", ""),
        ("direct", "Be direct and concise in all responses.", "", ""),
        ("encouraging", "", "Provide encouraging feedback and support to team members.", ""),
    ],
    "structure_modification": [("steps", "", "", "steps"), ("bullets", "", "", "bullets"), ("sections", "", "", ""), ("examples", "", "", "")],
    "detail_level_change": [
        ("more", "", "Provide detailed explanations and comprehensive analysis in all responses.", ""),
        ("less", "Be concise and focus on key points.", "", ""),
        ("technical", "", "", ""),
        ("edge_cases", "", "", ""),
    ],
    "instruction_clarity": [
        ("explicit", "", "Be explicit about requirements and provide specific, actionable guidance.", ""),
        ("outputs", "", "", ""),
        ("validation", "", "", ""),
        ("format", "", "", ""),
    ],
    "context_enhancement": [
        ("goals", "Consider the overall project context and goals when completing tasks.", "", ""),
        ("team", "", "", ""),
        ("stack", "", "", ""),
        ("users", "", "", ""),
    ],
    "specialization_focus": [("expertise", "", "", "focus"), ("practices", "", "", "focus"), ("standards", "", "", "focus"), ("tools", "", "", "focus")],
}
#: What an agent's kind is told to focus on.
FOCUS = {
    "developer": "coding best practices and software engineering",
    "code_reviewer": "code quality and security standards",
    "architect": "system design and architectural patterns",
    "project_manager": "project management and team coordination",
    "qa_agent": "testing methodologies and quality assurance",
    "documentation_agent": "technical writing and documentation standards",
}
VARIATION_SCHEMA = "place int, kind string, template string, before string, after string, step string"


def variations(n: int) -> list[tuple]:
    """Of each kind the first n templates, and of all these the first n: four or fewer are all of tone. Rows of VARIATION_SCHEMA."""
    every = [(kind, *t) for kind, templates in VARIATIONS.items() for t in templates[:n]]
    return [(i, *v) for i, v in enumerate(every[:n])]


def varied(prompt: Column, agent: Column, step: Column, before: Column, after: Column) -> Column:
    gap = "\n\n"
    changed = (
        F.when(step == "formal", F.replace(F.replace(prompt, F.lit("friendly"), F.lit("professional")), F.lit("casual"), F.lit("formal")))
        .when(step == "steps", F.concat(F.lit("Follow these numbered steps:\n1. "), F.replace(prompt, F.lit(". "), F.lit(".\n2. "))))
        .when(step == "bullets", F.concat(F.lit("Key responsibilities:\n• "), F.replace(prompt, F.lit(". "), F.lit(".\n• "))))
        .when(step == "focus", F.concat(F.lit("Focus on "), case(agent, FOCUS, "general expertise"), F.lit(" in your responses." + gap), prompt))
        .otherwise(prompt)
    )
    return F.concat(F.when(before == "", "").otherwise(F.concat(before, F.lit(gap))), changed, F.when(after == "", "").otherwise(F.concat(F.lit(gap), after)))


def phases_progress(phases: DataFrame, key: str, order: str) -> DataFrame:
    """Progress in per cent after each phase."""
    w = W.partitionBy(key)
    return phases.withColumn("progress", F.round(F.row_number().over(w.orderBy(order)) / F.count(F.lit(1)).over(w) * 100, 6))
