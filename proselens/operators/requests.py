"""Generation requests: task expansion and prompt rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.functions.text import fixed, list_text, render_template

# Placeholders filled from the product row, in this order.
PLACEHOLDERS = ["name", "series", "features", "specs", "ibf_data"]


def versioned_name(family, iteration) -> "F.Column":
    """``{family}_iter{n}``."""
    fam = F.col(family) if isinstance(family, str) else family
    it = F.col(iteration) if isinstance(iteration, str) else iteration
    return F.concat(fam, F.lit("_iter"), it.cast("string"))


def prompt_family(name) -> "F.Column":
    """the family of a versioned prompt name, without its ``_iterN``."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"_iter[0-9]+$", "")


def expand_tasks(products: DataFrame, prompts: dict[str, str], models: Sequence[str],
                 iteration: int = 0) -> DataFrame:
    """One task per (product, prompt, enabled model).

    Prompts and models are job configuration, so the expansion is an
    ``explode`` of a literal array inside each product partition: no join,
    no shuffle.
    """
    combos = [F.struct(F.lit(p).alias("prompt_family"), F.lit(t).alias("template"), F.lit(m).alias("model"))
              for p, t in prompts.items() for m in models]
    t = products.withColumn("_task", F.explode(F.array(*combos)))
    return (t.withColumn("iteration", F.lit(iteration))
            .withColumn("prompt_family", F.col("_task.prompt_family"))
            .withColumn("prompt_name", versioned_name("prompt_family", "iteration"))
            .withColumn("model", F.col("_task.model"))
            .withColumn("template", F.col("_task.template"))
            .drop("_task"))


def render_prompts(tasks: DataFrame, template_col: str = "template") -> DataFrame:
    """Literal replacement of the five product placeholders.

    ``features`` is rendered as a JSON list; other placeholders in the
    template stay untouched.
    """
    values = {}
    for k in PLACEHOLDERS:
        if k == "features" and "features" in tasks.columns:
            values[k] = list_text("features")
        elif k in tasks.columns:
            values[k] = F.col(k)
        else:
            values[k] = F.lit("")
    return tasks.withColumn("user_prompt", render_template(F.col(template_col), values))


# What the reviewers of a text get to see; the text goes in last, so that
# braces in it are never taken for placeholders.
JUDGE_PLACEHOLDERS = ["min_chars", "max_chars", "char_len", "in_range", "semantic_attribute_alignment",
                      "semantic_feature_coverage_normalized", "candidate"]
FACTCHECK_PLACEHOLDERS = ["name", "series", "features", "specs", "candidate"]


def _as_text(df: DataFrame, name: str) -> "F.Column":
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "array":
        return list_text(name)
    if kind in ("double", "float"):
        return fixed(c, 3)
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    return c.cast("string")


def render_requests(rows: DataFrame, template: str, placeholders: Sequence[str], out: str = "request") -> DataFrame:
    """M3 / M4: the request text of every row from a template with named
    placeholders; a missing column or NULL prints blank."""
    values = {k: F.coalesce(_as_text(rows, k), F.lit("")) if k in rows.columns else F.lit("") for k in placeholders}
    return rows.withColumn(out, render_template(template, values))


def judge_requests(rows: DataFrame, template: str, cfg: EvalConfig = EvalConfig(),
                   text: str = "marketing_text") -> DataFrame:
    """M3: one judge request per candidate with its measures and limits."""
    r = rows.withColumns({"candidate": F.col(text), "min_chars": F.lit(cfg.min_chars), "max_chars": F.lit(cfg.max_chars)})
    return render_requests(r, template, JUDGE_PLACEHOLDERS)


def factcheck_requests(rows: DataFrame, products: DataFrame, template: str, text: str = "marketing_text") -> DataFrame:
    """M4: one fact-check request per candidate against its product's data."""
    known = products.select("product_id", "name", "series", "features", "specs")
    return render_requests(rows.withColumn("candidate", F.col(text)).join(known, "product_id", "left"), template,
                           FACTCHECK_PLACEHOLDERS)
