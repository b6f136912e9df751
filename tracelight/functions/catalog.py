"""Normal forms as functions of a session's SQL: the same steps as those of the Columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracelight.functions.text import spark_sql


def _body(steps, argument: str, result: str) -> str:
    """The steps as one expression. Each is bound to its name once, so that later ones don't repeat it."""
    body = result
    for name, sql in reversed([(argument, "value"), *steps]):
        body = f"element_at(transform(array({spark_sql(sql)}), {name} -> {body}), 1)"
    return body


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary functions of a string each: normal_path, normal_link and normal_time; their names.

    Null where the text has no normal form.
    """
    from tracelight.operators import links, paths, timehints

    forms = {
        "normal_path": (paths.NORMAL, "path", "norm"), "normal_link": (links.PARTS, "link", "normal"), "normal_time": (timehints.STEPS, "hint", "normal_hint"),
    }
    for name, form in forms.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS STRING RETURN {_body(*form)}")
    return list(forms)
