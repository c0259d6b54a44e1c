"""Reading results of any version, and the report of a run as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.analytics import one_per_metric

# The version that is written now, and that of results without one; what stands for an absent number.
VERSION, UNVERSIONED = 6, 1
ABSENT = "—"


def result_version(body: Column) -> Column:
    """(version, problem) of a result's JSON: its whole-number version, 1 where it has none, and why it can't be read if it can't."""
    parsed = F.try_parse_json(body)
    raw = F.get_json_object(body, "$.schema_version")
    text = F.try_variant_get(parsed, "$.schema_version", "string")
    is_text = F.schema_of_variant(parsed).rlike('schema_version: STRING|schema_version: BOOLEAN|schema_version: D|schema_version: ARRAY|schema_version: OBJECT')
    number = F.when(raw.isNull(), UNVERSIONED).otherwise(text.try_cast("int"))
    problem = (
        F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "not a JSON object")
        .when(raw.isNotNull() & (F.coalesce(is_text, F.lit(False)) | number.isNull()), "schema_version is not a whole number")
        .when(number > VERSION, "written by a newer version").when(number < UNVERSIONED, "unknown version")
    )
    return F.struct(F.when(problem.isNull(), number).alias("version"), problem.alias("problem"))


def read_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results that can be read, with their version and body as today's version has it, and (result_id, problem) of the others.

    Each version's keys that came later are added as null, so that bodies of all versions have the same keys. What is stored is never rewritten.
    """
    rows = results.withColumn("_v", result_version(F.col("body")))
    later = F.map_from_arrays(F.array(*map(F.lit, ("run_id", "ingestion", "spec_identity_json"))), F.array(*[F.lit(None).cast("string")] * 3))
    entries = F.map_filter(later, lambda k, v: ~F.array_contains(F.json_object_keys("body"), k))
    missing = F.to_json(entries, {"ignoreNullFields": "false"})
    inner = F.expr("substring(trim(body), 2, length(trim(body)) - 2)")
    extra = F.expr("substring(_missing, 2, length(_missing) - 2)")
    good = rows.where("_v.problem is null").withColumn("_missing", missing)
    parts = F.array(F.when(F.length(F.trim(inner)) > 0, inner), F.when(F.length(extra) > 0, extra))
    good = good.withColumn("body", F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}"))).withColumn("version", F.col("_v.version")).drop("_v", "_missing")
    return good, rows.where("_v.problem is not null").select("result_id", F.col("_v.problem").alias("problem"))


def current_payload(kind: Column, payload: Column) -> Column:
    """A record's payload without what today's version derives instead of storing: the foreign markers of attacks."""
    plain = F.to_json(F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: k != "foreign_markers"))
    return F.when((kind == "attack") & F.contains(payload, F.lit('"foreign_markers"')) & plain.isNotNull(), plain).otherwise(payload)


def formatted(value: Column, state: Column) -> Column:
    """Four decimals; a dash with the state where nothing was measured."""
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).when(F.coalesce(state, F.lit("measured")) == "measured", ABSENT).otherwise(F.concat(F.lit(ABSENT + " ("), state, F.lit(")")))


def difference(one: Column, two: Column) -> Column:
    """The signed change from one to two; a dash unless both were measured."""
    return F.when(one.isNotNull() & two.isNotNull(), F.format_string("%+.4f", two - one)).otherwise(ABSENT)


def escaped(text: Column) -> Column:
    """One line of plain text that Markdown leaves alone."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"([\\`*_\[\]<>~&])", r"\\$1")


def summary(metrics: DataFrame, run_id: str) -> str:
    """The report of one run: a table for each suite with a column for each variant, and why metrics weren't measured."""
    rows = one_per_metric(metrics.where(F.col("run_id") == run_id)).withColumn("cell", formatted(F.col("value"), F.col("state"))).orderBy("suite", "name", "variant").collect()  # the metrics of one run
    lines = [f"# Run {run_id}", ""]
    for suite in sorted({r["suite"] for r in rows}):
        own = [r for r in rows if r["suite"] == suite]
        variants = sorted({r["variant"] for r in own})
        cells = {(r["name"], r["variant"]): r["cell"] for r in own}
        lines += [f"## {suite}", "", "| metric | " + " | ".join(v or "value" for v in variants) + " |", "|-|" + "-|" * len(variants)]
        lines += [f"| {n} | " + " | ".join(cells.get((n, v), ABSENT) for v in variants) + " |" for n in sorted({r["name"] for r in own})]
        lines.append("")
    reasons = metrics.where((F.col("run_id") == run_id) & (F.coalesce("state", F.lit("measured")) != "measured"))
    label = F.concat_ws("/", "suite", "name", F.when(F.length("variant") > 0, F.col("variant")))
    found = reasons.groupBy("state", escaped(F.col("reason")).alias("reason")).agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels")).orderBy("state", "reason").collect()
    if found:
        lines += ["Not measured:", "", *(f"- {r['labels']} — {r['state']}: {r['reason']}" for r in found), ""]
    return "\n".join(lines)
