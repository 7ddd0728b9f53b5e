"""Scoring of predicted against expected entities, as joins and aggregations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _entities(df: DataFrame, case_col: str) -> DataFrame:
    """Distinct (case, type, text) of rows (case, type, text)."""
    return df.select(F.col(case_col).alias("case"), "type", "text").distinct()


def match_strict(predicted: DataFrame, expected: DataFrame, case_col: str = "case") -> DataFrame:
    """(case, type, text, outcome): tp, fp or fn for every entity of a case, as sets."""
    p = _entities(predicted, case_col).withColumn("p", F.lit(True))
    e = _entities(expected, case_col).withColumn("e", F.lit(True))
    outcome = F.when(F.col("p") & F.col("e"), "tp").when(F.col("p"), "fp").otherwise("fn")
    return p.join(e, ["case", "type", "text"], "full").select("case", "type", "text", outcome.alias("outcome"))


def scores(matched: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) by type, and for all types under 'ALL'.

    Without predictions precision is 1, without expectations recall is 1.
    """
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    counts = [count(k) for k in ("tp", "fp", "fn")]
    # the total has a row even if nothing was matched
    rows = matched.groupBy("type").agg(*counts).unionByName(matched.agg(*counts).withColumn("type", F.lit("ALL")))
    ratio = lambda b: F.when(F.col("tp") + F.col(b) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(b)))
    rows = rows.select(
        "type", "tp", "fp", "fn",
        ratio("fp").alias("precision"), ratio("fn").alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def meets_baseline(f1: float, baseline: float, tolerance: float = 1e-9) -> bool:
    return f1 >= baseline - tolerance


def gate(corpus: DataFrame, proven: DataFrame, baseline: float | None = None) -> list[str]:
    """What stands against a release: a proven case that is not exact, or an overall F1 below the baseline.

    corpus and proven are results of match_strict().
    """
    out = [f"proven {r['outcome']}: {r['type']} {r['text']} (case {r['case']})" for r in gaps(proven).collect()]  # a small suite
    f1 = scores(corpus).where("type = 'ALL'").first()["f1"]
    if baseline is not None and not meets_baseline(f1, baseline):
        out.append(f"overall F1 {f1:.6f} is below {baseline:.6f}")
    return out


def report(corpus: DataFrame, proven: DataFrame, generated: str) -> str:
    """A report in Markdown of two results of match_strict(): a table by type, then the total."""
    head = "| type | precision | recall | F1 | TP | FP | FN |\n| --- | --- | --- | --- | --- | --- | --- |"

    def table(matched: DataFrame) -> str:
        rows = scores(matched).orderBy(F.col("type") == "ALL", "type").collect()  # one for each type
        share = lambda x: f"{100 * x:.1f} %"
        line = lambda r: [r["type"], *(share(r[c]) for c in ("precision", "recall", "f1")), *(str(r[c]) for c in ("tp", "fp", "fn"))]
        return "\n".join([head, *("| " + " | ".join(line(r)) + " |" for r in rows)])

    return f"# Evaluation\n\nGenerated {generated}.\n\n## Corpus\n\n{table(corpus)}\n\n## Proven cases\n\n{table(proven)}\n"


def baseline_json(corpus: DataFrame) -> str:
    """The overall F1 as JSON, for a baseline file."""
    return json.dumps({"overallF1": scores(corpus).where("type = 'ALL'").first()["f1"]}, indent=2)


def match_lenient(predicted: list[str], expected: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(found, spurious, missed): one to one in order, where either text contains the other, in any case."""
    left = list(predicted)
    found, missed = [], []
    for want in expected:
        low = want.lower()
        k = next((i for i, got in enumerate(left) if low in got.lower() or got.lower() in low), None)
        if k is None:
            missed.append(want)
        else:
            found.append(left.pop(k))
    return found, left, missed


def match_lenient_cases(cases: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """cases with found, spurious and missed: match_lenient() of two array columns; JVM only."""
    texts = "array<string>"
    hit = "contains(lower(g), lower(e)) or contains(lower(e), lower(g))"
    step = (
        f"transform(array(coalesce(array_position(transform(s.spare, g -> {hit}), true), 0L)), k -> if(k = 0,"
        " named_struct('spare', s.spare, 'found', s.found, 'missed', array_append(s.missed, e)),"
        " named_struct('spare', concat(slice(s.spare, 1, int(k) - 1), slice(s.spare, int(k) + 1, size(s.spare))),"
        " 'found', array_append(s.found, s.spare[int(k) - 1]), 'missed', s.missed)))[0]"
    )
    start = f"named_struct('spare', cast({predicted} as {texts}), 'found', cast(array() as {texts}), 'missed', cast(array() as {texts}))"
    out = cases.withColumn("_m", F.expr(f"aggregate({expected}, {start}, (s, e) -> {step})"))
    return out.select(*cases.columns, "_m.found", F.col("_m.spare").alias("spurious"), "_m.missed")


def match_discovery(predicted: DataFrame, expected: DataFrame, case_col: str = "case") -> DataFrame:
    """(case, type, text, outcome): strict but for people, whose texts match leniently, each once in order.

    Both sides are (case, type, text[, start]); the people of a case go by start, then text.
    """

    def people(df: DataFrame, name: str) -> DataFrame:
        at = F.col("start") if "start" in df.columns else F.lit(0)
        rows = df.where("type = 'PERSON'").groupBy(case_col).agg(F.array_sort(F.collect_list(F.struct(at.alias("s"), "text"))).alias("x"))
        return rows.select(F.col(case_col).alias("case"), F.expr("transform(x, v -> v.text)").alias(name))

    strict = match_strict(predicted.where("type <> 'PERSON'"), expected.where("type <> 'PERSON'"), case_col)
    none = F.expr("cast(array() as array<string>)")
    both = people(predicted, "p").join(people(expected, "e"), "case", "full")
    both = both.select("case", F.coalesce("p", none).alias("predicted"), F.coalesce("e", none).alias("expected"))
    rows = match_lenient_cases(both)
    parts = [rows.select("case", F.explode(c).alias("text"), F.lit(o).alias("outcome")) for c, o in (("found", "tp"), ("spurious", "fp"), ("missed", "fn"))]
    lenient = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return strict.unionByName(lenient.select("case", F.lit("PERSON").alias("type"), "text", "outcome"))


def gaps(matched: DataFrame) -> DataFrame:
    """The entities that were missed or made up, for a report."""
    return matched.where("outcome <> 'tp'").select("outcome", "type", "text", "case").orderBy("outcome", "type", "text", "case")


def write_gap_report(matched: DataFrame, cases: DataFrame, path: str, case_col: str = "case", text_col: str = "text") -> None:
    """path/misses: (outcome, type, text, case, context) as JSON; path/scores: the scores by type as JSON."""
    texts = cases.select(F.col(case_col).alias("case"), F.col(text_col).alias("context"))
    gaps(matched).join(texts, "case", "left").write.mode("overwrite").json(f"{path}/misses")
    scores(matched).write.mode("overwrite").json(f"{path}/scores")


def compare_labels(predicted: DataFrame, names: dict[str, str], shared: list[str]) -> DataFrame:
    """Rows of another tool with its labels translated, restricted to the shared types."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return predicted.withColumn("type", pairs[F.col("type")]).where(F.col("type").isin(shared))
