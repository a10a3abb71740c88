"""The whole evaluation of answered exams: items, keys, closed answers, development points, totals and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiza.functions.json_repair import value_text
from tiza.functions.numeric import grade, pass_points
from tiza.functions.text import label, normal_key, normalise_answer
from tiza.operators import parse, scoring
from tiza.operators.dedupe import first_wins
from tiza.operators.fuzzy_join import match_items
from tiza.operators.lineage import checkpointed


def item_list(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., items): the development items in order, as `id (Máx: n puntos)` joined by commas; empty without any."""
    entry = F.concat("id", F.lit(" (Máx: "), F.col("max_score").cast("string"), F.lit(" puntos)"))
    own = F.array_sort(F.collect_list(F.when(F.col("is_development"), F.struct("pos", entry.alias("t")))))
    return items.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["t"]), ", ").alias("items"))


def marked(exams: DataFrame, answers: DataFrame, compat: bool = True) -> DataFrame:
    """(exam, student, question, given, confidence, item_id, item_max, right, correct) of exams(exam, sheet, key) and answers(exam, student, pos, question, given, mode).

    A question's first answer counts. Its item is the matching closed one (compat: the first by position), the right answer
    that of the item's id as written, or of the question where no item matches; without one no answer is correct."""
    closed = parse.score_sheet(exams.select("exam", "sheet"), "sheet").where("not is_development")
    keys = parse.answer_key(exams.select("exam", "key"), ["exam"], "key")
    asked = answers.withColumn("question", normal_key(F.col("question")))
    first = first_wins(asked, ["exam", "student", "question"], ["pos"])
    read = first.withColumn("_n", normalise_answer(F.col("given"), F.col("question"), F.col("mode")))
    read = read.select("exam", "student", "question", F.col("_n.text").alias("given"), F.col("_n.confidence").alias("confidence"))
    # items and right answers are looked up once for each question of an exam, not for each student
    found = match_items(checkpointed(asked.select("exam", "question").distinct()), closed.select("exam", "pos", "id", "max_score"), ["exam"], compat)
    right = keys.select(F.col("exam").alias("_exam"), F.col("id").alias("_id"), normal_key(F.col("answer")).alias("right"))
    same = (F.col("exam") == F.col("_exam")) & (F.coalesce("item_id", "question") == F.col("_id"))
    found = found.join(right, same, "left").drop("_exam", "_id").withColumnsRenamed({"exam": "_exam", "question": "_question"})
    out = read.join(found, (F.col("exam") == F.col("_exam")) & (F.col("question") == F.col("_question")), "left").drop("_exam", "_question")
    out = out.withColumn("item_max", F.coalesce("item_max", F.lit(1)))
    return out.withColumn("correct", F.coalesce((F.col("right") != "") & (F.col("right") == F.col("given")), F.lit(False)))


def evaluated(exams: DataFrame, answers: DataFrame, details: DataFrame, pct: float = 60.0, compat: bool = True) -> DataFrame:
    """(exam, student, closed_score, development_score, sm_right, vf_right, result, grade, pass_points, max_score) of every student with an answer or a detail.

    exams also has declared, a total that the items' sum replaces; details(exam, student, item, points) has `n/m` texts, of
    which an item's first counts. Students without an exam drop out."""
    items = parse.score_sheet(exams.select("exam", "sheet", "declared"), "sheet")
    totals = scoring.maximum(items, ["exam"], F.col("declared")).select("exam", F.col("total_max").alias("max_score"))
    m = marked(exams, answers, compat)
    right = lambda tag: F.count_if(F.col("correct") & F.col("question").contains(tag))
    closed = m.groupBy("exam", "student").agg(
        F.sum(F.when(F.col("correct"), F.col("item_max")).otherwise(0)).cast("long").alias("closed_score"), right("SM").alias("sm_right"), right("VF").alias("vf_right")
    )
    once = first_wins(details.select("exam", "student", "item", "points"), ["exam", "student", "item"], ["points"])
    n = F.regexp_extract("points", "^([0-9]+)/([0-9]+)$", 1).try_cast("long")
    development = once.groupBy("exam", "student").agg(F.coalesce(F.sum(n), F.lit(0)).alias("development_score"))
    both = closed.join(development, ["exam", "student"], "full_outer").na.fill(0, ["closed_score", "development_score", "sm_right", "vf_right"])
    out = both.join(totals, "exam").withColumn("_score", F.col("closed_score") + F.col("development_score"))
    s, top, p = F.col("_score").cast("double"), F.col("max_score").cast("double"), F.lit(float(pct))
    return out.select(
        "exam", "student", "closed_score", "development_score", "sm_right", "vf_right",
        result(F.col("_score"), F.col("max_score")).alias("result"), grade(s, top, p).alias("grade"), pass_points(top, p).cast("long").alias("pass_points"), "max_score",
    )


def reply_details(replies: DataFrame) -> DataFrame:
    """(exam, student, item, points) of replies(exam, student, reply), as validated.parsed_replies() makes them: the development items that evaluated() counts. Unusable replies have none."""
    items = F.map_entries(F.col("reply.retroalimentacion.detalle_puntaje_desarrollo"))
    each = replies.select("exam", "student", F.explode(items).alias("e"))
    # of an item only the points are parsed
    return each.select("exam", "student", F.col("e.key").alias("item"), F.from_json(F.col("e.value"), "puntaje string")["puntaje"].alias("points"))


def result(score: Column, maximum: Column) -> Column:
    """`score/maximum`."""
    return F.concat(score.cast("string"), F.lit("/"), maximum.cast("string"))


def report_rows(corrections: DataFrame, details: DataFrame) -> DataFrame:
    """(student, pos, section, detail): a report's corrections and, after them, its development items.

    corrections(student, pos, section, detail); details(student, detail): a map by item, whose names get spaces for underscores
    and whose values, JSON or plain text, are written out (see value_text)."""
    each = details.select("student", F.explode(F.array_sort(F.map_entries("detail"))).alias("e"))
    more = each.select("student", F.lit(None).cast("int").alias("pos"), F.concat(F.lit("Pregunta Desarrollo: "), label(F.col("e.key"))).alias("section"), value_text(F.col("e.value")).alias("detail"))
    return corrections.select("student", F.col("pos").cast("int").alias("pos"), "section", "detail").unionByName(more)


def objective_counts(key: Column, given: Column) -> Column:
    """How many of the given answers equal the key's at the same place, after trimming and upper case."""
    at = F.transform(key, lambda k, i: (normal_key(F.coalesce(F.get(given, i), F.lit(""))) == k).cast("int"))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x)


def rescored(answers: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """answers(keys..., question, given, right) with item_max and points: items(keys..., pos, id, max_score) are met by equal names alone, the first by position; an answer without one is worth 1."""
    first = first_wins(items.select(*keys, "pos", F.col("id").alias("question"), "max_score"), [*keys, "question"], ["pos"]).drop("pos")
    out = answers.join(first, [*keys, "question"], "left").withColumn("item_max", F.coalesce("max_score", F.lit(1))).drop("max_score")
    return out.withColumn("points", F.when(F.col("given") == F.col("right"), F.col("item_max")).otherwise(0))
