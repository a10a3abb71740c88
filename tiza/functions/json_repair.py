"""JSON text from outside: cutting it out of noise, parsing it, filling defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiza.functions.text import strip

SCHEMA = (
    "puntaje string, nota double, retroalimentacion struct<correccion_detallada:array<struct<seccion:string,detalle:string>>,"
    "evaluacion_habilidades:array<struct<habilidad:string,evaluacion:string,evidencia:string>>,resumen_general:struct<fortalezas:string,areas_mejora:string>,"
    "retroalimentacion_alternativas:array<struct<pregunta:string,respuesta_estudiante:string,respuesta_correcta:string>>,"
    "detalle_puntaje_desarrollo:map<string,string>>"
)


def cut_json(raw: Column) -> Column:
    """What a fenced block holds, trimmed; else from the first brace to the last; else the trimmed text. Outside a fence, what is no JSON then has its characters repaired."""
    fence = r"(?s)```json\n(.*?)\n```"
    held = F.get(F.regexp_extract_all(raw, F.lit(r"(?s)(\{.*\})"), 1), F.lit(0))
    # within transform() the cut text has a name, so that it is worked out once
    whole = F.get(F.transform(F.array(F.coalesce(held, strip(raw))), lambda cut: F.when(F.try_parse_json(cut).isNotNull(), cut).otherwise(repaired_characters(cut))), F.lit(0))
    return F.when(raw.rlike(fence), strip(F.regexp_extract(raw, fence, 1))).otherwise(whole)


def repaired_characters(text: Column) -> Column:
    """Line breaks as spaces, backslashes doubled, and quotes escaped but for one at the start."""
    plain = F.replace(F.regexp_replace(text, "\r\n|\n|\r", " "), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(plain, '([^\\\\])"', '$1\\\\"')


def braces(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def parsed(raw: Column, schema: str = SCHEMA, options: dict[str, str] | None = None) -> Column:
    return F.from_json(cut_json(raw), schema, options)


def usable(value: Column) -> Column:
    """Whether a parsed reply has its base fields."""
    return value.isNotNull() & F.coalesce(value["puntaje"] != "", F.lit(False)) & value["retroalimentacion"].isNotNull()


def with_defaults(value: Column) -> Column:
    """The reply with empty collections where they are missing and 0 for a missing grade."""
    r = value["retroalimentacion"]
    arrays = {n: F.coalesce(r[n], F.from_json(F.lit("[]"), f"array<struct<{fields}>>")) for n, fields in (
        ("correccion_detallada", "seccion:string,detalle:string"),
        ("evaluacion_habilidades", "habilidad:string,evaluacion:string,evidencia:string"),
        ("retroalimentacion_alternativas", "pregunta:string,respuesta_estudiante:string,respuesta_correcta:string"),
    )}
    summary = F.coalesce(r["resumen_general"], F.struct(F.lit("").alias("fortalezas"), F.lit("").alias("areas_mejora")))
    development = F.coalesce(r["detalle_puntaje_desarrollo"], F.create_map().cast("map<string,string>"))
    inner = F.struct(*[arrays[n].alias(n) for n in arrays], summary.alias("resumen_general"), development.alias("detalle_puntaje_desarrollo"))
    return F.struct(value["puntaje"].alias("puntaje"), F.coalesce(value["nota"], F.lit(0.0)).alias("nota"), inner.alias("retroalimentacion"))


def development_details(value: Column) -> Column:
    """The development items of a reply with defaults: a map of structs with puntaje, cita_estudiante and justificacion, for scoring; values that are no objects have none of them."""
    fields = "puntaje string, cita_estudiante string, justificacion string"
    return F.transform_values(value["retroalimentacion"]["detalle_puntaje_desarrollo"], lambda k, v: F.from_json(v, fields))


def path_number(raw: Column, path: str) -> Column:
    """The number at a path of JSON text, also where it is a string; null where the path doesn't exist or holds none."""
    return F.get_json_object(raw, path).try_cast("double")


def path_exists(raw: Column, path: str) -> Column:
    """Whether JSON text has a value other than null at the path."""
    return F.coalesce(F.get_json_object(raw, path).isNotNull(), F.lit(False))


def string_list(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def entries(value: Column) -> Column:
    """A map as an array of struct(key, value), in the order of keys, for exploding to rows."""
    return F.array_sort(F.map_entries(value))


def json_text(value: Column) -> Column:
    """A map, struct or array as JSON text; null fields are left out."""
    return F.to_json(value)


def as_text(value: Column) -> Column:
    """The value as a string, empty for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def value_text(raw: Column) -> Column:
    """The text of a value given as JSON: a string, number or boolean as itself; an object with a quotation and a reason as three lines; other objects and arrays as compact JSON; nothing for null.

    Text that is no JSON stands for itself."""
    at = lambda p: F.get_json_object(raw, p)
    graded = F.concat(F.lit("Puntaje: "), F.coalesce(at("$.puntaje"), F.lit("undefined")), F.lit('\nRespuesta Estudiante: "'), at("$.cita_estudiante"), F.lit('"\nJustificación: '), at("$.justificacion"))
    plain = F.when(strip(raw) == "null", "").otherwise(F.coalesce(at("$"), raw, F.lit("")))
    return F.when(_truthy(at("$.cita_estudiante")) & _truthy(at("$.justificacion")), graded).otherwise(plain)


def _truthy(text: Column) -> Column:
    return F.coalesce(~text.isin("", "0", "false"), F.lit(False))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
