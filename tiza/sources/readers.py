"""Sources: tables, request bodies, forms, data URLs, event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tiza.functions.json_repair import string_list

EVENT = "type string, batchIndex int, groupId string, success boolean, data string, error string, totalItems int, totalBatches int"
#: File types that are taken in: fixed values.
ACCEPTED = (
    "image/jpeg",
    "image/png",
    "image/webp",
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain",
)
#: Plans: id, name, price in CLP, credits, days of validity. Fixed values.
PLANS = [
    ("free", "Plan Gratuito", 0, 10, 30),
    ("basic", "Plan Básico", 5000, 90, 30),
    ("intermediate", "Plan Intermedio", 29900, 640, 60),
    ("pro", "Plan Pro", 49900, 1280, 90),
]


#: The plans as a second list shows them: one more, and other prices. Fixed values.
SHOP_PLANS = [
    ("free", "Plan Gratuito", 0, 10, 30),
    ("basic", "Plan Básico", 5000, 90, 30),
    ("flow400", "Plan 400 créditos", 12990, 400, 60),
    ("intermediate", "Plan Intermedio", 29990, 640, 60),
    ("pro", "Plan Pro", 49990, 1280, 90),
]
#: Plan to price and credits where plans are bought, and price to credits where payments are notified. Fixed values.
PLAN_PRICE = {"intermediate": 29900, "pro": 49900}
PLAN_CREDITS = {"intermediate": 640, "pro": 1280}
PRICE_CREDITS = {29990: 560, 49990: 1200, 12990: 400}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plans(spark: SparkSession, rows: list = PLANS) -> DataFrame:
    return spark.createDataFrame(rows, "id string, name string, price bigint, credits int, days int")


def plan_price(price: Column) -> Column:
    """What a plan is sorted by: one without a price goes as 0."""
    return F.coalesce(price, F.lit(0))


def plans_by_price(plans: DataFrame) -> DataFrame:
    """Plans by rising price."""
    return plans.orderBy(plan_price(F.col("price")), "id")


def looked_up(key: Column, values: dict) -> Column:
    """The value of a key in a short fixed dictionary; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def upload(files: DataFrame, name_list: Column) -> DataFrame:
    """files with the names of a form's JSON list; anything but a list of strings gives none."""
    return files.withColumn("names", string_list(name_list))


def layer_text(pages: Column) -> Column:
    """The text of a document's pages, each an array of items: items joined by spaces, pages by newlines."""
    return F.array_join(F.transform(pages, lambda p: F.array_join(p, " ")), "\n")


def form(body: Column) -> Column:
    """A url-encoded form as a map; of a repeated key the first value."""
    pairs = F.filter(F.transform(F.split(body, "&"), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"))), lambda x: x["k"] != "")
    keys = F.transform(pairs, lambda x: x["k"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1))


def body(content_type: Column, raw: Column) -> Column:
    """A request's body as a map of strings: a form if it says so, else JSON, else nothing."""
    return F.when(content_type.contains("application/x-www-form-urlencoded"), form(raw)).otherwise(F.from_json(raw, "map<string,string>"))


def data_url(url: Column) -> Column:
    """struct(mime, content) of a base64 data URL; the type defaults to octet-stream."""
    mime = F.coalesce(F.nullif(F.regexp_extract(url, "^data:([^;,]*)", 1), F.lit("")), F.lit("application/octet-stream"))
    return F.struct(mime.alias("mime"), F.unbase64(F.element_at(F.split(url, ","), -1)).alias("content"))


def with_types(urls: Column, mimes: Column) -> Column:
    """Non-empty URLs with their own types: paired before filtering, so places can't shift."""
    both = F.arrays_zip(urls.alias("url"), mimes.alias("mime"))
    return F.filter(both, lambda x: F.coalesce(x["url"], F.lit("")) != "")


def accepted(files: DataFrame, mime: str = "mime") -> DataFrame:
    return files.where(F.col(mime).isin(*ACCEPTED))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event lines of a finished stream; malformed ones drop out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with the fields of their events and `malformed`: the text of a line that is no event, else null. No line is lost."""
    e = F.from_json(value, f"{EVENT}, malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    fields = [f.name for f in _parse_datatype_string(EVENT).fields]
    kept = [c for c in lines.columns if c != value]
    e = lines.select(*kept, value, e.alias("_e"))
    bad = F.coalesce("_e.malformed", F.when(F.coalesce(*[F.col(f"_e.{f}").cast("string") for f in fields]).isNull(), F.col(value)))
    return e.select(*kept, *[F.col(f"_e.{f}").alias(f) for f in fields], bad.alias("malformed"))


def joined_pages(df: DataFrame, keys: list[str], pos: str, text: str, separator: str) -> DataFrame:
    """(keys..., text): the texts of each key in order with a separator."""
    pages = F.array_sort(F.collect_list(F.struct(pos, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pages, lambda p: p[text]), separator).alias("text"))
