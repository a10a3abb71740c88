"""Text Column builders."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; trim() alone removes spaces only.
BLANK = r"[ \t\n\r\f\x0b]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def normal_key(text: Column) -> Column:
    return F.upper(strip(text))


def normalise_answer(text: Column, item: Column, mode: Column) -> Column:
    """struct(text, confidence): what a closed answer says, by the first rule that fits.

    Choice items (SM, or a bare number, or mode sm_vf): a letter A-E, sure if it stands alone. True or false (VF): V or F.
    Matching (TP, or mode terminos_pareados): the first number anywhere. Else a leading A-F or number, unsure."""
    t = normal_key(F.coalesce(text, F.lit("")))
    q, m = F.upper(F.coalesce(item, F.lit(""))), F.coalesce(mode, F.lit(""))
    answer = lambda value, sure: F.struct(value.alias("text"), sure.alias("confidence"))
    high, low = F.lit("high"), F.lit("low")
    by_length = F.when(F.length(t) > 1, low).otherwise(high)
    choice = (m == "sm_vf") | q.contains("SM") | q.rlike("^[0-9]+$")
    truth, matching = (m == "sm_vf") | q.contains("VF"), (m == "terminos_pareados") | q.contains("TP")
    marked, letter, vf = (F.regexp_extract(t, p, 1) for p in (r"^([A-E])[ \t\n\r\f\x0b):(.]", "^([A-E])", "^([VF])"))
    number, rest = F.regexp_extract(t, "([0-9]+)", 1), F.regexp_extract(t, "^([A-F]|[0-9]+)", 1)
    return (
        F.when(t == "", answer(F.lit("SIN_RESPUESTA"), low))
        .when(choice & (marked != ""), answer(marked, high))
        .when(choice & (letter != ""), answer(letter, by_length))
        .when(truth & (vf != ""), answer(vf, by_length))
        .when(matching & (number != ""), answer(number, high))
        .when(rest != "", answer(rest, low))
        .otherwise(answer(F.lit("SIN_RESPUESTA"), low))
    )


def needs_review(item: Column, given: Column, right: Column) -> Column:
    """Whether a person should look at a closed answer: wrong, noisy, of the wrong kind for its item, or blank."""
    g, r = normal_key(F.coalesce(given, F.lit(""))), normal_key(F.coalesce(right, F.lit("")))
    wrong = (g != "") & (r != "") & (g != r)
    odd = (item.contains("VF") & ~g.isin("V", "F")) | (item.contains("TP") & ~g.rlike("^[+-]?[0-9]")) | (item.contains("SM") & ~g.isin("A", "B", "C", "D", "E"))
    return wrong | (F.length(g) > 2) | odd | (g == "")


def strip_marks(text: Column) -> Column:
    """Without mark blocks, each from its tag to the end of the line."""
    return F.regexp_replace(text, r"(?s)\[OMR_MARK\].*?\n", "")


def strip_html(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), f"{BLANK}+", " "))


def clean_control(text: Column) -> Column:
    """Without ASCII control characters, blanks collapsed; a dash for nothing."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x1F\\x7F]", ""), " +", " ")
    return F.coalesce(F.nullif(strip(t), F.lit("")), F.lit("—"))


def student_name(text: Column, known: Column) -> Column:
    """The known name; else one that the text gives after a word for student or before a verb; else a default phrase."""
    word = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
    # fixed phrases of the texts in question; a name ends before the first verb, though a later word may begin like one
    after = rf"(?i)(?:el estudiante|la estudiante|alumno|alumna)\s+({word}(?:\s+{word})*)"
    before = rf"(?i)^({word}(?:\s+{word}){{1,3}}?)\s+(?:demuestra|muestra|presenta|tiene)"
    given = F.when((strip(known) != "") & (known != "Estudiante"), known)
    found = [F.nullif(strip(F.regexp_extract(text, p, 1)), F.lit("")) for p in (after, before)]
    return F.coalesce(given, *found, F.lit("El estudiante"))


def prefixed_feedback(text: Column, known: Column) -> Column:
    """The feedback with the student's name before it, unless it speaks of the student already."""
    plain = F.lower(text)
    own = plain.contains("el estudiante") | plain.contains("la estudiante")
    return F.when(own, text).otherwise(F.concat(student_name(text, known), F.lit(" "), F.lower(F.left(text, F.lit(1))), F.substring(text, 2, 2147483647)))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "_")


def label(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def line_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def plan_of_subject(subject: Column, prefix: str) -> Column:
    """The plan named by a payment's subject, `<prefix><plan>`, in lower case; null otherwise."""
    return F.nullif(F.lower(F.regexp_extract(subject, f"(?i)^{prefix}([a-z0-9_-]+)$", 1)), F.lit(""))


def without_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def repaired_url(url: Column, version: str = "/v1", default: str = "https://api.mistral.ai/v1") -> Column:
    """A configured address without link markup and quotes, with a scheme and ending in the version; the default where there is none or it has no host."""
    u = strip(F.regexp_replace(F.regexp_replace(strip(url), r"^\[[^\]]*\]\(([^)]*)\)$", "$1"), "[\"'`]", ""))
    u = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
    u = F.when(u.endswith(version), u).otherwise(F.concat(F.regexp_replace(u, "/$", ""), F.lit(version)))
    return F.when((F.coalesce(url, F.lit("")) != "") & u.rlike(r"^https?://[^\s/?#\[\]()<>]+(?:[/?#]\S*)?$"), u).otherwise(F.lit(default))


def masked_secret(secret: Column) -> Column:
    return F.concat(F.left(secret, F.lit(6)), F.lit("…"), F.right(secret, F.lit(4)))


def shortened(text: Column, most: int = 500) -> Column:
    return F.left(text, F.lit(most))


def score_parts(score: Column) -> Column:
    """struct(obtained, maximum) of `n/m`."""
    return F.struct(F.split_part(score, F.lit("/"), F.lit(1)).alias("obtained"), F.split_part(score, F.lit("/"), F.lit(2)).alias("maximum"))


def percent_encoded(text: Column) -> Column:
    """All but letters, digits and -_.!~*'() as %XX of the UTF-8 bytes."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def query_string(params: Column, collation: str = "UNICODE") -> Column:
    """A map as key=value pairs, percent-encoded, in the order that the collation gives the keys: letters before case and accents."""
    ranked = F.array_sort(F.transform(F.map_entries(params), lambda e: F.struct(F.collate(e["key"], collation).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(ranked, lambda e: F.concat(percent_encoded(e["k"]), F.lit("="), percent_encoded(e["v"]))), "&")


def key_pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and outer block of a keyed SHA-256."""
    key = secret.encode()
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def signed(text: Column, secret: str) -> Column:
    """The hex HMAC-SHA256 of a text. The key's blocks stand in the plan, as a literal secret would."""
    inner, outer = (F.lit(p) for p in key_pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def valid_email(text: Column, rule: str = "strict") -> Column:
    """strict: one @ and a dotted host, anchored; loose: the same anywhere; basic: longer than three with an @."""
    core = rf"[^ \t\n\r\f\x0b@]+@[^ \t\n\r\f\x0b@]+\.[^ \t\n\r\f\x0b@]+"
    return {"strict": text.rlike(f"^{core}$"), "loose": text.rlike(core), "basic": (F.length(text) > 3) & text.contains("@")}[rule]


def readable_type(mime: Column) -> Column:
    """Whether a file's type can be read as text: images, PDF, office documents, spreadsheets."""
    return mime.startswith("image/") | (mime == "application/pdf") | mime.contains("officedocument") | mime.contains("spreadsheetml")


def photo_type(mime: Column) -> Column:
    return mime.isin("image/jpeg", "image/png", "image/webp")
