"""Spelling variants: words one edit apart, found by bands of letter parities, and the chains of forms that they make.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted or deleted letter flips
one bit, one replaced letter at most two. Cut into three bands, the masks of two near words of equal length agree in at least
one band, those of words whose lengths differ by one in exactly two. Words meet in an equi-join over such bands and lengths;
words of equal length also over an equal first or last letter, as one edit leaves one end as it is. Candidates whose masks
differ in more than two bits go, and the edit distance is computed for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import LOWER, UPPER, stored, table

#: The least length of a word and the least number of its occurrences.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
FACTOR = 5
#: One in so many runs loses a letter.
DROP_EVERY = 199
#: Words of one join key that are compared as one part; larger keys are split on one side.
PART = 4000
#: Bits of a mask: 26 for a to z, the others for the letters from U+00C0 to U+00FF, some of which share a bit.
BITS = 63


def _lower_ascii(text: Column) -> Column:
    """Lower case of A-Z alone. Most words are in lower case already, which lower() shows faster than translate()."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, UPPER, LOWER))


def counted_words(docs: DataFrame, every: int = DROP_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of docs(doc_id, text) of at least least_length letters and least_count occurrences.

    A run is a maximal sequence of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. Where `every` divides the run's
    crc32(`<doc_id>:<run>`), the letter at crc32 % length is left out; a run without doc_id keeps all its letters. A null or
    empty text has no runs; texts and runs of any length are taken whole; every row counts, repeated ones too."""
    # a shorter run can't become a word, as letters only drop out
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", _lower_ascii(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A bit for each letter, set if it occurs an odd number of times."""
    def bit(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 128, code - 97).otherwise(26 + F.pmod(code - 192, F.lit(BITS - 26)))

    one = F.lit(1).cast("long")
    # shiftleft takes a literal number of places in Python, but a column's in SQL
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", one, bit(c).cast("int")))))


def bands(words: DataFrame) -> list[int]:
    """Three disjoint masks over all bits, of about equal entropy over all words(mask): buckets are then about equally fine.

    The entropy of each bit's parity is taken from one row of counts; bits go to the band with the least so far."""
    odd = [F.sum(F.call_function("shiftright", F.col("mask"), F.lit(i)).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(BITS)]
    row = words.agg(F.count("*").alias("n"), *odd).first()
    share = [(row[f"b{i}"] or 0) / max(1, row["n"]) for i in range(BITS)]
    entropy = [-sum(p * math.log2(p) for p in (s, 1 - s) if p > 0) for s in share]
    masks, total = [0, 0, 0], [0.0, 0.0, 0.0]
    for i in sorted(range(BITS), key=lambda i: (-entropy[i], i)):
        k = total.index(min(total))
        masks[k] |= 1 << i
        total[k] += entropy[i] + 1e-6  # bits that never vary are dealt out as well
    return masks


def _keys(words: DataFrame, cut: list[int], longer: bool) -> DataFrame:
    """(key, kind, mask, word): a row for each join key of each word; longer: as the longer one of words of unequal length."""
    band = [F.col("mask").bitwiseAND(F.lit(b).cast("long")) for b in cut]
    n = F.length("word")
    same = [F.struct(F.lit(2 * i + s).alias("kind"), F.xxhash64(F.lit(2 * i + s), band[i], n, end).alias("key")) for i in range(3) for s, end in enumerate((F.left("word", F.lit(1)), F.right("word", F.lit(1))))]
    off = [F.struct(F.lit(6 + k).alias("kind"), F.xxhash64(F.lit(6 + k), band[i], band[j], n - int(longer)).alias("key")) for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))]
    return words.select(F.explode(F.array(*same, *off)).alias("k"), "mask", "word").select("k.key", "k.kind", "mask", "word")


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, b): each pair of words(word) that differ by one inserted, deleted or replaced letter, once, in either order.

    Every such pair is found: see the module. A key of more than `part` words is split: its words are dealt to parts on the
    one side and stand in each part on the other, so that no task compares more than `part` of them with the key's others."""
    w = words.select("word", parity_mask(F.col("word")).alias("mask"))
    cut = bands(w)
    left, right = _keys(w, cut, False), _keys(w, cut, True)
    big = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part).select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    a = left.join(big, "key", "left").select("key", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), "kind", F.col("mask").alias("a_mask"), F.col("word").alias("a"))
    b = right.join(big, "key", "left").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("mask").alias("b_mask"), F.col("word").alias("b"))
    flips = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask")))
    differ = lambda i: F.col("a_mask").bitwiseXOR(F.col("b_mask")).bitwiseAND(F.lit(cut[i]).cast("long")) != 0
    # a pair of equal length counts where its first equal band and end meet
    band, last = F.floor(F.col("kind") / 2), F.col("kind") % 2 == 1
    here = F.when(band == 0, True).when(band == 1, differ(0)).otherwise(differ(0) & differ(1)) & (~last | (F.left("a", F.lit(1)) != F.left("b", F.lit(1))))
    alike = F.when(F.col("kind") < 6, (flips <= 2) & (F.col("a") < F.col("b")) & here & (F.length("a") == F.length("b"))).otherwise((flips == 1) & (F.length("a") + 1 == F.length("b")))
    met = a.join(b, ["key", "part"]).where(alike & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b")


def grouped_variants(words: DataFrame, factor: int = FACTOR, part: int = PART) -> DataFrame:
    """words(word, n) with form, root, n_near, form_n.

    A form is the near word of largest n, the smallest in code-point order of equal ones, if it occurs at least `factor` times
    as often as the word. The root is the last of the forms from word to form to form; without a form it is the word."""
    w = stored(words.select("word", "n"))
    pairs = near_pairs(w, part).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    rated = pairs.join(w.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = rated.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    often = -F.col("best.n") >= factor * F.col("n")
    out = w.join(best, "word", "left").select("word", "n", F.when(often, F.col("best.word")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, -F.col("best.n")).alias("form_n"))
    out = stored(out)
    links = out.where("form is not null").select("word", F.col("form").alias("to"))
    while True:  # each turn doubles the way that a link covers; the way is short, as n rises by the factor at each step
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        links = stored(links.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "to")
    return out.join(links.select("word", F.col("to").alias("_to")), "word", "left").select("word", "n", "form", F.coalesce("_to", "word").alias("root"), "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of documents with its near words' number, form and root. An empty table gives no rows."""
    return grouped_variants(counted_words(table(spark, sf_dir, "documents")))


#: The byte-wise crc32 by a table of 256 steps, as lists; words one edit apart share what is left without one letter.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs GROUP BY 1, 2),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM each, crc),
w AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, v.word FROM cut AS a JOIN v ON a.d = v.word UNION SELECT v.word, a.word FROM cut AS a JOIN v ON a.d = v.word),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS most, arg_min(other, (-o.n, other)) AS other FROM near JOIN v AS o ON o.word = other GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FACTOR} * v.n THEN best.other END AS form, CASE WHEN most >= {FACTOR} * v.n THEN most END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
r AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.nxt)
SELECT f.word, n, form, root, n_near, form_n FROM f JOIN (SELECT word, root FROM r WHERE nxt IS NULL) AS x ON x.word = f.word"""
