"""Duplicates hidden by formatting: progressive refinement of classes from cheap invariants to a canonical key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import drop, materialise

_INVISIBLE = "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]"
_BLANK = "[\\s\\u0085\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u3000]"
#: What canonical() deletes: all but letters, digits, math operators, a minus before a digit, a point or comma
#: between two digits. Emphasis stars and list marks are punctuation, a star between operands is an operator.
_DELETED = "|".join(
    (
        r"[.,](?!\d)",
        r"(?<!\d)[.,]",
        r"(?m:^)" + _BLANK + "{0,8}[-*•]" + _BLANK + "+",
        r"-(?!" + _BLANK + r"{0,2}\d)",
        r"(?<![\p{L}\p{N})\]}$]" + _BLANK + r"{0,2})-(?=" + _BLANK + ")",
        r"\*{2,}",
        r"(?<![\p{L}\p{N})\]}]" + _BLANK + r"{0,2})\*",
        r"\*(?!" + _BLANK + r"{0,2}[\p{L}\p{N}(\[{\\])",
        r"(?<=[\p{L}\p{N})\]}])\*(?=" + _BLANK + ")",
        r"(?<=" + _BLANK + r")\*(?=[\p{L}\p{N}(\[{\\])",
        r"[^\p{L}\p{N}\p{M}.,\-+=×÷^<>/*%±≤≥≠√]",
    )
)
#: Letters that no JSON escape needs, and digits.
_LETTERS, _DIGITS = "shiolmy", "1379"


def _visible(value: Column) -> Column:
    """Lower case without invisible characters; a JSON object with sorted keys and plain characters."""
    text = F.lower(F.regexp_replace(value, _INVISIBLE, ""))
    spaced = F.trim(F.regexp_replace(text, _BLANK + "+", " "))
    plain = F.to_json(F.try_parse_json(spaced))
    # an escape may stand for a capital, in a key too: lowered and sorted again
    again = F.to_json(F.try_parse_json(F.lower(plain)))
    sorted_ = F.when(F.contains(spaced, F.lit("\\u")), again).otherwise(plain)
    return F.when(value.rlike(r"(?s)^\W*?\{.*\}\W*$"), F.coalesce(sorted_, text)).otherwise(text)


def canonical(value: Column) -> Column:
    """Two values are the same but for white space, case, punctuation or JSON key order if this agrees."""
    return F.regexp_replace(F.regexp_replace(_visible(value), "−", "-"), _DELETED, "")


def invariants(value: Column) -> Column:
    """A hash of letter and digit counts that formatting can't change, far cheaper than canonical()."""
    # only what may be a JSON object has escapes to resolve; invisible characters and blanks are no letters
    text = F.when(value.rlike(r"^\W*?\{"), _visible(value)).otherwise(F.lower(value))
    counts = [F.length(F.replace(text, F.lit(c), F.lit(""))) - F.length(text) for c in _LETTERS + _DIGITS]
    return F.xxhash64(value.isNull(), *counts)


#: The level-one keys of several members are kept in at most 2**FILTER_BITS bits, 64 a row, and sent to every task.
FILTER_BITS = 26


def _classed(rows: DataFrame, fields: tuple[str, ...], name: str) -> DataFrame:
    """rows with name, the canonical key of their fields; null where the cheap invariants stand alone.

    A bitmap tells which rows share their invariants with others, so the costly key is computed while the table is read
    again and no text is shuffled. A row that passes by chance has a key of its own, which does no harm.
    """
    level1 = F.xxhash64(*[invariants(F.col(f)) for f in fields])
    cheap = materialise(rows.select(level1.alias("level1")), "invariants")
    shared = materialise(cheap.groupBy("level1").agg(F.count("*").alias("n")).where("n > 1").select("level1"), "shared")
    drop(cheap)
    size = min(FILTER_BITS, max(10, (16 * shared.count()).bit_length()))
    slot = lambda h: F.shiftrightunsigned(h, 64 - size + 6)
    bit = "shiftleft(1L, cast(pmod({0} >> " + str(64 - size) + ", 64) as int))"
    # 2 ** FILTER_BITS / 64 rows at most
    bits = shared.select(slot("level1").alias("__slot"), F.expr(bit.format("level1")).alias("bit")).groupBy("__slot").agg(F.bit_or("bit").alias("__bits"))
    marked = rows.withColumn("__level1", level1).withColumn("__slot", slot(F.col("__level1"))).join(F.broadcast(bits), "__slot", "left")
    sure = F.md5(F.concat_ws("\u0001", *[F.coalesce(canonical(F.col(f)), F.lit("\u0002")) for f in fields]))
    return marked.withColumn(name, F.when(F.expr(f"__bits & {bit.format('__level1')}") != 0, sure)).drop("__level1", "__slot", "__bits")


def formatting_copies(rows: DataFrame, key: str = "pair_id", fields: tuple[str, ...] = ("prompt", "chosen", "rejected"), salts: int = 16) -> DataFrame:
    """key, keep_id, copies: each record with the smallest key of its class and the number of records in it.

    Only records of classes of several members are returned; collapse() keeps one record for each class. Every field
    must agree; null agrees only with null. The first level groups by hashes of letter and digit counts, the second,
    inside classes of several members only, by an MD5 of the canonical fields. Classes are counted before any join, and
    the join back is salted, so a class of a third of all rows is spread over tasks. Extra columns are ignored; a key
    that stands twice is two records.
    """
    classed = _classed(rows.select(F.col(key).alias("id"), *fields), fields, "level2")
    level2 = materialise(classed.where("level2 is not null").select("id", "level2"), "canonical")
    found = _members(level2, "level2", salts)
    return found.select(F.col("id").alias(key), F.col("least").alias("keep_id"), F.col("n").alias("copies"))


def _members(rows: DataFrame, level: str, salts: int) -> DataFrame:
    """id, least, n of the rows whose class at this level has several members."""
    classes = rows.groupBy(level).agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    # classes of few members need no salt: theirs is 0 on both sides
    spread = classes.withColumn("salt", F.explode(F.when(F.col("n") > 1000 * salts, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    hot = classes.where(F.col("n") > 1000 * salts).select(level, F.lit(True).alias("hot"))
    # there are at most rows / (1000 * salts) hot classes; the count is read off the written files' footers
    few = rows.count() // (1000 * salts) < 1_000_000
    marked = rows.join(F.broadcast(hot) if few else hot, level, "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("id"), F.lit(salts))).otherwise(F.lit(-1)))
    return salted.join(spread, [level, "salt"]).select("id", "least", "n")


def collapse(rows: DataFrame, key: str = "pair_id", fields: tuple[str, ...] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """rows with one record of each class, and copies, the number of records that it stands for.

    The record of the smallest key is kept, a null key counting as the largest and equal keys being told apart by their
    fields, so repeated rows leave one. Classes are combined before they are shuffled, so one of a third of all rows
    weighs a row a task. A column copies of the input gives way to this one.
    """
    kept = [c for c in rows.columns if c != "copies"]
    classed = _classed(rows.select(*kept), fields, "__class")
    alone = classed.where("__class is null").select(*kept, F.lit(1).cast("bigint").alias("copies"))
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*fields))
    one = classed.where("__class is not null").groupBy("__class").agg(F.min_by(F.struct(*kept), order).alias("__row"), F.count("*").alias("copies"))
    return alone.unionByName(one.select("__row.*", "copies"))
