"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

The terms of a document are its words, their weights the number of times they occur. For each of K samples
a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of itself and the sample's number alone, and with

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1)

the sample is the (term, t) of least a. Two documents get the same sample with a probability equal to their
generalised Jaccard similarity, sum of min(w, w') over sum of max(w, w'). r and b come from two uniform
numbers as r = -ln(u v) and b = ln v / ln(u v): the sum of two exponential draws is Gamma(2, 1), and their shares
of it are uniform and independent of it. Then a = c u (u v)^t, and t is the greatest for which w u^t v^(t-1) >= 1,
or 0: most samples need one logarithm, that of c. a itself names the sample, so the least is a plain ``min`` of a
double, which hash aggregation keeps in place.

Texts are shuffled once by id; terms, weights and samples are then made within that partitioning, so the
(document, term) rows never leave their task, and a document's terms are not gathered in a row.

Defined cases: null text is empty; a text without words has the empty fingerprint, which is like itself (1)
and unlike others (0); the text after the last is the first; rows that share a ``doc_id`` have the same next
document, the least text of the next id, and are compared with its least fingerprint; equal rows each give a
row; a row with a null id has no next document: its edited text lacks the last quarter and ``near_next`` is 0;
ids are integers, since the next document is that of the next id, and other ids are an error; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import id_and_text, sha256_hex, written

#: Parameters: samples, those that one row makes, and bits of id that one window over ids spans.
SAMPLES, PER_ROW, BUCKET_BITS = 64, 4, 12
SAMPLE_BITS = 20
#: Fixed value of the contracts: the white space between words.
BETWEEN_WORDS, LAST_WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]*\z"


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the next larger id, and after the largest the smallest.

    Ids go into buckets of 2 ** BUCKET_BITS, buckets into buckets of buckets: at each level a window leads
    from the last id of a node to the first of the next, so no window holds more than 2 ** BUCKET_BITS rows."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    least, most = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    empty = ids.select("doc_id", F.col("doc_id").alias("next_id")).where(F.lit(False))
    if least is None:
        return empty
    nodes = ids.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("first"), F.col("doc_id").alias("last"))
    pairs, shift = empty, 0
    while True:
        top = (most >> shift) - (least >> shift) < 1 << BUCKET_BITS
        bucket = F.lit(0).cast("long") if top else F.shiftright("node", BUCKET_BITS)
        nodes = nodes.withColumn("bucket", bucket)
        lead = nodes.select(F.col("last").alias("doc_id"), F.lead("first").over(Window.partitionBy("bucket").orderBy("node")).alias("next_id"))
        pairs = pairs.unionByName(lead.where("next_id is not null"))
        if top:
            return pairs.unionByName(ids.agg(F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("next_id")))
        nodes = nodes.groupBy("bucket").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumnRenamed("bucket", "node")
        shift += BUCKET_BITS


def edited(rows: DataFrame, following: DataFrame) -> DataFrame:
    """Adds ``edited``: the last quarter of the text is replaced by the start of the next document's.

    Only the characters asked for travel from the next document to the row."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    need = rows.groupBy("doc_id").agg(F.max(quarter).alias("need"))
    asked = following.join(need, "doc_id").select(F.col("doc_id").alias("_to"), F.col("next_id").alias("_from"), "need")
    starts = rows.join(asked, F.col("doc_id") == F.col("_from")).select("_to", F.substr("text", F.lit(1), F.col("need")).alias("_start"))
    starts = starts.groupBy("_to").agg(F.min("_start").alias("_start"))
    own = F.substr("text", F.lit(1), F.length("text") - quarter)
    # every id has a next one: as inner joins both read the one shuffle of the texts by id
    both = rows.join(starts, F.col("doc_id") == F.col("_to"))
    return both.select("doc_id", "text", F.concat(own, F.coalesce(F.substr("_start", F.lit(1), quarter), F.lit(""))).alias("edited"))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift else bits.bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def draws(term: Column, number: Column, name: str) -> list[Column]:
    """What the sample of a number needs of a hashed term: u, c u and u v, none of them ever null."""
    one, two = F.xxhash64(term, number * 2), F.xxhash64(term, number * 2 + 1)
    u, v = _uniform(one, 0, 21), _uniform(two, 0, 32)
    # log() counts as nullable, and so would all that is made of it
    c = -F.coalesce(F.log(_uniform(one, 21, 21) * _uniform(one, 42, 22)), F.lit(0.0))
    return [u.alias(f"u{name}"), (c * u).alias(f"c{name}"), (u * v).alias(f"x{name}")]


def sample(name: str, weight: str) -> Column:
    """a; null without a weight. Term, t and sample number alone make it, so an equal least is an equal sample."""
    w, u, first, x = (F.col(c) for c in (weight, f"u{name}", f"c{name}", f"x{name}"))
    # t is 0 or 1 for most, and not less than 2 below, however the quotient is rounded: each t has one formula
    t = F.greatest(F.lit(2.0), F.floor(F.log(w * u) / -F.log(x)) + 1.0)
    return F.when(w * u < 1.0, F.when(w > 0, first)).when(w * u * x < 1.0, first * x).otherwise(first * F.pow(x, t))


def _hex(least: Column) -> Column:
    """Some bits of a hash of each sample as one string of hexadecimal digits; empty if there are none."""
    bits = lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))
    return F.array_join(F.transform(F.filter(least, lambda x: x.isNotNull()), lambda x: F.lpad(F.lower(F.hex(bits(x))), SAMPLE_BITS // 4, "0")), "")


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    digits = SAMPLE_BITS // 4
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    equal = F.size(F.filter(at, lambda k: F.substr(one, k * digits + 1, F.lit(digits)) == F.substr(other, k * digits + 1, F.lit(digits))))
    return F.when((one == "") | (other == ""), F.when(one == other, 1.0).otherwise(0.0)).otherwise(equal / samples)


def fingerprints(pairs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For rows ``doc_id, text, edited``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint``."""
    key = ["doc_id", "key"]
    rows = pairs.withColumn("key", F.xxhash64("text", F.lit(1), "edited"))
    rows = rows.groupBy(*key).agg(F.first("text").alias("text"), F.first("edited").alias("edited"), F.count(F.lit(1)).cast("int").alias("copies"))
    # all that a row keeps is part of the grouping keys: fixed-width sums alone can be added up in a hash table
    kept = [*key, "copies", "n_chars", "edited_sha"]
    rows = rows.select(*key, "copies", F.length("text").cast("long").alias("n_chars"), F.unhex(sha256_hex(F.col("edited"))).alias("edited_sha"), "text", "edited")
    # the words before the last white space of what the texts share are split and counted once for both
    shared = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    shared = shared - F.length(F.regexp_extract(F.substr("text", F.lit(1), shared), LAST_WORD, 0))
    part = lambda text, in_text, in_edited: F.struct(text.alias("text"), F.lit(in_text).alias("in_text"), F.lit(in_edited).alias("in_edited"))
    rest = lambda c: F.substr(c, F.col("shared") + 1, F.length(c))
    parts = rows.withColumn("shared", shared).select(
        *kept, F.explode(F.array(part(F.substr("text", F.lit(1), F.col("shared")), 1, 1), part(rest("text"), 1, 0), part(rest("edited"), 0, 1))).alias("x")
    )
    words = parts.select(*kept, F.col("x.in_text").alias("in_text"), F.col("x.in_edited").alias("in_edited"), F.explode(F.split("x.text", BETWEEN_WORDS)).alias("word"))
    occurs = lambda c: F.sum(F.when(F.col("word") != "", F.col(c)).otherwise(0))
    counted = words.groupBy(*kept, F.xxhash64("word").alias("term")).agg(occurs("in_text").alias("w0"), occurs("in_edited").alias("w1"))
    # a row takes PER_ROW samples: few columns, so that generated code stays small enough to be compiled well
    rounds = F.explode(F.array(*map(F.lit, range(samples // PER_ROW))))
    numbered = counted.select(*kept, "term", *(F.col(w).cast("double").alias(w) for w in ("w0", "w1")), rounds.alias("round"))
    drawn = numbered.select(*kept, "round", "w0", "w1", *(x for k in range(PER_ROW) for x in draws(F.col("term"), F.col("round") * PER_ROW + k, str(k))))
    least = drawn.groupBy(*kept, "round").agg(*(F.min(sample(str(k), weight)).alias(f"{side}{k}") for side, weight in (("s", "w0"), ("e", "w1")) for k in range(PER_ROW)))
    some = F.struct("round", *(F.array(*(F.col(f"{side}{k}") for k in range(PER_ROW))).alias(side) for side in "se"))
    whole = least.groupBy(*kept).agg(F.sort_array(F.collect_list(some)).alias("all"))
    out = whole.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        _hex(F.flatten(F.transform("all", lambda x: x["s"]))).alias("fingerprint"),
        _hex(F.flatten(F.transform("all", lambda x: x["e"]))).alias("edited_fingerprint"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"),
    )
    return out.drop("_copy")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row per input row."""
    rows = id_and_text(docs, id_col, text_col)
    if not isinstance(rows.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"ids are integers, {id_col!r} is of type {rows.schema['doc_id'].dataType.simpleString()}")
    following = written(next_ids(rows.select("doc_id")), "next")
    found = fingerprints(edited(rows, following), samples)
    alone = rows.where("doc_id is null")
    if not alone.isEmpty():
        kept = F.substr("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 4).cast("int"))
        found = found.unionByName(fingerprints(alone.select("doc_id", "text", kept.alias("edited")), samples))
    found = written(found, "fingerprints")
    others = following.join(found.groupBy("doc_id").agg(F.min("fingerprint").alias("_fp")).withColumnRenamed("doc_id", "next_id"), "next_id")
    joined = found.join(others.select(F.col("doc_id").alias("_id"), "_fp"), F.col("doc_id") == F.col("_id"), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("_fp"), samples), F.lit(0.0)).alias("near_next"),
    )
