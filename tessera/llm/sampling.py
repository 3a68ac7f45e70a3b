"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words in lower case, of weight w = 1 + ln(count). In each of SLOTS samples every term draws,
from hashes of itself and the sample, r and c from Gamma(2, 1) and b, evenly from (0, 1). With
t = floor(ln(w) / r + b) and y = exp(r (t - b)), the sample is the term of the least a = c / (y exp(r)), with its t.
Two documents have the same sample (term and t) with a probability of the generalised Jaccard similarity of their
weights, so the share of equal samples estimates it without bias.

r is drawn as the sum of two exponential variables, of which b is the second one's share: then r and b are as above, and
for w = 1 (most words of a text) a = c u for an even u. So most draws that can't be the least are known by two
products: those above DEEP / (distinct words) are left out. As a is exponential with rate w, and weights sum up to the
number of distinct words at least, no draw is left in a sample with a probability of exp(-DEEP) at most (1e-7); such a
sample has no value then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

SLOTS = 64
#: Documents of neighbouring ids that are sorted together, at about; more where there would be more than BUCKETS groups.
NEIGHBOURS, BUCKETS = 256, 100_000
#: Documents that a task should get at about, as far as 8 times the shuffle partitions allow.
TASK_DOCS = 800
LOWEST = -(1 << 63)
DEEP = 16.0


def _floored(at: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftleft", F.call_function("shiftright", at, bits), bits)


class Buckets:
    """Ranges of ids (at) with some NEIGHBOURS documents each, however uneven the ids are: ranges with many more are cut
    into finer ones, and an id with many documents into ranges of a hash of their texts."""

    def __init__(self, rows: DataFrame):
        span = rows.agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).first()
        self.n = span.n
        self.per_bucket = max(NEIGHBOURS, -(-span.n // BUCKETS))
        even = (span.high - span.low + 1) * self.per_bucket // span.n if span.n else 1
        self.levels: list[tuple[int, DataFrame | None]] = [(min(62, max(0, even.bit_length() - 1)), None)]
        self.hot_ids: DataFrame | None = None
        while span.n:
            bits = self.levels[-1][0]
            many = self.of(rows).groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") > 16 * self.per_bucket)
            many = common.stored(many.select("start", F.lit(True).alias("many")), "ranges")
            if many.isEmpty():
                break
            if not bits:
                self.hot_ids = many
                break
            self.levels.append((max(0, bits - 8), many))

    def of(self, rows: DataFrame, hashed: bool = False) -> DataFrame:
        """rows(at, ...) with start, the least id of the range; with hashed, sub too, of rows(mark), the hash of a text."""
        out = rows.withColumn("start", _floored(F.col("at"), self.levels[0][0]))
        for bits, many in self.levels[1:]:
            out = out.join(common.small(many), "start", "left").withColumn("start", F.when(F.col("many"), _floored(F.col("at"), bits)).otherwise(F.col("start"))).drop("many")
        if hashed and self.hot_ids:
            return out.join(common.small(self.hot_ids), "start", "left").withColumn("sub", F.when(F.col("many"), F.shiftright("mark", 48).cast("int")).otherwise(0)).drop("many")
        return out.withColumn("sub", F.lit(0)) if hashed else out


def with_next(docs: DataFrame) -> DataFrame:
    """Rows start, sub, place, copy, doc_id, text, next: each document with the text of the next one in descending
    order of doc_id; after the last comes the first. Null ids come last; of one id, rows come by a hash of their texts.

    Documents are dealt by ranges of ids; the first one of a range is copied (copy = 1) to the range that
    comes before it, so that one exchange brings all neighbours together.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(LOWEST)))
    buckets = Buckets(rows.select("at"))
    hot = buckets.hot_ids is not None
    rows = buckets.of(rows.withColumn("mark", F.xxhash64("text")), True)
    ids = (rows if hot else buckets.of(rows.select("at"), False).withColumn("sub", F.lit(0))).select("at", "start", "sub")
    tops = ids.groupBy("start", "sub").agg(F.max("at").alias("at"))
    # each range goes on to the one before it: of the next higher ids, and the highest to the lowest. Ranges are looked
    # at in areas of many, and areas by one row each, as few as there are thousands of ranges.
    wide = tops.withColumn("area", _floored(F.col("start"), min(62, buckets.levels[0][0] + 12)))
    first = F.min(F.struct("start", (-F.col("sub")).alias("down"))).alias("first")
    areas = wide.groupBy("area").agg(first).select("area", F.lead("first").over(Window.orderBy("area")).alias("next_area"))
    lowest = wide.agg(first)
    in_area = F.lead(F.struct("start", (-F.col("sub")).alias("down"))).over(Window.partitionBy("area").orderBy("start", F.desc("sub")))
    goes = wide.withColumn("in_area", in_area).join(areas, "area").crossJoin(F.broadcast(lowest)).withColumn("to", F.coalesce("in_area", "next_area", "first"))  # lowest is one row
    goes = common.stored(goes.select("start", "sub", "at", F.struct(F.col("to.start").alias("start"), (-F.col("to.down")).alias("sub")).alias("to")), "neighbours")
    # of several documents of the top id the first one is copied
    top = rows.join(F.broadcast(goes) if goes.count() <= common.BROADCAST_ROWS else goes, ["start", "sub", "at"]).groupBy("to").agg(F.min(F.struct("mark", "text")).alias("one"), F.max("at").alias("at"))
    copies = top.select("to.start", "to.sub", F.lit(1).alias("copy"), F.lit(None).cast("long").alias("doc_id"), "one.text", "at", "one.mark")
    parts = common.partitions(docs.sparkSession)
    parts = max(parts, min(8 * parts, -(-buckets.n // TASK_DOCS)))
    rows = rows.select("start", "sub", F.lit(0).alias("copy"), "doc_id", "text", "at", "mark").unionByName(copies).repartition(parts, "start", "sub")
    order = Window.partitionBy("start", "sub").orderBy("copy", F.desc("at"), "mark", "text")
    return rows.select("start", "sub", F.row_number().over(order).alias("place"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next"))


def _uniform(bits: Column, width: int) -> Column:
    """An even variable of (0, 1) from a number of so many bits."""
    return (bits + 0.5) * 2.0**-width


def samples(terms: DataFrame, by: list[str], hash_: str, count: str, distinct: str) -> DataFrame:
    """terms(by..., hash_, count, distinct) to by..., slot, sample: a slot's value in 24 bits. distinct is the number of
    hashes of the same document. A document without hashes gets slot null."""
    h, log_w = F.col(hash_), F.log1p(F.log(F.col(count).cast("double")))
    log_deep = F.log(F.lit(DEEP) / F.greatest(F.col(distinct), F.lit(1)))
    terms = terms.select(*by, h.alias("h"), h.isNull().alias("none"), log_w.alias("log_w"), log_deep.alias("log_deep"), F.exp(log_deep + log_w).alias("deep"), (F.col(count) == 1).alias("plain"))
    draws = terms.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("none"), 0).otherwise(SLOTS - 1))).alias("slot")).withColumn("bits", F.xxhash64("h", "slot"))
    bits = F.col("bits")
    u1, u2, u3 = _uniform(bits.bitwiseAND(F.lit(0xFFFFF)), 20), _uniform(F.shiftrightunsigned(bits, 20).bitwiseAND(F.lit(0xFFFFF)), 20), _uniform(F.shiftrightunsigned(bits, 40), 24)
    draws = draws.withColumn("u12", u1 * u2).withColumn("u3", u3)
    # c is at least 1 - u12, and a c u3 / w for a plain word
    draws = draws.where(F.col("none") | ~F.col("plain") | ((1 - F.col("u12")) * F.col("u3") < F.col("deep")))
    draws = draws.withColumn("u4", _uniform(F.shiftrightunsigned(F.xxhash64("bits"), 12), 52))
    # of other words y exp(r) is at most w / (u3 u4)
    draws = draws.where(F.col("none") | F.col("plain") | ((1 - F.col("u12")) * F.col("u3") * F.col("u4") < F.col("deep")))
    draws = draws.withColumn("e1", -F.log("u3")).withColumn("e2", -F.log("u4"))
    draws = draws.withColumn("r", F.col("e1") + F.col("e2"))
    draws = draws.withColumn("t", F.when(F.col("plain"), F.lit(0).cast("long")).otherwise(F.floor((F.col("log_w") + F.col("e2")) / F.col("r"))))
    # ln a = ln c - r (t - b) - r, in which r b = e2
    log_a = F.log(-F.log("u12")) - F.col("r") * F.col("t") - F.col("e1")
    draws = draws.withColumn("above", log_a - F.col("log_deep"))
    draws = draws.where(F.col("none") | (F.col("above") <= 0))
    value = F.xxhash64("h", "t").bitwiseAND(F.lit(0xFFFFFF))
    packed = F.shiftleft(F.greatest((F.col("above") + 64.0) * 2.0**32, F.lit(0.0)).cast("long"), 24).bitwiseOR(value)
    draws = draws.select(*by, F.when(~F.col("none"), F.col("slot")).alias("slot"), packed.alias("packed"))
    return draws.groupBy(*by, "slot").agg(F.min("packed").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("sample"))


def terms(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """by..., h, n, distinct: the words of each text by hash with their counts and the number of distinct ones, and one
    row with h null for every text."""
    # the space makes split() end with an empty string, so that a text without words has a row too
    split = rows.select(*by, F.split(F.concat(F.lower(text), F.lit(" ")), "[\\x20\\x09-\\x0D]+").alias("words"))
    # beside explode() it would be worked out for every word
    split = split.withColumn("distinct", F.size(F.array_distinct("words")) - 1)
    word = split.select(*by, "distinct", F.explode("words").alias("word"))
    return word.select(*by, "distinct", F.when(F.col("word") != "", F.xxhash64("word")).alias("h")).groupBy(*by, "distinct", "h").agg(F.count("*").alias("n"))


def likeness(x: str, y: str) -> Column:
    """Of two fingerprints as arrays of slot << 24 | sample: the share of equal samples. Two empty ones are alike."""
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def spelt(x: str) -> Column:
    return F.array_join(F.transform(F.sort_array(x), lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of op2 for docs(doc_id, text); a null text is empty. One row for every row, repeated ones too. Texts without
    words have an empty fingerprint. Long texts are taken whole; an empty table gives no rows; other columns aren't read.
    """
    near = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = near.withColumn("edited", F.when(F.col("copy") == 0, F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next").substr(F.lit(1), cut))))
    bodies = rows.select("start", "sub", "place", "copy", "doc_id", F.posexplode(F.when(F.col("copy") == 0, F.array("text", "edited")).otherwise(F.array("text"))).alias("which", "body"))
    # doc_id goes along only to make the exchange of texts the same as for base, so that it is used twice
    by = ["start", "sub", "place", "copy", "doc_id", "which"]
    drawn = samples(terms(bodies, by, "body"), by, "h", "n", "distinct")
    value = F.shiftleft("slot", 24).bitwiseOR(F.col("sample"))
    mine, other = (F.collect_list(F.when((F.col("which") == k) & F.col("slot").isNotNull(), value)).alias(name) for k, name in ((0, "mine"), (1, "other")))
    marks = drawn.groupBy("start", "sub", "place", "copy", "doc_id").agg(mine, other)
    order = Window.partitionBy("start", "sub").orderBy("place")
    marks = marks.withColumn("following", F.lead("mine").over(order)).where("copy = 0")
    marks = marks.select("start", "sub", "place", "mine", "other", likeness("mine", "other").alias("near_edited"), likeness("mine", "following").alias("near_next"))
    base = rows.where("copy = 0").select("start", "sub", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return base.join(marks, ["start", "sub", "place"]).select("doc_id", "n_chars", "edited_sha256", spelt("mine").alias("fingerprint"), spelt("other").alias("edited_fingerprint"), "near_edited", "near_next")
