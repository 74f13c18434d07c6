"""Secret scans: fixed patterns and a battery of randomness tests.

**Base patterns.** Assignments to secret-like names, access keys and long hexadecimal strings.
The texts between the matches of a pattern and the matches themselves give every position.

**Randomness battery.** Every run of at least ``shortest`` characters of the base64 alphabets
that has a letter and a digit is a candidate. Its encoding is inferred (the narrowest of
hexadecimal, base32, base36, base58, base62 and base64 that has all its characters) and three tests
ask whether it could be a random string of that encoding:

* chi-squared: are the symbols uniform over the alphabet (exact mean and variance of the
  statistic, Wilson-Hilferty tail);
* runs: do symbols of the alphabet's upper and lower half alternate as chance has it;
* serial correlation of neighbouring symbols.

The least of the three p-values, times three, is the candidate's.

**False-discovery control** works within classes of length, since few symbols have little power,
on both sides:

* A Benjamini-Hochberg step at level ``q_regular`` settles which candidates the battery finds too
  regular to be random, so that hardly any random string is lost.
* What is left is reported only if it is no name. The null hypothesis is a text of words and
  numbers: letters by their frequency, and a change between lower case, upper case, digits and
  signs at the most favourable of a few rates. The likelihood of the random encoding over that of
  the text is an e-value: under the null its mean is 1 at most. The step-up procedure on e-values
  at level ``q`` then bounds the expected share of names among what is reported, whatever the
  dependence between candidates.

Both steps work on counts per class and bucket, of which there are a bounded number. Reported
candidates of at least ``least_bits`` bits are of the kind ``random``.

Everything is DataFrame functions. Texts are scanned where they are read; only spans are
shuffled. A token is counted in pieces of ``PIECE`` characters, so the work is linear in its length.

Identifiers in hyphenated groups (UUIDs) are no candidates of any encoding, since they name things
far more often than they guard them; tokens behind a fixed prefix are tested with it, and about 7 %
of those of 20 characters behind one of six are lost.

Edge cases: a null text is empty and has no spans; rows with equal id and text are one document
and each gets its result; very long texts and tokens are scanned whole; an empty table gives an
empty result; candidates that overlap a base span are not repeated; spans count code
points, the end exclusive; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm._common import stored

#: Kinds in the order of the report: name, pattern, group that must have a least length, and that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
RANDOM = "random"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest: name, test, alphabet.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", r"^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("BASE36", r"^[A-Z0-9]+$", DIGITS + UPPER),
    ("base58", r"^[1-9A-HJ-NP-Za-km-z]+$", DIGITS[1:] + UPPER.replace("I", "").replace("O", "") + LOWER.replace("l", "")),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
SIGNS = "+/-_"
#: Per cent of each letter, a to z, in English text: fixed values.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Bits of each character of LOWER + DIGITS + SIGNS within its kind.
TEXT_BITS = (*(-log2(p / sum(LETTER_SHARES)) for p in LETTER_SHARES), *[log2(10)] * 10, *[log2(4)] * 4)
#: Chances that the next character of a text is of the same kind.
SAME_KIND = (0.6, 0.75, 0.9)
#: p-values fall into buckets of a tenth of a decade, the last of which holds all the rest.
BUCKETS, PER_DECADE = 300, 10
#: e-values fall into buckets of a bit, up to so many.
MOST_BITS = 1000
#: Characters of a token that are counted at a time.
PIECE = 1 << 16


def spans(rows: DataFrame, kinds: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """``id``, ``h``, ``kind``, ``rank``, ``start``, ``end``, ``match``: leftmost matches of each
    kind's pattern that do not overlap, without those whose group is too short.

    One scan serves all kinds; texts without a match end there.
    """
    text = F.col("text")
    marked = rows.select("id", "h", "text", *[text.rlike(pattern).alias(f"has{i}") for i, (_, pattern, _, _) in enumerate(kinds)])
    found = [
        F.when(F.col(f"has{i}"), F.struct(
            F.lit(i).alias("rank"), F.lit(least).alias("least"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("size")))
        for i, (_, pattern, group, least) in enumerate(kinds)
    ]
    some = marked.where(" OR ".join(f"has{i}" for i in range(len(kinds)))).select("id", "h", F.explode(F.array_compact(F.array(*found))).alias("k"))
    once = some.select("id", "h", "k.*").dropDuplicates(["id", "h", "rank"])
    each = once.select("id", "h", "rank", "least", F.posexplode(F.arrays_zip("match", "gap", "size")).alias("i", "m")).where("m.match IS NOT NULL")
    so_far = Window.partitionBy("id", "h", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.length("m.match")).over(so_far))
    names = F.array(*[F.lit(kind) for kind, _, _, _ in kinds])
    return each.where(F.col("m.size") >= F.col("least")).select(
        "id", "h", F.get(names, F.col("rank")).alias("kind"), "rank", (F.col("end") - F.length("m.match")).cast("int").alias("start"),
        F.col("end").cast("int").alias("end"), F.col("m.match").alias("match"),
    )


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by Zelen and Severo's rational approximation."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, c: a + c)


def neighbours(values: str, join) -> Column:
    """``join`` of each value and the next."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), join)


def randomness(tokens: DataFrame, token: str) -> DataFrame:
    """``tokens`` of a known encoding by their other columns, with ``r``: ``encoding``, ``n``, ``bits``, ``p`` and ``gain``
    (bits by which the random encoding describes it better than a text does)."""
    kind = F.lit(None)
    for name, test, alphabet in reversed(ENCODINGS):
        kind = F.when(F.col("_core").rlike(test), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"))).otherwise(kind)
    names = [c for c in tokens.columns if c != token] or [token]  # a long token is no key if others tell it
    t = tokens.withColumn("_core", F.regexp_replace(token, "=+$", "")).withColumn("_e", kind).where("_e IS NOT NULL")
    t = t.select(*names, "_core", "_e.*", F.length("_core").cast("double").alias("n"))
    t = t.withColumn("first", F.instr(F.col("alphabet"), F.left("_core", F.lit(1))) - 1).withColumn("final", F.instr(F.col("alphabet"), F.right("_core", F.lit(1))) - 1)
    # Everything counted is a sum over characters or neighbours, so long tokens are counted in pieces,
    # each with the character behind it; within a piece no function of a character refers to another sum.
    t = t.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))))
    t = t.withColumn("piece", F.substring("_core", F.col("at") * PIECE + 1, F.lit(PIECE + 1))).drop("_core")
    t = t.withColumn("own", F.left("piece", F.lit(PIECE)))
    t = t.withColumn("x", F.transform(F.split("piece", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1))
    t = t.withColumn("own_x", F.slice("x", F.lit(1), F.length("own"))).withColumn("high", F.transform("x", lambda v: F.when(v >= F.col("k") / 2, 1.0).otherwise(0.0)))
    kinds = F.translate("piece", DIGITS + LOWER + UPPER + SIGNS, "0" * 10 + "a" * 26 + "A" * 26 + "-" * 4)
    costs = F.array(*[F.lit(b) for b in TEXT_BITS])
    token_key = [*names, "name", "k", "n", "first", "final"]
    t = t.select(
        *token_key, (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1).cast("double").alias("changes"),
        total(F.transform(F.split(F.lower("own"), ""), lambda c: F.get(costs, F.instr(F.lit(LOWER + DIGITS + SIGNS), c) - 1))).alias("letters"),
        F.transform(F.split("alphabet", ""), lambda c: F.length("own") - F.length(F.replace(F.col("own"), c, F.lit("")))).alias("counts"),
        total(F.slice("high", F.lit(1), F.length("own"))).alias("ups"), total(neighbours("high", lambda a, b: F.abs(a - b))).alias("turns"),
        total(F.col("own_x")).alias("sum"), total(F.transform("own_x", lambda v: v * v)).alias("squares"), total(neighbours("x", lambda a, b: a * b)).alias("products"))
    sums = [F.sum(c).alias(c) for c in ("changes", "letters", "ups", "turns", "sum", "squares", "products")]
    t = t.groupBy(*token_key).agg(*sums, F.collect_list("counts").alias("counts"))
    counts = F.aggregate("counts", F.transform(F.get("counts", F.lit(0)), lambda c: F.lit(0)), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    t = t.withColumn("square", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    order = F.least(*[-(F.col("n") - 1 - F.col("changes")) * log2(s) - F.col("changes") * log2((1 - s) / 3) for s in SAME_KIND])
    n, k, mean = F.col("n"), F.col("k"), F.col("sum") / F.col("n")
    t = t.select(
        *names, "name", "n", "k", (2 + F.col("letters") + order - n * F.log2("k")).alias("gain"), "square", (2 * F.col("ups") * (n - F.col("ups"))).alias("both"), "turns",
        (F.col("squares") - F.col("sum") * mean).alias("energy"), (F.col("products") - mean * (2 * F.col("sum") - F.col("first") - F.col("final")) + (n - 1) * mean * mean).alias("lagged"),
    )
    # Chi-squared, brought to the usual variance, by Wilson and Hilferty.
    scaled = (F.col("square") * k / n - n - (k - 1)) / F.sqrt((n - 1) / n) + (k - 1)
    chi = (F.cbrt(F.greatest(scaled, F.lit(0.0)) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    spread = F.col("both") * (F.col("both") - n) / (n * n * (n - 1))
    t = t.withColumn("z_chi", chi).withColumn("z_runs", F.when(spread > 0, F.abs(F.try_divide(F.col("turns") - F.col("both") / n, F.sqrt(F.greatest(spread, F.lit(0.0)))))))
    t = t.withColumn("z_serial", F.when(F.col("energy") > 0, F.abs((F.try_divide(F.col("lagged"), F.col("energy")) + 1 / n) * F.sqrt(n))))
    least = F.least(normal_tail(F.col("z_chi")), *[F.coalesce(2 * normal_tail(F.col(z)), F.lit(0.0)) for z in ("z_runs", "z_serial")])
    return t.select(*names, F.struct(F.col("name").alias("encoding"), n.cast("int").alias("n"), (n * F.log2(k)).alias("bits"), F.least(F.lit(1.0), 3 * least).alias("p"), "gain").alias("r"))


def too_regular(tested: DataFrame, q: float) -> DataFrame:
    """Per length class (column ``c``) the least bucket (``cutoff``) that the step rejects."""
    counts = tested.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    onward = Window.partitionBy("c").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    stepped = counts.select("c", "b", F.sum("n").over(onward).alias("k"), F.sum("n").over(Window.partitionBy("c")).alias("m"))
    passes = F.pow(F.lit(10.0), -F.col("b") / PER_DECADE) <= q * F.col("k") / F.col("m")
    return stepped.where(passes).groupBy("c").agg(F.min("b").alias("cutoff"))


def no_text(tested: DataFrame, q: float) -> DataFrame:
    """Per length class (``c``) the least bucket of bits (``enough``) whose e-values are discoveries."""
    counts = tested.groupBy("c", "e").agg(F.count(F.lit(1)).alias("n"))
    onward = Window.partitionBy("c").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    stepped = counts.select("c", "e", F.sum("n").over(onward).alias("k"), F.sum("n").over(Window.partitionBy("c")).alias("m"))
    return stepped.where(F.col("e") >= F.log2(F.col("m") / (q * F.col("k")))).groupBy("c").agg(F.min("e").alias("enough"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 20, least_bits: float = 80.0, q: float = 0.05,
    q_regular: float = 0.01,
) -> DataFrame:
    """One row per row of ``docs``: ``id`` and ``found``, its spans in order (structs ``start``,
    ``rank``, ``kind``, ``end``, ``encoding``, ``p``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    pattern = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{shortest},}}={{0,2}}"
    every = stored(spans(rows, (*KINDS, (RANDOM, pattern, 0, shortest))))
    place = ["id", "h", "kind", "rank", "start", "end"]
    base = every.where(F.col("kind") != RANDOM).select(*place, F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("double").alias("p"))

    tested = randomness(every.where(F.col("kind") == RANDOM), "match")
    bucket = F.least(F.lit(BUCKETS), F.floor(-F.log10(F.greatest("r.p", F.lit(1e-300))) * PER_DECADE)).cast("int")
    gain = F.floor(F.least(F.greatest("r.gain", F.lit(-1.0)), F.lit(float(MOST_BITS)))).cast("int")
    tested = stored(tested.select(*place, "r", F.floor(F.log2("r.n")).cast("int").alias("c"), F.greatest(bucket, F.lit(0)).alias("b"), gain.alias("e")))
    # At most one row per power of two of a length: small enough to broadcast.
    left = tested.join(F.broadcast(too_regular(tested, q_regular)), "c", "left").join(F.broadcast(no_text(tested, q)), "c", "left")
    left = left.where((F.col("cutoff").isNull() | (F.col("b") < F.col("cutoff"))) & (F.col("e") >= F.col("enough")))
    random = left.where(F.col("r.bits") >= least_bits).select(*place, "r.encoding", "r.p")
    every = base.unionByName(random)
    own = Window.partitionBy("id", "h").orderBy("start", "rank")
    fixed = F.col("rank") < len(KINDS)
    every = every.withColumn("before", F.max(F.when(fixed, F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("next", F.min(F.when(fixed, F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing)))
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    listed = every.where(fixed | clear).groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "encoding", "p"))).alias("found"))
    same = (F.col("d.h") == F.col("s.h")) & F.col("d.id").eqNullSafe(F.col("s.id"))
    return rows.select("id", "h").alias("d").join(listed.alias("s"), same, "left").select(
        "d.id", F.coalesce("found", F.array().cast(listed.schema["found"].dataType)).alias("found"))
