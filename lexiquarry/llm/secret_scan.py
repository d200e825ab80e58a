"""Secret scans: base patterns, and a battery of randomness tests for other tokens.

Base kinds are found left to right without overlap; a match that fails its length is dropped but stays
used up.  Places come from cutting the text at the matches and adding up lengths, in code points.

The battery adds spans.  Every token of 20 or more characters from the alphabets of encodings is a
candidate.  Its encoding is inferred from the characters it has (hex, base32, lower case, alphanumeric,
base64 or its form for addresses).  Three tests ask whether it could be uniform noise over that alphabet:

* chi-squared over the alphabet's symbols (Wilson and Hilferty's cube root),
* the runs test about the middle of the alphabet,
* the correlation of each symbol's place with the next one's.

The least of the three p-values, corrected for being the least, is the battery's: noise over the alphabet has
all values alike often, anything else has low ones, and the lower the longer it is, while short strings of
any kind pass easily.  So two numbers decide, both of which know the length:

* noise must be likelier than running text, symbol by symbol (the likelihood ratio);
* within bands of length, over all such candidates of the corpus, the least p-value counts from which on what is
  found is noise but for a share ``fdr``: how many candidates are noise is told by the upper half of the
  p-values, where hardly anything else is, and what lies above a level beyond their due is a false discovery.
  A surplus that noise alone has by chance (two standard deviations) isn't held against a level.  Nothing below
  ``alpha`` counts.  p-values are summed up in a histogram of fixed size; no candidates are gathered.

An added span that overlaps a base one is left out: found by a join on pieces of the text, not span by span.

Defined results: null and empty texts have no spans; repeated rows and null ids are scanned each; long texts
are scanned whole, in time in proportion to length and matches; other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, settle

#: The base patterns; fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Long runs only: a run of these characters is matched whole or not at all, so the lengths can be asked in the pattern.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+(?:={0,2})(?![A-Za-z0-9+/_=-])"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (kind, characters it may have, its symbols), the narrowest first.
ENCODINGS = (
    ("random_hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("random_hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("random_base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("random_lower", "^[a-z]+$", LOWER),
    ("random_lower", "^[a-z0-9]+$", LOWER + DIGITS),
    ("random_alnum", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("random_base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("random_base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("random_mixed", "^.+$", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Shares of letters in running text, in thousandths, a to z; fixed values rounded over English, German, French and Spanish.
LETTERS = (80, 15, 30, 42, 140, 16, 18, 32, 72, 3, 7, 45, 25, 80, 60, 24, 6, 66, 68, 72, 36, 12, 13, 4, 10, 6)
CAPITAL, DIGIT, SIGN = 0.03, 0.004, 0.01
BANDS = (20, 32, 64, 128)
#: Bins of p-values.
BINS = 100
#: Matches whose places are added up one by one; above, sums of so many are.
RUN = 64
#: Code points of a piece of text, in which overlapping spans meet.
PIECE = 1024

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matches_at(text: Column, pattern: str) -> Column:
    """[(start, match)] of a pattern, by code points.

    Places are sums of lengths.  They are added up in runs of RUN matches, and the runs' sums before, so that no list grows
    match by match over a whole text.
    """
    length = lambda p: p["gap"] + F.char_length(p["m"])
    longs, out = "array<bigint>", "array<struct<start:bigint,m:string>>"

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.char_length(gap).cast("long").alias("gap"), m.alias("m")))

    def in_runs(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, RUN))

    def placed(run: Column, begin: Column) -> Column:
        none = F.struct(begin.alias("at"), F.array().cast(out).alias("out"))
        step = lambda acc, p: F.struct((acc["at"] + length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["m"].alias("m")))).alias("out"))
        return F.aggregate(run, none, step, lambda acc: acc["out"])

    def all_placed(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, p: a + length(p)))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(longs).alias("out"))
        begins = F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, begins, placed))

    # each step's array is bound to a variable, so it is made once and not for every element of the next
    found = F.filter(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda f: F.size(f) > 0)
    return F.flatten(F.transform(F.transform(F.transform(found, paired), in_runs), all_placed))


def as_spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["m"])).alias("end"))).cast(SPAN)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    long = F.filter(matches_at(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    return as_spans(long, "assign", 0), as_spans(matches_at(text, ACCESS_LONG), "access", 1), as_spans(matches_at(text, HEX_LONG), "hex", 2)


def _normal_cdf(z: Column) -> Column:
    """Within 0.00015; from the logistic curve."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tested(found: Column) -> Column:
    """Candidates [(start, match)] as [(start, end, kind, rank, band, p, likely)]; one step of numbers at a time."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def told(x: Column) -> Column:
        body = F.rtrim(x["m"], F.lit("="))
        kind, symbols, rank = F.lit("random_mixed"), F.lit(ENCODINGS[-1][2]), F.lit(11)
        for k, (name, pattern, own) in reversed(list(enumerate(ENCODINGS[:-1]))):
            fits = body.rlike(pattern)
            kind, symbols, rank = F.when(fits, name).otherwise(kind), F.when(fits, own).otherwise(symbols), F.when(fits, 3 + k).otherwise(rank)
        return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["m"])).alias("end"), body.alias("body"), kind.alias("kind"), symbols.alias("symbols"), rank.alias("rank"))

    def counted(x: Column) -> Column:
        places = F.transform(chars(x["body"]), lambda c: (F.instr(x["symbols"], c) - 1).cast("double"))
        squares = _sum(F.transform(chars(x["symbols"]), lambda c: F.pow((F.char_length(x["body"]) - F.char_length(F.replace(x["body"], c, F.lit("")))).cast("double"), F.lit(2.0))))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), x["kind"].alias("kind"), x["rank"].alias("rank"),
                        F.char_length(x["body"]).cast("double").alias("n"), F.char_length(x["symbols"]).cast("double").alias("k"), places.alias("v"), squares.alias("squares"))

    shares = {c: math.log(p / sum(LETTERS)) for c, p in zip(LOWER, LETTERS)}
    shares |= {c.upper(): v + math.log(CAPITAL) for c, v in shares.items()} | {c: math.log(DIGIT) for c in DIGITS} | {c: math.log(SIGN) for c in "+/-_="}
    in_text = F.create_map(*[F.lit(y) for pair in shares.items() for y in pair])

    def summed(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        mean, m = _sum(v) / n, (n - 1).cast("int")
        heads, tails = F.slice(v, F.lit(1), m), F.slice(v, F.lit(2), m)
        high = _sum(F.transform(v, lambda y: (y >= k / 2).cast("double")))
        turns = _sum(F.zip_with(heads, tails, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double")))
        spread = _sum(F.transform(v, lambda y: (y - mean) * (y - mean)))
        along = _sum(F.zip_with(heads, tails, lambda a, b: (a - mean) * (b - mean)))
        text = _sum(F.transform(chars(x["body"]), lambda c: F.try_element_at(in_text, c)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["rank"].alias("rank"), n.alias("n"), k.alias("k"),
                        (x["squares"] * k / n - n).alias("chi"), high.alias("high"), (turns + 1).alias("runs"),
                        F.when(spread > 0, along / spread).otherwise(F.lit(1.0)).alias("serial"), (-n * F.log(k) - text).alias("ratio"))

    def judged(x: Column) -> Column:
        n, df = x["n"], x["k"] - 1
        chi_z = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mu = 2 * x["high"] * (n - x["high"]) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        runs_z = F.when(var > 0, F.abs(x["runs"] - mu) / F.sqrt(var)).otherwise(F.lit(8.0))
        serial_z = F.abs(x["serial"] + 1 / n) * F.sqrt(n)
        least = F.least(1 - _normal_cdf(chi_z), 2 * (1 - _normal_cdf(runs_z)), 2 * (1 - _normal_cdf(serial_z)))
        band = F.lit(0)
        for b, low in enumerate(BANDS):
            band = F.when(n >= low, b).otherwise(band)
        p = 1 - F.pow(1 - F.greatest(F.least(least, F.lit(1.0)), F.lit(0.0)), F.lit(3.0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["rank"].cast("int").alias("rank"), band.alias("band"), p.alias("p"), (x["ratio"] > 0).alias("likely"))

    out = found
    for f in (told, counted, summed, judged):
        out = F.transform(out, f)
    return out


def thresholds(scanned: DataFrame, alpha: float, fdr: float) -> dict[int, float]:
    """The least p-value that counts, for each band; from a table of at most bands x bins rows."""
    p = F.floor(F.col("t.p") * BINS).cast("int")
    rows = scanned.select(F.explode("tested").alias("t")).filter("t.likely").groupBy("t.band", F.least(p, F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n")).collect()
    out: dict[int, float] = {}
    for band in range(len(BANDS)):
        counts = [0] * BINS
        for r in rows:
            if r.band == band:
                counts[r.bin] = r.n
        noise = 2 * sum(counts[BINS // 2 :])
        for low in range(BINS // 2 + 1):
            found = sum(counts[low:])
            if found - noise * (1 - low / BINS) <= fdr * found + 2 * math.sqrt(found):
                out[band] = max(alpha, low / BINS)
                break
    return out


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", alpha: float = 0.01, fdr: float = 0.01) -> DataFrame:
    """doc_id, the base spans of each kind and the battery's spans (start, rank, kind, end)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assign, access, hex_ = base_spans(F.col("t"))
    rows = docs.select(F.col(key).alias("doc_id"), whole.alias("t"))
    rows = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hex_.alias("hex"), tested(matches_at(F.col("t"), CANDIDATE)).alias("tested"))
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()), "secrets-scanned")
    least = thresholds(rows, alpha, fdr)
    passes = lambda x: x["likely"] & F.coalesce(*[F.when(x["band"] == b, x["p"] >= v) for b, v in least.items()], F.lit(False))
    kept = rows.withColumn("kept", F.filter("tested", passes)).filter(F.size("kept") > 0)
    added = kept.select("uid", F.explode("kept").alias("x")).select("uid", "x.start", "x.rank", "x.kind", "x.end")
    in_pieces = lambda df, start, end: df.withColumn("piece", F.explode(F.sequence(F.floor(F.col(start) / PIECE), F.floor((F.col(end) - 1) / PIECE))))
    base = in_pieces(kept.select("uid", F.explode(F.concat("assign", "access", "hex")).alias("b")).select("uid", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end")), "b_start", "b_end")
    taken = in_pieces(added, "start", "end").join(base, ["uid", "piece"]).filter((F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end"))).select("uid", "start").distinct()
    free = added.join(taken, ["uid", "start"], "left_anti")
    random = free.groupBy("uid").agg(F.collect_list(F.struct("start", "rank", "kind", "end")).cast(SPAN).alias("random"))
    return rows.join(random, "uid", "left").select("doc_id", "assign", "access", "hex", F.coalesce("random", F.array().cast(SPAN)).alias("random"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("random"))).alias("spans"))
