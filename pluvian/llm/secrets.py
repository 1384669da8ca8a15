"""Secret scans: fixed patterns plus a randomness test battery. [native]

Battery: a run of key characters that holds letters and digits gets the encoding its characters imply (hex, base 32, base
36, base 62, base 64). Three tests ask whether its symbols look drawn at random from that alphabet: chi-squared uniformity, the runs
test about the middle of the alphabet, and the correlation of neighbours. Their p-values are combined by Fisher's method.
Random strings have uniform p-values and other strings small ones; from that, per encoding and length class, the share of
non-random strings above each p is estimated over the whole corpus, and the lowest cutoff whose share stays within the
false discovery rate is used. So short strings, on which the tests have little power, need a larger p than long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.llm.columns import let, normal_tail, own_names, running
from pluvian.session import written

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of key characters that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings with their symbols in order; a token gets the first one that has all its characters.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
P_STEPS = 50


def matches(text: Column, pattern: str, kind: str, least: int = 1, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array of (start, rank, end), in code points; those whose `group` (default: all)
    has under `least` characters are dropped after they have taken their place. Texts without a match skip the work."""
    parts = None if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = F.transform(found_spans(text, pattern), lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))
    if parts is not None:
        spans = let(parts, lambda p: F.filter(spans, lambda s, i: F.length(F.get(p, i)) >= least))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def found_spans(text: Column, pattern: str) -> Column:
    """(text, start, end) of all matches, in a time that grows with the text: ends are running sums of the lengths."""
    def placed(pair: Column) -> Column:
        steps = F.zip_with(F.slice(pair["gaps"], F.lit(1), F.size(pair["found"])), pair["found"], lambda g, f: F.length(g) + F.length(f))
        return let(running(steps, lambda x, y: x + y, F.lit(0)), lambda ends: F.transform(pair["found"], lambda f, i: F.struct(
            f.alias("text"), (F.get(ends, i) - F.length(f)).alias("start"), F.get(ends, i).alias("end"))))
    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def symbols(token: Column) -> Column:
    """Struct (enc, m, v): the encoding implied by the characters, the size of its alphabet, and the symbols' positions."""
    enc = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS):
        chars = letters.replace("-", r"\-")
        enc = F.when(token.rlike(f"^[{chars}]+$"), F.lit(name)).otherwise(enc)
    letters = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS for x in pair]), enc)
    signs = F.filter(F.split(token, ""), lambda c: c != "")
    return let(letters, lambda a: F.struct(enc.alias("enc"), F.length(a).alias("m"), F.transform(signs, lambda c: F.position(c, a) - 1).alias("v")))


def battery(v: Column, m: Column) -> Column:
    """Combined p-value that the symbols `v` (0 to m - 1) are random draws from an alphabet of `m`.

    Chi-squared by Wilson and Hilferty's normal form, two-sided runs and lag-1 correlation tests, joined by Fisher's
    method: with x = -ln(p1 p2 p3) the tail of 6 degrees is exp(-x) (1 + x + x^2 / 2).
    """
    # one pass over neighbours, and one over the sorted symbols: the k-th of equal ones adds 2k - 1 to the squares of the counts
    def step(a: Column, x: Column) -> Column:
        here = (x >= m / 2).cast("int")
        first = a["last"] < 0
        turn = F.when(first, 0).otherwise(F.abs(here - (a["last"] >= m / 2).cast("int")))
        product = F.when(first, 0.0).otherwise((x - (m - 1) / 2) * (a["last"] - (m - 1) / 2))
        return F.struct(x.alias("last"), (a["turns"] + turn).alias("turns"), (a["lag"] + product).alias("lag"))

    def add(a: Column, x: Column) -> Column:
        k = F.when(a["last"] == x, a["k"] + 1).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), k.alias("k"), (a["square"] + 2 * k - 1).alias("square"))
    one = F.aggregate(v, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("turns"), F.lit(0.0).alias("lag")), step)
    two = F.aggregate(F.sort_array(v), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("square")), add)

    def scores(x: Column) -> Column:
        n, m = x["n"], x["m"]
        chi, free = x["two"]["square"] * m / n - n, m - 1
        z_chi = (F.cbrt(chi / free) - (1 - F.lit(2.0) / (9 * free))) / F.sqrt(F.lit(2.0) / (9 * free))
        # runs about the middle of the alphabet: given n fair coins, 1 + Binomial(n - 1, 1/2) runs
        z_runs = (x["one"]["turns"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        # neighbours: sum of products of centred symbols, variance (n - 1) s^4 with s^2 = (m^2 - 1) / 12
        z_lag = x["one"]["lag"] / (F.sqrt(n - 1) * (m * m - 1) / 12)
        return F.struct(z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_lag).alias("lag"))

    def joined(z: Column) -> Column:
        logs = [F.log(F.greatest(p, F.lit(1e-12))) for p in (normal_tail(z["chi"]), 2 * normal_tail(z["runs"]), 2 * normal_tail(z["lag"]))]
        return let(-(logs[0] + logs[1] + logs[2]), lambda x: F.exp(-x) * (1 + x + x * x / 2))
    sums = F.struct(one.alias("one"), two.alias("two"), F.size(v).cast("double").alias("n"), m.cast("double").alias("m"))
    return let(sums, lambda x: let(scores(x), joined))


def length_class(n: Column) -> Column:
    """Two classes per doubling of the length."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """Runs of key characters with letters, digits and one of the alphabets: array of (start, end, bin, p).

    `bin` is encoding and length class. Runs without a digit are words; runs without a letter are numbers.
    """
    def tested(s: Column) -> Column:
        token = s["text"]
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
        scored = let(symbols(token), lambda c: F.when(c["enc"].isNotNull(), F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.concat_ws(":", c["enc"], length_class(F.size(c["v"]))).alias("bin"), battery(c["v"], c["m"]).alias("p"))))
        return F.when(mixed, scored)
    found = F.array_compact(F.transform(found_spans(text, TOKEN), tested))
    return F.when(text.rlike(TOKEN), found).otherwise(F.array().cast("array<struct<start:int,end:int,bin:string,p:double>>"))


def false_discovery_cutoffs(bins: DataFrame, rate: float = 0.1, steps: int = P_STEPS) -> DataFrame:
    """(bin, cutoff): the lowest p from which on at most a share `rate` of the strings is not random.

    `bins` has a row (bin, p) per candidate. Of random strings, half have p >= 1/2, so twice the strings seen there is
    their number, spread evenly over p; what a cutoff takes beyond their part is false.
    """
    cell = F.least(F.floor(F.col("p") * steps), F.lit(steps - 1)).cast("int")
    hist = bins.groupBy("bin", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("bin").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    random = 2 * F.sum(F.when(F.col("cell") >= steps // 2, F.col("n")).otherwise(0)).over(Window.partitionBy("bin"))
    taken = (hist.withColumn("_taken", F.sum("n").over(up)).withColumn("_random", random)
             .withColumn("cutoff", F.col("cell") / steps))
    false = F.greatest(F.col("_taken") - F.col("_random") * (1 - F.col("cutoff")), F.lit(0.0))
    return taken.where(false <= rate * F.col("_taken")).groupBy("bin").agg(F.min("cutoff").alias("cutoff"))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", rate: float = 0.1) -> DataFrame:
    """`keep` and `spans` of every document: array of (start, rank, end) by start, then kind; rank counts in `KINDS`.

    Spans are code points, end exclusive. Pattern spans always stay; spans of the battery are added where they overlap
    none of those. Null and empty texts have no spans; repeated rows get the same spans; without any candidate only
    patterns count. Columns beyond the named ones are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(matches(body, ASSIGN, "assign", 6, group=2), matches(body, ACCESS, "access"),
                                 matches(body, HEX, "hex")))
    found = written(own_names(docs, *dict.fromkeys([*keep, text]))
                    .select(*keep, base.alias("base"), candidates(body).alias("maybe")))
    cuts = false_discovery_cutoffs(found.select(F.explode("maybe").alias("c")).select("c.bin", "c.p"), rate)
    # a row per encoding and length class, some dozens
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "cutoff"))).alias("m")).select("m").scalar()
    ends = running(F.transform("base", lambda b: b["end"]), F.greatest, F.lit(0))
    added = let(ends, lambda e: F.filter("maybe", lambda c: (c["p"] >= F.element_at(F.col("cuts"), c["bin"])) & ~met(c, F.col("base"), e)))
    spans = F.array_sort(F.concat("base", F.transform(added, lambda c: F.struct(
        c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")))))
    return found.withColumn("cuts", table).select(*keep, "base", spans.alias("spans"))


def met(span: Column, others: Column, ends: Column) -> Column:
    """Whether `span` overlaps one of `others`, which are sorted by start; `ends` is the running maximum of their ends.

    Of those that start before the span ends (found by halving), one overlaps if the largest end lies behind its start.
    """
    start = F.struct(F.lit(0).alias("a"), F.size(others).alias("z"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.floor((x["a"] + x["z"]) / 2).cast("int")
        before = F.get(others, mid)["start"] < span["end"]
        return F.when(x["a"] >= x["z"], x).when(before, F.struct((mid + 1).alias("a"), x["z"].alias("z"))).otherwise(F.struct(x["a"].alias("a"), mid.alias("z")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + F.lit(1.0))).cast("int"))
    return let(F.aggregate(steps, start, halve)["a"], lambda n: (n > 0) & F.coalesce(F.get(ends, n - 1) > span["start"], F.lit(False)))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mask`; overlapping spans become one."""
    def joined(parts: Column) -> Column:
        signs, spans, ends = parts["signs"], parts["spans"], parts["ends"]

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            kept = F.array_join(F.slice(signs, before + 1, F.greatest(s["start"] - before, F.lit(0))), "")
            return F.when(s["start"] >= before, F.concat(kept, F.lit(mask))).otherwise(F.lit(""))
        last = F.element_at(ends, F.lit(-1))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.array_join(F.slice(signs, last + 1, F.size(signs)), ""))
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    parts = F.struct(F.filter(F.split(text, ""), lambda c: c != "").alias("signs"), spans.alias("spans"), ends.alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, joined))


def spelled(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
