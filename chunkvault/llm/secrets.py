"""Secret scans, in DataFrame functions only.

Three base rules find known shapes. Besides, every run of `LEAST_TOKEN` or more token characters is a candidate: its encoding
is inferred from its characters, and a battery of three tests compares it with a uniform draw from that alphabet: chi-squared of the
symbol counts, the number of runs of characters of one class (or, in alphabets of one class, of one half of the alphabet), and the
serial correlation of neighbours. A candidate that any test tells from a uniform draw is out, as is a UUID, which names and does not open.
For the others the p-value says how likely ordinary text (ORDINARY: its coincidence of symbols and how often it changes
class) gives as low a chi-squared and as many runs; both deviations count alike. Candidates are then held to a false-discovery
rate (step-up rule) within their stratum of encoding and length, counted over the whole corpus on a
logarithmic grid of p-values, so the table of counts has a fixed bound.

Edge cases: a null text counts as empty; empty tables give empty results; repeated rows are scanned each;
columns besides doc_id and text are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.llm.common import store, tidy

# The base rules and the alphabets of the encodings.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}={{0,2}}"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: What ordinary text of an alphabet is like: the least sum of squared symbol frequencies (words have 0.06 and more, long numbers repeat their digits),
#: and the most changes of class a character (none: the alphabet has one class, so runs tell nothing).
ORDINARY = {"digits": (0.25, None), "hex": (0.15, 0.1), "HEX": (0.15, 0.1), "base32": (0.065, 0.06), "lower": (0.065, None), "base36": (0.065, 0.06), "BASE36": (0.065, 0.06), "base64": (0.06, 0.3), "base64url": (0.06, 0.3)}
#: Deviations from a uniform draw beyond which a test rules a candidate out, and the p-value of chi-squared alone beyond which it is ordinary.
VETO, LEAN = 3.5, 0.2
#: Cells of the grid a decade of p, which is rounded up to its cell, and decades: smaller p share the last cell.
GRID, DECADES = 100, 15


def running_starts(lengths: Column) -> Column:
    """For an array of (g, m), gap and match lengths, the start of each match. Sums run within pieces of about the square root of the
    array's size, then over pieces, as a fold that grows one array copies it at each step."""
    ints = F.array().cast("array<int>")

    def within(piece: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts"))
        return F.aggregate(piece, F.struct(F.lit(0).alias("at"), ints.alias("starts")), step)

    def cut(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / wide).cast("int") - 1), lambda i: within(F.slice(x, i * wide + 1, wide)))

    def joined(pieces: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        before = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), ints.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, before, lambda p, at: F.transform(p["starts"], lambda s: s + at)))

    # Through arrays of one element, so that each step is computed once.
    pieces = F.transform(F.array(lengths), cut)
    return F.when(F.size(lengths) > 0, F.element_at(F.transform(pieces, joined), 1)).otherwise(ints)


def match_spans(text: Column, pattern: str, kind: int, least: int = 0, group: int | None = None) -> Column:
    """Array of (start, kind, end, part) of the leftmost non-overlapping matches; those whose group is shorter than least are dropped.

    Splitting at the matches gives the lengths between them, so sums give the offsets.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else F.lit(None).cast("array<string>")).alias("j"))

    def spans(x: Column) -> Column:
        matches = x["m"]
        lengths = F.zip_with(F.slice(x["g"], F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        judged = matches if group is None else x["j"]
        rows = F.arrays_zip(running_starts(lengths).alias("at"), matches.alias("m"), judged.alias("j"))
        kept = F.filter(rows, lambda r: F.length(r["j"]) >= least)
        return F.transform(kept, lambda r: F.struct(r["at"].alias("start"), F.lit(kind).alias("kind"), (r["at"] + F.length(r["m"])).alias("end"), r["m"].alias("part")))

    return F.element_at(F.transform(F.array(found), spans), 1)


def _classes(abc: str) -> str:
    """For each symbol of an alphabet its class: upper case, lower case, digit or other; or its half, if all are of one class."""
    kinds = "".join("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in abc)
    return kinds if len(set(kinds)) > 1 else "".join("ab"[2 * i >= len(abc)] for i in range(len(abc)))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by the usual logistic approximation; its far lower tail by the asymptotic series, from above."""
    far = F.least(z, F.lit(-3.0))
    tail = F.exp(-far * far / 2) / (-far * 2.5066282746310002) * (1 - 1 / (far * far) + 3 / (far * far * far * far))
    return F.when(z < -3, tail).otherwise(1 / (1 + F.exp(-F.greatest(F.least(z * 1.5976 + z * z * z * 0.07056, F.lit(500.0)), F.lit(-500.0)))))


def _facts(name: str) -> Column:
    """What the tests need to know of an encoding: symbols, classes, and the rates of ordinary text and of uniform draws."""
    abc, classes = ALPHABETS[name], _classes(ALPHABETS[name])
    coincidence, changes = ORDINARY[name]
    uniform = 1 - sum((classes.count(c) / len(abc)) ** 2 for c in set(classes))
    return F.struct(F.lit(abc).alias("abc"), F.lit(classes).alias("classes"), F.lit(float(len(abc))).alias("k"), F.lit(len(abc) * coincidence - 1).alias("far"), F.lit(changes).cast("double").alias("changes"), F.lit(uniform).alias("uniform"))


def _translated(body: Column, f: Column) -> Column:
    """body with each symbol replaced by its class."""
    return F.call_function("translate", body, f["abc"], f["classes"])


def token_tests(token: Column) -> Column:
    """Struct (enc, n, p) of a candidate: the inferred encoding, the length without padding, and the p-value."""
    body = F.regexp_replace(token, "=+$", "")
    enc = F.lit(None).cast("string")
    for name in reversed(ALPHABETS):
        chars = ALPHABETS[name].replace("-", r"\-")
        enc = F.when(body.rlike(f"^[{chars}]+$"), F.lit(name)).otherwise(enc)
    enc = F.when(body.rlike(UUID), F.lit("uuid")).otherwise(enc)
    known = F.create_map(*[x for name in ALPHABETS for x in (F.lit(name), _facts(name))])
    # Stepwise in nested lambdas, so that each value is computed once.
    one = F.transform(F.array(F.struct(enc.alias("enc"), body.alias("body"))), lambda t: F.struct(t["enc"].alias("enc"), t["body"].alias("body"), F.coalesce(F.try_element_at(known, F.coalesce(t["enc"], F.lit("base64"))), known["base64"]).alias("f")))

    def counted(t: Column) -> Column:
        body, f = t["body"], t["f"]
        n = F.length(body)
        same = F.aggregate(F.split(f["abc"], ""), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
        turns = F.length(F.regexp_replace(_translated(body, f), r"(.)\1+", "$1")) - 1
        v = F.transform(F.split(body, ""), lambda c: (F.instr(f["abc"], c) - 1).cast("double"))
        return F.struct(t["enc"].alias("enc"), f.alias("f"), n.cast("double").alias("n"), same.alias("same"), turns.cast("double").alias("turns"), v.alias("v"))

    def sums(t: Column) -> Column:
        v = t["v"]
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        lagged = F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.struct(*[t[c].alias(c) for c in ("enc", "f", "n", "same", "turns")], total.alias("total"), squares.alias("squares"), lagged.alias("lagged"), (F.element_at(v, 1) + F.element_at(v, -1)).alias("ends"))

    def deviations(s: Column) -> Column:
        n, k, far, steps, rate, usual = s["n"], s["f"]["k"], s["f"]["far"], s["n"] - 1, s["f"]["uniform"], s["f"]["changes"]
        chi = k * s["same"] / n - n
        ordinary_chi = (chi - (k - 1 + n * far)) / F.sqrt(2 * (k - 1 + 2 * n * far))
        ordinary_runs = (s["turns"] - usual * steps) / F.sqrt(steps * usual * (1 - usual))
        spread, center = s["squares"] - s["total"] * s["total"] / n, s["total"] / n
        cov = s["lagged"] - center * (2 * s["total"] - s["ends"]) + (n - 1) * center * center
        serial = F.when(spread > 0, F.abs(cov / F.when(spread > 0, spread).otherwise(1.0))).otherwise(1.0)
        uniform = F.greatest((chi - (k - 1)) / F.sqrt(2 * (k - 1)), F.abs(s["turns"] - rate * steps) / F.sqrt(steps * rate * (1 - rate)), serial * F.sqrt(n))
        return F.struct(s["enc"].alias("enc"), n.alias("n"), ordinary_chi.alias("chi"), ordinary_runs.alias("runs"), uniform.alias("uniform"))

    def judged(d: Column) -> Column:
        p = normal_cdf(F.when(d["runs"].isNull(), d["chi"]).otherwise((d["chi"] - d["runs"]) / 2**0.5))
        out = d["enc"].isNull() | (d["enc"] == "uuid") | (d["uniform"] > VETO) | (normal_cdf(d["chi"]) > LEAN)
        return F.struct(d["enc"].alias("enc"), d["n"].alias("n"), F.when(F.coalesce(out, F.lit(True)), 1.0).otherwise(p).alias("p"))

    for step in (counted, sums, deviations, judged):
        one = F.transform(one, step)
    return F.element_at(one, 1)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (spans of the three rules) and cands (token candidates with stratum and grid p-value)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = F.col("t")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,part:string>>")
    marks = t.contains(":") | t.contains("=")
    found = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.concat(
            F.when(marks & t.rlike(ASSIGN), match_spans(t, ASSIGN, 0, 6, 2)).otherwise(none),
            F.when(t.contains("AKIA"), match_spans(t, ACCESS, 1, 20)).otherwise(none),
            F.when(t.rlike(HEX), match_spans(t, HEX, 2, 24)).otherwise(none),
        ).alias("base"),
        F.when(t.rlike(TOKEN), match_spans(t, TOKEN, 3, LEAST_TOKEN)).otherwise(none).alias("tokens"),
    )

    def candidate(s: Column, r: Column) -> Column:
        length = F.least(F.floor(F.log2(r["n"]) * 2), F.lit(30)).cast("int")
        decades = -F.log10(F.greatest(r["p"], F.lit(10.0**-DECADES)))
        grid = (GRID * DECADES + 1 - F.floor(decades * GRID)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws("/", F.coalesce(r["enc"], F.lit("none")), length.cast("string")).alias("stratum"), grid.alias("grid"))

    cands = F.transform("tokens", lambda s: F.element_at(F.transform(F.array(token_tests(s["part"])), lambda r: candidate(s, r)), 1))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", F.array_sort(base).alias("base"), cands.alias("cands"))


def cutoffs(scanned: DataFrame, rate: float) -> dict[str, int]:
    """For each stratum the largest grid p-value that the step-up rule passes. At most encodings x lengths entries."""
    counts = scanned.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.grid").count()
    below, whole = W.partitionBy("stratum").orderBy("grid"), W.partitionBy("stratum")
    counts = counts.withColumn("upto", F.sum("count").over(below)).withColumn("m", F.sum("count").over(whole))
    passed = counts.where(F.pow(F.lit(10.0), (F.col("grid") - GRID * DECADES - 1) / F.lit(float(GRID))) <= F.col("upto") / F.col("m") * rate)
    return {r["stratum"]: r["cut"] for r in passed.groupBy("stratum").agg(F.max("grid").alias("cut")).collect()}


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Per document: doc_id, base and spans, arrays of (start, kind, end) in order; kind indexes KINDS."""
    scanned = store(scan(docs), "secrets")
    cuts = cutoffs(scanned, rate)
    if cuts:
        cut = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
        passed = F.filter("cands", lambda c: c["grid"] <= F.coalesce(F.try_element_at(cut, c["stratum"]), F.lit(0)))
        more = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
        spans = F.array_sort(F.concat("base", more))
    else:
        spans = F.col("base")
    return scanned.select("doc_id", "base", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@tidy
def secret_digest(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """The columns of the contract."""
    found = find_secrets(docs, rate)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
