"""Secret scans: base patterns, and a battery of randomness tests on other long strings.

Only DataFrame functions. A string's encoding is inferred from its characters (all classes of an alphabet must be there);
under it four tests ask whether it looks drawn at random: chi-squared of the alphabet's uniformity, the same over pools of letters
(so few letters in a string still fill the cells), runs of vowels, and serial correlation. Fisher's method combines them.

What is reported must stand out from strings that people write. For each encoding and class of lengths that the corpus has, DECOYS
identifiers are made of ordinary words, digits and separators in that encoding and length; the share of them that look at least
as random is a string's p under "ordinary", with an exponential tail beyond the most random twentieth of them. The Benjamini-Hochberg rule over all the corpus's strings then bounds the expected
share of ordinary ones among the reported by FALSE_DISCOVERY. A reported string must also pass the battery itself at BATTERY.

Not tested: strings under MIN_BITS bits, where the tests have no power, and those of letters of one case. Texts are read whole,
however long; a candidate of any length is tested in blocks, in time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.lambdas import let
from pagefold.llm.common import fresh, written

KINDS = ("assign", "access", "hex", "random")
#: Base patterns. Java's \x20 and letter classes are ASCII; the possessive run begins where a run does.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
MIN_ASSIGN = 8
#: A random string carries at least this many bits under its encoding; rate of ordinary strings among the reported; p of randomness from which the battery passes.
MIN_BITS, FALSE_DISCOVERY, BATTERY = 100, 0.01, 1e-4
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order they are tried: name, pattern of the whole string, alphabet.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _D + _L[:6]),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _D + _U[:6]),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _U + _D[2:8]),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _D + _L),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _D + _U),
    ("base52", r"^(?=.*[a-z])(?=.*[A-Z])[a-zA-Z]+$", _U + _L),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9a-zA-Z]+$", _U + _L + _D),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9a-zA-Z+/]+$", _U + _L + _D + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9a-zA-Z_-]+$", _U + _L + _D + "-_"),
)
#: Pools of letters whose shares are compared with the alphabet's, and the characters whose runs are counted, with all others.
POOLS = (_D, "etaoinsrETAOINSR", "bcdfghjklmpquvwxyz", "BCDFGHJKLMPQUVWXYZ", "+/-_")
_ALL = _D + _L + _U + "+/-_"
_RUNS = "".join("1" if c in "aeiouAEIOU01234" else "0" for c in _ALL)
LEAST_P, LEAST_COMBINED, BINS, BLOCK = 1e-40, 1e-100, 20, 512
#: Decoys for each encoding and class of lengths; classes are half octaves, from LEAST_LENGTH on, the last one open; share of the decoys that the tail is fitted to.
DECOYS, LEAST_LENGTH, LAST_CLASS, TAIL = 2_000, 20, 14, 0.05
# Words that decoys are made of; for each encoding their case (lower, UPPER, Title), separators, and the digits put in.
WORDS = """account action active address admin agent alias amount api app archive array asset async attribute audit author avatar backup balance base batch
billing block body bonus branch brand browser bucket budget buffer build bundle button cache calendar call campaign cancel card cart catalog category center
change channel chart chat check child city class client clock cloud cluster code color column comment company config connect console contact content context
control copy count country coupon create credit currency current custom daily data database date debug default delete delivery demo deploy design detail device
digest direct display document domain download draft driver edit element email employee enable engine entity entry error event export factory feature field file
filter final first flag folder font form format frame function game gateway general get global graph group guide handler hash header health height history home
host hotel http icon image import index info input install instance invoice item job key label language layer layout level library license limit line link list
load local location lock log login main manager map market match media member memory menu merge message meta method metric mobile mode model module monitor month
name network next node note notify number object offer online option order origin output owner package page panel parent parse partner path patient payment
permission person phone photo plan platform player plugin point policy pool port position post prefix price primary print private process product profile project
property provider proxy public purchase query queue quick random range rate reader record refresh region register release remote remove render report request
reset resource response result return review role root route rule sample save schedule schema school score screen script search season second secure select
sensor series server service session setting setup share shop sign simple site size social sort source stage start state static status step stock storage store
stream string student style submit summary support switch system table tag target task team template test text theme thread ticket time title token tool topic
total track traffic transfer tree trigger type union unit update upload user utility value vendor version video view virtual wallet warning weather web widget
width window word work year zone""".split()
STYLES = {"hex": None, "HEX": None, "base32": ("UPPER", "", "234567"), "base36": ("lower", "", _D), "BASE36": ("UPPER", "", _D), "base52": ("Title", "", ""), "base62": ("Title", "", _D), "base64": ("Title", "/", _D), "base64url": ("Title", "_-", _D)}
MASK = "<SECRET>"


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal z (Abramowitz and Stegun 7.1.26)."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(F.lit(LEAST_P), F.least(F.lit(1.0), let(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x)))

    return let(F.abs(z) / math.sqrt(2), tail)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _pairs(xs: Column, f) -> Column:
    return _total(F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f))


def _upper_tail(square: Column, freedom: Column) -> Column:
    """p of a chi-squared value, by Wilson and Hilferty; no freedom: 1."""
    v = 2 / (9 * freedom)
    z = (F.pow(F.greatest(square, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)
    return F.when(freedom > 0, let(z, lambda z: F.when(z > 0, normal_p(z) / 2).otherwise(1 - normal_p(z) / 2))).otherwise(1.0)


def uniformity(s: Column, alphabet: Column, n: Column, k: Column) -> Column:
    """p of chi-squared over the alphabet's k characters. A count is what a string of n loses without the character, so no array of the string is made."""
    count = lambda c: (n - F.length(F.replace(s, c, F.lit("")))).cast("double")
    square = _total(F.transform(F.split(alphabet, "", -1), lambda c: F.pow(count(c), F.lit(2))))
    return _upper_tail(square * k / n - n, k - 1)


def evenness(s: Column, alphabet: Column, n: Column, k: Column) -> Column:
    """p of chi-squared over POOLS, each expected to have its share of the alphabet."""
    pool = lambda p: F.struct((n - F.length(F.translate(s, p, ""))).cast("double").alias("seen"), ((k - F.length(F.translate(alphabet, p, ""))) / k).alias("share"))
    pools = F.filter(F.array(*map(pool, POOLS)), lambda x: x["share"] > 0)
    square = lambda x: F.pow(x["seen"] - n * x["share"], F.lit(2)) / (n * x["share"])
    return let(pools, lambda xs: _upper_tail(_total(F.transform(xs, square)), (F.size(xs) - 1).cast("double")))


def runs(s: Column, n: Column) -> Column:
    """p of the number of runs of the characters marked in _RUNS and of others; all of one kind: null."""
    lost = lambda b, x: (n - F.length(F.replace(b, F.lit(x), F.lit("")))).cast("double")

    def of(b: Column) -> Column:
        mean = lambda o: 2 * o * (n - o) / n + 1
        found = 1 + lost(b, "01") / 2 + lost(b, "10") / 2
        z = lambda m: F.try_divide(found - m, F.sqrt((m - 1) * (m - 2) / (n - 1)))
        return let(lost(b, "1"), lambda o: F.when((o > 0) & (o < n), normal_p(let(mean(o), z))))

    return let(F.translate(s, _ALL, _RUNS), of)


def correlation(s: Column, n: Column) -> Column:
    """p of the serial correlation of the characters' codes, of pairs inside blocks; all alike: null."""

    def block(xs: Column) -> Column:
        ends = F.element_at(xs, 1) + F.element_at(xs, -1)
        return F.struct(_total(xs).alias("s1"), _total(F.transform(xs, lambda x: x * x)).alias("s2"), _pairs(xs, lambda a, b: a * b).alias("lag"), ends.alias("ends"), (F.size(xs) - 1).cast("double").alias("pairs"))

    codes = lambda t: F.transform(F.split(t, "", -1), lambda c: F.ascii(c).cast("double"))
    blocks = F.transform(F.regexp_extract_all(s, F.lit(rf".{{1,{BLOCK}}}"), F.lit(0)), lambda t: let(codes(t), block))
    add = lambda b, f: _total(F.transform(b, lambda x: x[f]))
    sums = lambda b: F.struct(*(add(b, f).alias(f) for f in ("s1", "s2", "lag", "ends", "pairs")))

    def r(t: Column) -> Column:
        m = t["s1"] / n
        return F.try_divide(t["lag"] - m * (2 * t["s1"] - t["ends"]) + t["pairs"] * m * m, t["s2"] - n * m * m)

    return let(blocks, lambda b: let(sums(b), lambda t: normal_p((r(t) + 1 / n) * F.sqrt(n))))


def randomness(s: Column, alphabet: Column) -> Column:
    """p of a string being drawn from the alphabet at random: the tests, by Fisher's method. A test that is undefined gives LEAST_P."""

    def of(d: Column) -> Column:
        n, k = d["n"], d["k"]
        ps = F.array(uniformity(s, alphabet, n, k), evenness(s, alphabet, n, k), runs(s, n), correlation(s, n))
        x = -_total(F.transform(ps, lambda p: F.ln(F.greatest(F.coalesce(p, F.lit(LEAST_P)), F.lit(LEAST_P)))))
        return let(x, lambda x: F.greatest(F.lit(LEAST_COMBINED), F.least(F.lit(1.0), F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))))

    return let(F.struct(F.length(s).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k")), of)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column found: struct of base (spans) and odd (candidate strings that no base span touches: span, p, encoding, class of lengths).

    The name found gets underscores if docs has it. Null text is empty.
    """
    names = [f"_scan_{x}" for x in ("text", "assign", "value", "access", "hex", "random", "base", "odd")]
    t, a, v, c, h, r, base, odd = (F.col(x) for x in names)
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(names[0], body)
    df = df.withColumns({n: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for n, p in zip((names[1], names[3], names[4], names[5]), (ASSIGN, ACCESS, HEX, RANDOM), strict=True)})
    df = df.withColumn(names[2], F.when(F.size(a) > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))))
    always = lambda k: F.lit(True)
    spans = [_places(t, ASSIGN, a, 0, lambda k: F.length(F.element_at(v, k)) >= MIN_ASSIGN), _places(t, ACCESS, c, 1, always), _places(t, HEX, h, 2, always)]
    df = df.withColumn(names[6], F.array_sort(F.concat(*spans)))
    free = F.filter(_places(t, RANDOM, r, 3, always), lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
    df = df.withColumn(names[7], F.when(F.size(r) > 0, F.filter(F.transform(free, lambda s: _tested(t, s)), lambda x: x.p.isNotNull())).otherwise(F.array().cast(ODD)))
    found = fresh(docs, "found")
    return df.withColumn(found, F.struct(base.alias("base"), odd.alias("odd"))).drop(*names)


ODD = "array<struct<start:int,kind:int,end:int,p:double,encoding:int,class:int>>"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, matches: Column, kind: int, ok) -> Column:
    """Spans of matches (all of pattern in text, in order) that are ok(number from 1): the gaps between matches say where each begins."""
    nothing = F.array().cast(SPAN)

    def step(gaps: Column):
        def add(s: Column, k: Column) -> Column:
            begin = s["at"] + F.length(F.element_at(gaps, k))
            end = begin + F.length(F.element_at(matches, k))
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(ok(k), F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

        return add

    zero = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    walk = lambda gaps: F.aggregate(F.sequence(F.lit(1), F.size(matches)), zero, step(gaps), lambda s: s["out"])
    # the gaps are a lambda's argument, so that the text is split once, not once for each match
    return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), walk)).otherwise(nothing)


def length_class(s: Column) -> Column:
    return F.least(F.floor(2 * F.log2(F.length(s))), F.lit(LAST_CLASS)).cast("int")


def tested(s: Column) -> Column:
    """Struct of a string's p, encoding (its number; null if none fits) and class; p is null without an encoding, or if the string is too short."""
    number = F.lit(None).cast("int")
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        number = F.when(s.rlike(pattern), k).otherwise(number)
    alphabet = lambda k: F.element_at(F.array(*(F.lit(x) for _, _, x in ENCODINGS)), k + 1)
    p = lambda a: F.when(F.length(s) * F.log2(F.length(a)) >= MIN_BITS, randomness(s, a))
    return let(number, lambda k: F.struct(F.when(k.isNotNull(), let(alphabet(k), p)).alias("p"), k.alias("encoding"), length_class(s).alias("class")))


def _tested(text: Column, span: Column) -> Column:
    """span with what tested() says of it."""
    joined = lambda x: F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"), x["p"].alias("p"), x["encoding"].alias("encoding"), x["class"].alias("class"))
    return let(F.substring(text, span["start"] + 1, span["end"] - span["start"]), lambda s: let(tested(s), joined))


def decoys(spark: SparkSession, strata: list[tuple[int, int]], each: int = DECOYS) -> DataFrame:
    """encoding, class, text of ordinary strings, each of them for every (encoding, class): words by a hash of the row's number, in the encoding's style, cut to a length of the class. Counters stand for hexadecimal."""
    i = F.col("id")
    pick = lambda n, *salt: F.pmod(F.xxhash64(i, *salt), F.lit(n)).cast("int")
    letter = lambda letters, *salt: F.substring(F.lit(letters), 1 + pick(len(letters), *salt), F.lit(1))
    words, out = F.array(*map(F.lit, WORDS)), F.lit(None).cast("string")
    at = F.pmod(i, F.lit(len(strata))).cast("int")
    rows = spark.range(each * len(strata)).withColumn("at", at).withColumn("stratum", F.element_at(F.array(*(F.struct(F.lit(e).alias("encoding"), F.lit(c).alias("class")) for e, c in strata)), F.col("at") + 1))
    c = F.col("stratum.class")
    low = F.greatest(F.ceil(F.pow(F.lit(2.0), c / 2)), F.lit(LEAST_LENGTH))
    high = F.when(c == LAST_CLASS, F.lit(256)).otherwise(F.ceil(F.pow(F.lit(2.0), (c + 1) / 2)) - 1)
    length = (low + F.pmod(F.xxhash64(i, F.lit(1)), F.greatest(high - low + 1, F.lit(1)))).cast("int")
    for e in sorted({e for e, _ in strata}):
        name = ENCODINGS[e][0]
        if STYLES[name] is None:
            step, first = 1 + pick(40, F.lit(2)), pick(1 << 30, F.lit(3))
            parts = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.lpad(F.hex(first + k * step), 8, "0"))  # noqa: B023
            made = F.array_join(parts, "")
            made = F.lower(made) if name == "hex" else made
        else:
            case, separators, digits = STYLES[name]
            word = lambda k: F.element_at(words, 1 + pick(len(WORDS), k, F.lit(4)))
            cased = {"lower": word, "UPPER": lambda k: F.upper(word(k)), "Title": lambda k: F.when((k > 1) | (pick(2, F.lit(5)) == 0), F.initcap(word(k))).otherwise(word(k))}[case]  # noqa: B023
            tail = (lambda k: F.when((k == 1) | (pick(4, k, F.lit(6)) == 0), letter(digits, k, F.lit(7))).otherwise("")) if digits else (lambda k: F.lit(""))  # noqa: E731, B023
            between = letter(separators, F.lit(8)) if separators else F.lit("")
            made = F.array_join(F.transform(F.sequence(F.lit(1), 1 + (length / 3).cast("int")), lambda k: F.concat(cased(k), tail(k), between)), "")  # noqa: B023
        out = F.when(F.col("stratum.encoding") == e, made).otherwise(out)
    return rows.select("stratum.*", F.substring(out, F.lit(1), length).alias("text"))


def _bin(p: Column) -> Column:
    """Bins of p, BINS a decade; more random strings have smaller ones."""
    return F.floor(-F.log10(p) * BINS).cast("int")


def ordinary_p(decoys: list[tuple[int, int]]) -> Callable[[int], float]:
    """p of a bin under the decoys' (bin, count): the share of them in it or in smaller ones; below the TAIL quantile, an exponential with the mean excess there."""
    decoys, total = sorted(decoys), sum(n for _, n in decoys)
    upto = list(accumulate(n for _, n in decoys))
    edge, share = next((b, u / total) for (b, _), u in zip(decoys, upto, strict=True) if u >= TAIL * total)
    beyond = [(edge - b, n) for b, n in decoys if b < edge]
    mean = sum(x * n for x, n in beyond) / sum(n for _, n in beyond) if beyond else 1.0

    def p(b: int) -> float:
        if b < edge:
            return share * math.exp(-(edge - b) / mean)
        return (1 + max((u for (x, _), u in zip(decoys, upto, strict=True) if x <= b), default=0)) / (1 + total)

    return p


def cutoffs(found: DataFrame, column: str, rate: float = FALSE_DISCOVERY) -> dict[tuple[int, int], int]:
    """By encoding and class of lengths, the largest bin of p that is reported. Counts by bin come to the driver: 2001 rows at most for each encoding and class."""
    odd = found.select(F.explode(f"{column}.odd").alias("o")).select("o.*")
    counted = lambda df: df.groupBy("encoding", "class", _bin(F.col("p")).alias("bin")).count().collect()
    mine = counted(odd)
    strata = sorted({(r["encoding"], r["class"]) for r in mine})
    if not strata:
        return {}
    # written between the steps, so that each string is made and tested once
    made = written(decoys(found.sparkSession, strata), "decoys").select("encoding", "class", tested(F.col("text")).alias("t"))
    fitting = written(made, "decoys").where("t.p is not null and t.encoding = encoding and t.class = class").select("encoding", "class", "t.p")
    ordinary: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in counted(fitting):
        ordinary.setdefault((r["encoding"], r["class"]), []).append((r["bin"], r["count"]))
    null = {k: ordinary_p(some) for k, some in ordinary.items()}
    ps = [(null.get((r["encoding"], r["class"]), lambda b: 1.0)(r["bin"]), r["count"], (r["encoding"], r["class"]), r["bin"]) for r in mine]
    total, rank, limit = sum(n for _, n, _, _ in ps), 0, -1.0
    ps.sort(key=lambda x: x[0])
    for k, (p, n, _, _) in enumerate(ps):
        rank += n
        if (k + 1 == len(ps) or ps[k + 1][0] > p) and p <= rate * rank / total:
            limit = p
    passes = math.floor(-math.log10(BATTERY) * BINS)
    out: dict[tuple[int, int], int] = {}
    for p, _, stratum, b in ps:
        if p <= limit and b < passes:
            out[stratum] = max(b, out.get(stratum, b))
    return out


def all_spans(found: Column, cut: dict[tuple[int, int], int]) -> Column:
    """Base spans and the candidates that are reported, by start, then kind."""
    plain = lambda o: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), o["end"].alias("end"))

    def stays(o: Column) -> Column:
        most = F.lit(-1)
        for (encoding, cls), b in sorted(cut.items()):
            most = F.when((o["encoding"] == encoding) & (o["class"] == cls), b).otherwise(most)
        return _bin(o["p"]) <= most

    return F.array_sort(F.concat(found["base"], F.transform(F.filter(found["odd"], stays), plain)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans, for each row of docs (doc_id, text; others are left out).

    Null text is empty: no spans. Repeated rows and null ids stay.
    """
    rows = written(scan(docs.select("doc_id", "text")).drop("text"), "secrets")
    cut = cutoffs(rows, "found")
    count = lambda k: F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("found.base")), 256).alias("base_sha256"), listed(all_spans(F.col("found"), cut)).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs, all rows and columns, with each run of overlapping spans in text replaced by mask; n_chars, where there is one, follows."""
    found = fresh(docs, "found")
    rows = written(scan(docs), "secrets")
    spans = all_spans(F.col(found), cutoffs(rows, found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        part = F.array(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        grown = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts"))
        return F.when((x["start"] < s["at"]) & (s["at"] > 0), grown).otherwise(F.struct(x["end"].alias("at"), F.concat(s["parts"], part).alias("parts")))

    finish = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    whole = let(spans, lambda x: F.when(F.size(x) > 0, F.aggregate(x, start, step, finish)).otherwise(F.col("text")))
    out = rows.withColumn("text", whole).drop(found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
