"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

All in SQL functions. For each kind one pattern takes a text apart into (gap, match) pairs, whole texts, leftmost and
non-overlapping; the pairs' lengths add up to code-point offsets. Texts without a kind's telltale character skip its
pattern, and only matches leave the scan.

The patterns below give the spans of their plain forms, in linear time: what can't be extended is possessive, and a
match may start inside a run of its own first class only right after the match before (\\G).

Scores: a kind's base, CONTEXT_GAIN more if one of its context words stands within CONTEXT code points of the span,
less if one of the words does that speak against it. The four base kinds are reported whatever their score; the further
kinds (IBANs of their country's length that pass mod-97, hexadecimal secrets) from REPORT on.

Nulls: a null text is empty, without spans. Repeated rows are reported each. Empty tables give empty results. Further
columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole

CONTEXT, CONTEXT_GAIN, REPORT = 40, 0.25, 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    telltale: str
    score: float
    context: str
    against: str = "version|release|chapter|section"
    base: bool = True


#: How long a country's IBANs are: fixed values, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An IBAN of the length that its country's have, in groups of any size.
IBAN = "(?:" + "|".join(rf"(?:{countries.replace(' ', '|')})[0-9][0-9](?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items()) + ")"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, "address|host|server|login"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, "card|visa|payment|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "call|phone|tel|fax|mobile"),
    Kind("iban", rf"(?<![A-Za-z0-9_]){IBAN}(?![A-Za-z0-9_])", r"[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|transfer", base=False),
    Kind("secret", r"(?<![0-9A-Za-z_])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z_])", r"[0-9A-Fa-f]{32}", 0.4, "token|key|secret|password", base=False),
)


def _pairs(text: Column, kind: Kind) -> Column:
    """A text's (gap length, the gap's head and tail, match) pairs; the last one has an empty match."""
    pattern = F.lit(rf"(?s)(.*?)(?:({kind.pattern})|\z)")
    gaps, matches = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2))
    pair = lambda g, m: F.struct(
        F.length(g).alias("gap"), F.left(g, F.lit(CONTEXT)).alias("head"), F.right(g, F.lit(CONTEXT)).alias("tail"), m.alias("match")
    )
    present = text.contains(kind.telltale) if kind.telltale == "@" else text.rlike(kind.telltale)
    return F.when(present, F.zip_with(gaps, matches, pair))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN's number: country and check digits last, letters as 10 to 35."""
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(digit(c) > 9, (acc * 100 + digit(c)) % 97).otherwise((acc * 10 + digit(c)) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _confirmed(kind: Column, match: Column) -> Column:
    """Whether a proposed span passes its kind's validator."""
    digits = _digits(match)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    tests = {
        "email": F.lit(True), "ip": match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), "card": F.length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(8, 15), "iban": _mod97(match) == 1, "secret": match.rlike("[0-9]") & match.rlike("[A-Fa-f]"),
    }
    result = F.lit(False)
    for name, test in tests.items():
        result = F.when(kind == name, test).otherwise(result)
    return result


def _proposals(docs: DataFrame) -> DataFrame:
    """Every document's pairs by kind, written once: _row, doc_id, one column a kind."""
    text = whole("text")
    found = docs.select("doc_id", *(_pairs(text, k).alias(k.name) for k in KINDS))
    return table(found.select(F.monotonically_increasing_id().alias("_row"), *found.columns), "pii-pairs")


def _spans(rows: DataFrame) -> DataFrame:
    """_row, doc_id, kind_no, kind, start, end, match, score of confirmed spans."""
    every = None
    for no, kind in enumerate(KINDS):
        pairs = rows.where(F.col(kind.name).isNotNull()).select("_row", "doc_id", F.lit(no).alias("kind_no"), F.lit(kind.name).alias("kind"), F.posexplode(kind.name).alias("at", "pair"))
        every = pairs if every is None else every.unionByName(pairs)
    inside = Window.partitionBy("_row", "kind_no").orderBy("at")
    gap, size = F.col("pair.gap"), F.length("pair.match")
    found = every.select(
        "_row", "doc_id", "kind_no", "kind", F.col("pair.match").alias("match"), F.col("pair.tail").alias("tail"),
        F.lead("pair.head").over(inside).alias("head"), F.sum((gap + size).cast("long")).over(inside).alias("end"),
    ).where("match <> ''")
    found = found.where(_confirmed(F.col("kind"), F.col("match"))).withColumn("start", F.col("end") - F.length("match"))
    near = F.lower(F.concat_ws(" ", "tail", "head"))
    score = F.lit(None).cast("double")
    for kind in KINDS:
        gain = F.when(near.rlike(kind.context), CONTEXT_GAIN).otherwise(0.0) - F.when(near.rlike(kind.against), CONTEXT_GAIN).otherwise(0.0)
        score = F.when(F.col("kind") == kind.name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + gain))).otherwise(score)
    return found.select("_row", "doc_id", "kind_no", "kind", "start", "end", "match", score.alias("score"))


def find_spans(docs: DataFrame, report: float = REPORT) -> DataFrame:
    """doc_id, kind, start, end, match, score of every reported span; offsets in code points, end exclusive."""
    base = [k.name for k in KINDS if k.base]
    found = _spans(_proposals(docs)).where(F.col("kind").isin(base) | (F.col("score") >= report))
    return found.select("doc_id", "kind", "start", "end", "match", "score")


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    rows = _proposals(docs)
    n_base = sum(k.base for k in KINDS)
    found = _spans(rows).where((F.col("kind_no") < n_base) | (F.col("score") >= REPORT))
    place = F.struct("kind_no", "start", "end")
    counts = [F.count_if(F.col("kind_no") == no).alias(f"n_{k.name}") for no, k in enumerate(KINDS) if k.base]
    by_doc = found.groupBy("_row").agg(*counts, F.collect_list(F.when(F.col("kind_no") < n_base, place)).alias("_base"), F.collect_list(place).alias("_all"))
    by_doc = by_doc.select("_row", *(f"n_{k.name}" for k in KINDS if k.base), _joined(F.col("_base")).alias("_base"), _joined(F.col("_all")).alias("_all"))
    joined = rows.select("_row", "doc_id").join(by_doc, "_row", "left")
    return joined.select(
        "doc_id", *(F.coalesce(f"n_{k.name}", F.lit(0)).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"),
    )
