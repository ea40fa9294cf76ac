"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Base spans: email, ip, card and phone patterns with their exact checks. They always stay.
2. High-recall generators propose overlapping candidate spans: runs of digits and separators, and
   in them whatever is shaped like a phone or card number or stands between spaces; anything around
   an @, and the address in it; values assigned to a secret-like name.
3. Boosted trees over yes/no features of a candidate's format and context give its probability.
   They are learnt on a bounded table of labelled examples that is generated by rule
   (EXAMPLES rows), as no labelled personal data exists; equal feature vectors are counted by
   Spark, so the driver sees only the distinct ones.
4. Of the candidates above their kind's threshold, calibrated on examples set aside for at least
   PRECISION, the most probable of those that overlap stay, and are added unless a base span holds
   them whole.

Everything on the way of a text is a projection: no shuffle, no collected documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
EXAMPLES = 12_000
PRECISION = 0.99
MARK = "\u0001"
#: Characters of context before and after a candidate that its features look at.
LEFT, RIGHT = 24, 2
# fixed values: the base patterns, written so that they cannot backtrack
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# candidate patterns
NUMBERS = r"(?<![0-9A-Za-z])[(+]?[0-9][0-9().+\x20-]{5,}[0-9](?![0-9A-Za-z])"
_TEN = r"[(]?[0-9]{3}[)]?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}"
TEN = rf"(?<![0-9A-Za-z]){_TEN}(?![0-9A-Za-z])"
ABROAD = rf"\+[0-9]{{1,3}}[\x20.-]?(?:{_TEN}|[(]?[0-9]{{1,4}}[)]?[\x20.-]?[0-9]{{3,8}}(?:[.-][0-9]{{2,4}}){{0,3}})(?![0-9A-Za-z])"
GROUPS = r"(?<![0-9A-Za-z])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])"
PIECE = r"(?<![0-9A-Za-z])[0-9]++(?:[./-][0-9]++)*+(?![0-9A-Za-z])"
ADDRESS = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++"
AROUND_AT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
SECRET = r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9_+/=-]{8,}+"


def find_spans(text: Column, pattern: str) -> Column:
    """(start, end, t) of all leftmost matches, in code points, end exclusive; text holds no MARK.

    Matches are marked, the text is split there, and the lengths of the pieces are added up.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int,t:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        here = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), part.alias("t"))
        return F.struct((acc["at"] + size).alias("at"), (acc["i"] + 1).alias("i"), F.when(acc["i"] % 2 == 1, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def is_card(t: Column) -> Column:
    d = _digits(t)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def is_ip(t: Column) -> Column:
    return t.rlike(f"^{BYTE}(?:[.]{BYTE}){{3}}$")


def is_phone(t: Column) -> Column:
    return F.length(_digits(t)).between(9, 15)


# ------------------------------------------------------------------ features
# name -> test of a candidate c (kind, t, left, right); kind is number, mail or secret
_SPOKEN = "(?i)(?<!\\p{L})(?:tel|phone|telephone|call|fax|mobile|cell|whatsapp|contact)[^A-Za-z0-9]*$"
_COUNTED = "(?i)(?<!\\p{L})(?:order|invoice|no|nr|number|version|page|isbn|issn|id|total|item|ref|part|room|art)[^A-Za-z0-9]*$"
_COUNTED_RUN = "(?i)(?<!\\p{L})(?:order|invoice|no|nr|number|version|page|isbn|issn|id|total|item|ref|part|room|art)[^A-Za-z]*$"


def _features(c: Column) -> list[tuple[str, Column]]:
    t, d = c["t"], F.length(_digits(c["t"]))
    value = F.regexp_extract(t, "[A-Za-z0-9_+/=-]+$", 0)
    return [
        ("number", c["kind"] == "number"),
        ("mail", c["kind"] == "mail"),
        ("three-three-four", t.rlike(r"^[(]?[0-9]{3}[)]?[ .-][ ]?[0-9]{3}[ .-][0-9]{4}$")),
        ("three-three-four-and-more", t.rlike(f"(?<![0-9]){_TEN}(?![0-9])") & ~t.rlike(f"^(?:[+][0-9]{{1,3}}[ .-]?)?{_TEN}$")),
        ("plus", t.startswith("+")),
        ("bracket", t.startswith("(")),
        ("digits7-8", d.between(7, 8)),
        ("digits9-11", d.between(9, 11)),
        ("digits12-19", d.between(12, 19)),
        ("digits20", d >= 20),
        ("luhn", is_card(t)),
        ("card-groups", t.rlike(f"^{GROUPS}$")),
        ("octets", is_ip(t)),
        ("separated", t.rlike("[0-9][ .-]+[0-9]")),
        ("date", t.rlike("^[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}$")),
        ("range", t.rlike("^(?:19|20)[0-9]{2}[ -]+(?:19|20)[0-9]{2}$")),
        ("single-steps", t.rlike("^[0-9](?:[ .-]+[0-9]{1,2})*$")),
        ("domain", t.rlike(r"@[^@]*[\p{L}0-9-]+[.]\p{L}{2,}[.,;:!?]*$")),
        ("local", t.rlike(r"^[\p{L}0-9][^@]*@")),
        ("mixed", value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
        ("long-value", F.length(value) >= 12),
        ("spoken", c["left"].rlike(_SPOKEN)),
        ("counted", c["left"].rlike(_COUNTED)),
        ("counted-run", c["left"].rlike(_COUNTED_RUN)),
        ("unit-left", c["left"].rlike("[$€£#§]\\s?$")),
        ("unit-right", c["right"].rlike("^[%°€$£]|^ [%€$£]")),
    ]


# ------------------------------------------------------------------ labelled examples
def examples(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """(kind, t, left, right, label, aside): generated candidates, true and false, a third of them set aside."""
    draw = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    pick = lambda k, *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(x))) + 1).cast("int"))
    octet = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256)).cast("string")
    hexa = lambda k, n: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 256), 1, n)
    fifteen = F.concat(pick(1, "4", "5", "3"), draw(2, 14))
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(fifteen, c.cast("string"))), luhn), 1)
    wrong = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(fifteen, c.cast("string"))), lambda x: ~luhn(x)), 1)
    word = pick(3, "the ", "and ", "with ", "")
    told = F.concat(pick(4, "call ", "phone: ", "tel. ", "the ", "on ", ""))
    named = F.concat(pick(5, "order ", "invoice no. ", "id ", "page ", "version ", "ISBN ", "total "))
    sep = pick(6, " ", "-", ".")
    # (kind, label, text, left, right)
    families = [
        ("number", 1, F.concat(F.lit("("), draw(10, 3), F.lit(") "), draw(11, 3), F.lit("-"), draw(12, 4)), told, F.lit(" ")),
        ("number", 1, F.concat(draw(13, 3), sep, draw(14, 3), sep, draw(15, 4)), told, F.lit(" ")),
        ("number", 1, F.concat(F.lit("+"), draw(16, 2), F.lit(" "), draw(17, 3), F.lit(" "), draw(18, 6)), told, F.lit(" ")),
        ("number", 1, check, word, F.lit(" ")),
        ("number", 1, F.concat_ws(".", octet(20), octet(21), octet(22), octet(23)), word, F.lit(" ")),
        ("mail", 1, F.concat(hexa(24, 6), F.lit("@"), hexa(25, 5), pick(26, ".com", ".org", ".example.net")), word, F.lit(" ")),
        ("mail", 1, F.concat(F.lit("jürg."), draw(27, 2), F.lit("@müller.de")), word, F.lit(" ")),
        ("secret", 1, F.concat(pick(28, "password=", "token: ", 'token = "', "api_key="), hexa(29, 18)), word, F.lit(" ")),
        ("secret", 1, F.concat(pick(28, "password=", "secret: ", 'token = "'), hexa(30, 40)), word, F.lit('"')),
        ("number", 0, draw(31, 5), word, F.lit(" ")),
        ("number", 0, draw(32, 10), named, F.lit(" ")),
        ("number", 0, draw(33, 8), word, F.lit(" ")),
        ("number", 0, wrong, word, F.lit(" ")),
        ("number", 0, F.concat_ws("-", draw(34, 4), draw(35, 2), draw(36, 2)), word, F.lit(" ")),
        ("number", 0, F.concat(F.lit("19"), draw(38, 2), pick(37, " - ", "-"), F.lit("20"), draw(39, 2)), word, F.lit(" ")),
        ("number", 0, F.concat_ws(".", draw(40, 1), draw(41, 1), draw(42, 2)), named, F.lit(" ")),
        ("number", 0, F.concat_ws(".", F.lit("999"), draw(43, 3), draw(44, 3), draw(45, 3)), word, F.lit(" ")),
        ("number", 0, F.concat_ws(" ", draw(46, 1), draw(47, 2), draw(48, 1), draw(49, 2), draw(50, 1)), word, F.lit(" ")),
        ("number", 0, draw(51, 6), pick(52, "$", "€ ", "#"), pick(53, "%", " ")),
        ("number", 0, F.concat(draw(54, 12), draw(55, 12)), word, F.lit(" ")),
        ("number", 0, F.concat(draw(56, 3), F.lit(" "), draw(57, 3), F.lit(" "), draw(58, 4)), named, F.lit(" ")),
        # numbers side by side: each for itself, not the run
        ("number", 1, F.concat(draw(64, 3), sep, draw(65, 3), sep, draw(66, 4)), F.concat(word, draw(67, 3), F.lit("-"), draw(68, 3), F.lit("-"), draw(69, 4), F.lit(" ")), F.lit(" ")),
        ("number", 1, F.concat(draw(70, 3), sep, draw(71, 3), sep, draw(72, 4)), F.concat(told, draw(73, 4), F.lit("-"), draw(74, 2), F.lit("-"), draw(75, 2), F.lit(" ")), pick(76, " ", " 2", " (")),
        ("number", 1, F.regexp_replace(check, "^(....)(....)(....)(....)$", "$1 $2 $3 $4"), word, pick(97, " ", " 2", " (")),
        ("number", 0, F.regexp_replace(wrong, "^(....)(....)(....)(....)$", "$1 $2 $3 $4"), word, F.lit(" ")),
        ("number", 0, F.concat(draw(77, 3), sep, draw(78, 3), sep, draw(79, 4), F.lit(" "), draw(80, 3), sep, draw(81, 3), sep, draw(82, 4)), told, F.lit(" ")),
        ("number", 0, F.concat(F.lit("("), draw(83, 3), F.lit(") "), draw(84, 3), F.lit("-"), draw(85, 4), F.lit(" "), draw(86, 2)), told, F.lit(" ")),
        ("number", 0, F.concat(draw(87, 4), F.lit("-"), draw(88, 2), F.lit("-"), draw(89, 2), F.lit(" "), draw(90, 3), sep, draw(91, 3), sep, draw(92, 4)), told, F.lit(" ")),
        ("number", 0, F.concat(draw(93, 3), F.lit(" "), draw(94, 3), F.lit(" "), draw(95, 4)), F.concat(named, draw(96, 3), F.lit(" ")), F.lit(" ")),
        ("mail", 0, F.concat(F.lit("@"), hexa(59, 6)), word, F.lit(" ")),
        ("mail", 0, F.concat(F.lit("3@"), draw(60, 2)), word, F.lit(" ")),
        ("mail", 0, F.concat(F.lit("foo@"), hexa(61, 4)), word, F.lit(" ")),
        ("secret", 0, F.lit("password=undefined"), word, F.lit(" ")),
        ("secret", 0, F.concat(F.lit("token: "), pick(62, "identifier", "separator", "unlimited")), word, F.lit(" ")),
        ("secret", 0, F.concat(F.lit("secret="), draw(63, 8)), word, F.lit(" ")),
    ]
    rows_of = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("t"), left.alias("left"), right.alias("right"), F.lit(y).alias("label")) for k, y, t, left, right in families))
    base = spark.range(rows).select(F.element_at(rows_of, (F.col("id") % len(families) + 1).cast("int")).alias("x"), (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(3)) == 0).alias("aside"))
    return base.select("x.*", "aside")


# ------------------------------------------------------------------ boosted trees
@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    yes: Node | None = None
    no: Node | None = None


@dataclass
class Trees:
    bias: float
    trees: list[Node] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)  # log-odds by kind of candidate

    def logit(self, bits: tuple[bool, ...]) -> float:
        total = self.bias
        for node in self.trees:
            while node.feature >= 0:
                node = node.yes if bits[node.feature] else node.no
            total += node.value
        return total

    def column(self, bits: Column) -> Column:
        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(bits[node.feature], of(node.yes)).otherwise(of(node.no))

        return reduce(lambda a, b: a + b, map(of, self.trees), F.lit(self.bias))


def boost(data: list[tuple[tuple[bool, ...], int, int]], rounds: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Trees:
    """Newton boosting of log loss over (features, zeros, ones) counts."""
    zeros, ones = sum(x[1] for x in data), sum(x[2] for x in data)
    model = Trees(math.log((ones + 1) / (zeros + 1)))
    width = len(data[0][0]) if data else 0

    def grow(rows: list[tuple[tuple[bool, ...], float, float]], level: int) -> Node:
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        leaf = Node(rate * g / (h + ridge))
        best, at = 1e-3, -1
        for f in range(width if level else 0):
            gy, hy = sum(r[1] for r in rows if r[0][f]), sum(r[2] for r in rows if r[0][f])
            gain = gy * gy / (hy + ridge) + (g - gy) ** 2 / (h - hy + ridge) - g * g / (h + ridge)
            if gain > best:
                best, at = gain, f
        if at < 0:
            return leaf
        return Node(0.0, at, grow([r for r in rows if r[0][at]], level - 1), grow([r for r in rows if not r[0][at]], level - 1))

    for _ in range(rounds):
        rows = []
        for bits, n0, n1 in data:
            p = 1 / (1 + math.exp(-model.logit(bits)))
            rows.append((bits, n1 - (n0 + n1) * p, (n0 + n1) * p * (1 - p)))
        model.trees.append(grow(rows, depth))
    return model


def fit_trees(spark: SparkSession, precision: float = PRECISION) -> Trees:
    """Learn on two thirds of the examples; each kind's threshold is the lowest with that precision on the rest."""
    found = examples(spark).select(F.struct("kind", "t", "left", "right").alias("c"), "label", "aside")
    bits = F.array(*(f for _, f in _features(F.col("c"))))
    counted = found.groupBy(F.col("c.kind").alias("kind"), bits.alias("bits"), "aside").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).collect()
    rows = sorted((tuple(r.bits), r.n0, r.n1, r.kind, r.aside) for r in counted)
    model = boost([r[:3] for r in rows if not r[4]])
    scored = defaultdict(list)
    for bits, n0, n1, kind, aside in rows:
        if aside:
            scored[kind].append((model.logit(bits), n0, n1))
    for kind, own in scored.items():
        good, best, bad = 0, math.inf, 0
        for score, n0, n1 in sorted(own, reverse=True):
            good, bad = good + n1, bad + n0
            if good >= precision * (good + bad):
                best = score
        model.thresholds[kind] = best - 1e-9
    return model


# ------------------------------------------------------------------ scan
def _tagged(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


SPAN = "array<struct<start:int,k:int,end:int>>"


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def base_spans(text: Column) -> Column:
    """(start, k, end) of the base spans by start, then kind. Texts without @ or digits skip the patterns."""
    digit = text.rlike("[0-9]")
    when = lambda test, spans: F.when(test, spans).otherwise(_none())
    every = F.concat(
        when(F.contains(text, F.lit("@")), _tagged(find_spans(text, EMAIL), "email")),
        when(text.rlike("[0-9][.][0-9]"), _tagged(F.filter(find_spans(text, IP), lambda s: is_ip(s["t"])), "ip")),
        when(digit, _tagged(F.filter(find_spans(text, CARD), lambda s: is_card(s["t"])), "card")),
        when(F.contains(text, F.lit("+")), _tagged(F.filter(find_spans(text, PHONE), lambda s: is_phone(s["t"])), "phone")),
    )
    return F.array_sort(every)


def candidates(text: Column) -> Column:
    """(kind, start, end, t, left, right) proposed by the generators."""
    schema = "array<struct<kind:string,start:int,end:int,t:string,left:string,right:string>>"

    def of(spans: Column, kind: str) -> Column:
        def more(s: Column) -> Column:
            left = F.substr(text, F.greatest(s["start"] - LEFT, F.lit(0)) + 1, F.least(s["start"], F.lit(LEFT)))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["t"].alias("t"), left.alias("left"), F.substr(text, s["end"] + 1, F.lit(RIGHT)).alias("right"))

        return F.transform(spans, more)

    when = lambda test, spans: F.when(test, spans).otherwise(_none(schema))
    long = lambda pattern: F.filter(find_spans(text, pattern), lambda s: s["end"] - s["start"] >= 7)
    numbers = F.concat(*map(long, (NUMBERS, TEN, GROUPS, PIECE)), F.when(F.contains(text, F.lit("+")), long(ABROAD)).otherwise(_none("array<struct<start:int,end:int,t:string>>")))
    return F.concat(
        when(text.rlike("[0-9][^A-Za-z]{5}"), of(F.array_distinct(numbers), "number")),
        when(F.contains(text, F.lit("@")), of(F.array_distinct(F.concat(find_spans(text, AROUND_AT), find_spans(text, ADDRESS))), "mail")),
        when(text.rlike("(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ ]?[=:]"), of(find_spans(text, SECRET), "secret")),
    )


def detect_pii(docs: DataFrame, model: Trees, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with two columns added, <out>_base and <out>_spans: arrays of (start, k, end) by start, then kind.

    k indexes KINDS; positions count code points, end exclusive. Null and empty texts have empty
    arrays. Columns of those names are replaced; all others stay.
    """
    # MARK is in no pattern's reach, so another control character may stand for it
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, "\u0003")
    rows = docs.withColumn(f"{out}_text", clean).withColumn(f"{out}_base", base_spans(F.col(f"{out}_text"))).withColumn(f"{out}_found", candidates(F.col(f"{out}_text")))

    def judged(c: Column) -> Column:
        bits = F.array(*(f for _, f in _features(c)))
        limit = reduce(lambda rest, kv: F.when(c["kind"] == kv[0], F.lit(kv[1])).otherwise(rest), model.thresholds.items(), F.lit(math.inf))
        kind = F.when(c["kind"] == "mail", 0).when(c["kind"] == "secret", 4).when(is_ip(c["t"]), 1).when(is_card(c["t"]), 2).otherwise(3)
        # closing marks of a sentence are not part of an address
        end = F.when(c["kind"] == "mail", c["end"] - F.length(F.regexp_extract(c["t"], "[.,;:!?]*$", 0))).otherwise(c["end"])
        return F.struct(bits.alias("bits"), limit.alias("limit"), c["kind"].alias("kind"), c["start"].alias("start"), kind.alias("k"), end.cast("int").alias("end"))

    def scored(c: Column) -> Column:
        # the most probable first; of equals the tightest address, the longest number or secret
        size = c["end"] - c["start"]
        order = F.when(c["kind"] == "mail", size).otherwise(-size)
        return F.struct((-model.column(c["bits"])).alias("low"), order.alias("order"), c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["kind"].alias("kind"), c["limit"].alias("limit"))

    def apart(chosen: Column, c: Column) -> Column:
        meets = F.exists(chosen, lambda o: (o["kind"] == c["kind"]) & (o["start"] < c["end"]) & (c["start"] < o["end"]))
        return F.when(meets, chosen).otherwise(F.array_append(chosen, F.struct(*(c[x].alias(x) for x in ("kind", "start", "k", "end")))))

    base = F.col(f"{out}_base")
    rated = F.transform(F.col(f"{out}_found"), judged)
    likely = F.array_sort(F.filter(F.transform(F.col(f"{out}_rated"), scored), lambda c: -c["low"] >= c["limit"]))
    chosen = F.aggregate(F.col(f"{out}_likely"), F.array().cast("array<struct<kind:string,start:int,k:int,end:int>>"), apart)
    beside = F.filter(chosen, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    added = F.transform(beside, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end")))
    rows = rows.withColumn(f"{out}_rated", rated).withColumn(f"{out}_likely", likely)
    rows = rows.withColumn(f"{out}_spans", F.when(F.size(f"{out}_likely") > 0, F.array_sort(F.array_distinct(F.concat(base, added.cast(SPAN))))).otherwise(base))
    return rows.drop(f"{out}_text", f"{out}_found", f"{out}_rated", f"{out}_likely")


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], between, F.element_at(names, s["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
