"""Personal data by weak supervision, with DataFrame functions only.

Base spans are the matches of four patterns that pass their checks (email, ip, card, phone).
Candidates are these, the matches that fail a check, and what three wider patterns find (phone
numbers without a plus, spelt-out addresses, secrets).  Four labelers vote on each candidate,
for (1), against (-1) or not at all (0): the pattern's own check, a gazetteer (domains, calling
codes, issuers, reserved addresses, key names), the words before it, and the characters around
it.  Votes are counted by pattern over all documents - a few hundred patterns, whatever the
corpus - and expectation-maximisation estimates each labeler's reliability for each kind from
the counts alone.

The posteriors are soft labels for the span classifier, a logistic regression over features of
the span (length, digits, separators, letters) and of its context (the characters around it and
the word before it, hashed), which the labelers mostly don't look at.  Each step is an aggregate
over the table of distinct feature lists with their counts; only `FEATURES` sums reach the driver.
Candidates of probability 0.5 or more are added, those that fail their own check (such as a
card number's Luhn digit) only where words before them name their kind.  Base spans always stay.

Positions are code points: a text is cut by the pattern (`split`), and running sums of the
lengths of gaps and matches give each match's place, so no position is searched for.  What a
lambda needs more than once is bound first (`bound`), so the work stays in proportion to the text.

A null or empty text has no spans.  Repeated rows give repeated results; other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, saved

KINDS = ("email", "ip", "card", "phone", "secret")
#: Places of the classifier's weights; a feature's place is a hash of its kind, name and value.
FEATURES = 1024
#: Characters of a block in which a text is cut to replace spans.
CUT = 4096
#: Patterns of the base spans, without backtracking into what is taken.  A match cannot start
#: within a run that could have started earlier, unless the match before it ended there.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns, for candidates only.
SPELT = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?{_HOST}++)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?\"?[0-9A-Za-z_+/-]{8,}+\"?"

_CUES = {
    "email": "mail|contact|write|address|correo|courriel|adresse",
    "ip": "ip|host|server|address|login|serveur|servidor|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|pay|tarjeta|carte|karte",
    "phone": "phone|tel|call|mobile|cell|fax|dial|whatsapp|telefon|teléfono|téléphone",
    "secret": "key|secret|password|token|credential|aws|access",
}
_AGAINST = "version|isbn|section|order|figure|page|chapter|clause|v"
_ZONES = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl"
_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|62|35"
_CALLING = "1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: within a lambda, a plain column would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def scanned(values: Column, op: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """op over all entries before each entry, from 0 on, and over all of them last; in blocks, so a long array isn't copied for every entry."""
    zero = F.lit(0)

    def before(array: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(array, start, lambda acc, n: F.struct(op(acc["at"], n).cast("int").alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))["seen"]

    def blocked(all_: Column) -> Column:
        places = F.sequence(zero, F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / block).cast("int"))
        return F.transform(places, lambda b: F.slice(all_, b * block + 1, F.lit(block)))

    def scan(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, n: op(acc, n).cast("int")))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before(totals, zero).alias("s")), lambda x: before(x["b"], x["s"])))

    return bound(F.concat(values, F.array(zero)), lambda v: bound(blocked(v), scan))


def matches(text: Column, pattern: str, kind: str, hint: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches: kind, start, end, text, the characters before and the one after; none without the hint.

    `keep` drops matches by their text before anything else is done with them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column, gaps: Column) -> Column:
        n = F.size(m)
        begin = scanned(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i))), lambda a, b: a + b)
        each = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, n).alias("gap"), F.slice(gaps, 2, n).alias("next"), F.slice(begin, 1, n).alias("at"))
        start = lambda x: x["at"] + F.length(x["gap"])
        return F.transform(
            each if keep is None else F.filter(each, lambda x: keep(x["m"])),
            lambda x: F.struct(
                F.lit(kind).alias("kind"), start(x).alias("start"), (start(x) + F.length(x["m"])).alias("end"),
                x["m"].alias("text"), F.lower(F.substring(x["gap"], -32, 32)).alias("left"), F.substring(x["next"], 1, 1).alias("right"),
            ),
        )

    # matches and gaps are bound, so each pattern runs twice and not once a use
    cut = bound(found, lambda m: F.when(F.size(m) > 0, bound(F.split(text, pattern, -1), lambda g: placed(m, g))))
    return F.when(hint, cut)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice")))
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["twice"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]))
    return total % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x["text"], "[^0-9]", "")


def checked(x: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    kind, digits = x["kind"], _digits(x)
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", x["text"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when((n >= 16) & (n <= 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", x["text"].startswith("+") & (n >= 8) & (n <= 15))
        .otherwise(False)
    )


def candidates(text: Column) -> Column:
    """All candidates of a text with base (whether it is a base span), sorted by kind as listed and start."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    at = text.contains("@")
    groups = [
        matches(text, EMAIL, "email", at),
        matches(text, SPELT, "email", text.rlike(r"[\[(]at[\])]")),
        matches(text, IP, "ip", digit & text.contains(".")),
        matches(text, CARD, "card", digit, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(13, 19)),
        matches(text, PHONE, "phone", text.contains("+")),
        F.filter(matches(text, LOCAL_PHONE, "phone", digit), lambda x: ~x["left"].rlike(r"\+[0-9][\x20().0-9-]*$")),
        matches(text, SECRET, "secret", text.contains("AKIA") | text.rlike("[=:]")),
    ]
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,left:string,right:string>>")
    every = F.concat(*[F.coalesce(g, empty) for g in groups])
    spelt = lambda x: (x["kind"] == "email") & ~x["text"].contains("@")
    return F.transform(every, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end")], (checked(x) & ~spelt(x)).alias("base"), votes(x).alias("votes"), features(x).alias("features")))


def votes(x: Column) -> Column:
    """The labelers' votes as text: check, gazetteer, words before, characters around."""
    kind, text, left, right, digits = x["kind"], x["text"], x["left"], x["right"], _digits(x)

    def by_kind(of: dict[str, Column]) -> Column:
        out = F.lit("0")
        for k, v in of.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    yes_no = lambda c: F.when(c, "+").otherwise("-")
    yes = lambda c: F.when(c, "+").otherwise("0")
    check = F.when(kind == "secret", yes(text.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))).when(kind == "phone", yes_no(F.length(digits).between(8, 15))).otherwise(yes_no(checked(x)))
    gazetteer = by_kind({
        "email": yes_no(F.lower(text).rlike(rf"(?:\.|dot[\])]\x20?)(?:{_ZONES})$")),
        "ip": F.when(text.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^1\.2\.3\.4$|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), "-").otherwise("0"),
        "card": yes_no(digits.rlike(rf"^(?:{_ISSUERS})")),
        "phone": F.when(text.startswith("+"), yes_no(text.rlike(rf"^\+(?:{_CALLING})"))).otherwise("0"),
        "secret": yes(text.rlike("^AKIA|(?i)^(?:password|passwd|pwd|secret|token|api)")),
    })
    cues = by_kind({k: yes(left.rlike(rf"(?:^|[^a-z])(?:{v})[^a-z]")) for k, v in _CUES.items()})
    context = F.when(left.rlike(rf"(?:^|[^a-z])(?:{_AGAINST})[\x20.:#]*$"), "-").otherwise(cues)
    around = yes_no(~left.rlike(r"[0-9A-Za-z_=\"]$") & ~right.rlike("[0-9A-Za-z_@]"))
    return F.concat(check, gazetteer, context, around)


def _posteriors(counts: dict[str, float], rounds: int = 40) -> dict[str, float]:
    """Probability of each vote pattern being personal data, by expectation-maximisation (Dawid and Skene) for one kind."""
    post = {p: 1 / (1 + math.exp(-sum({"+": 1.0, "-": -1.0}.get(v, 0.0) for v in p))) for p in counts}
    total = sum(counts.values())
    for _ in range(rounds):
        prior = (sum(counts[p] * post[p] for p in counts) + 1) / (total + 2)
        seen: list[dict[str, list[float]]] = []
        for k in range(len(next(iter(counts)))):
            of = {v: [1.0 if v == "-" else 0.5, 1.0 if v == "+" else 0.5] for v in "+-0"}  # a labeler is believed to be better than chance
            for p, n in counts.items():
                of[p[k]][0] += n * (1 - post[p])
                of[p[k]][1] += n * post[p]
            sums = [sum(x[y] for x in of.values()) for y in (0, 1)]
            seen.append({v: [x[0] / sums[0], x[1] / sums[1]] for v, x in of.items()})
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(seen[k][v][1] / seen[k][v][0]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def features(x: Column) -> Column:
    """Places of what the classifier reads: the span's shape and its context, each with its kind."""
    text, left, digits = x["text"], x["left"], _digits(x)
    read = {
        "kind": F.lit(""),
        "digits": F.least(F.length(digits), F.lit(24)).cast("string"),
        "different": F.size(F.array_distinct(F.split(digits, ""))).cast("string"),
        "first": F.substring(digits, 1, 2),
        "length": F.floor(F.log2(F.length(text) + 1) * 2).cast("string"),
        "marks": F.substring(F.regexp_replace(text, "[0-9A-Za-z]", ""), 1, 4),
        "letters": F.concat(*[F.when(text.rlike(c), "1").otherwise("0") for c in ("[a-z]", "[A-Z]", "[0-9]")]),
        "end": F.regexp_extract(F.lower(text), "([a-z]{1,4})[^a-z]*$", 1),
        "before": F.substring(left, -1, 1),
        "after": x["right"],
        "word": F.regexp_extract(left, r"(\p{L}+)\P{L}*$", 1),
    }
    return F.array(*[F.pmod(F.xxhash64(x["kind"], F.lit(name), value), F.lit(FEATURES)).cast("int") for name, value in read.items()])


def chance(places: Column, weights: list[float]) -> Column:
    """The classifier's probability from a span's feature places."""
    table_ = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant, folded once
    return 1 / (1 + F.exp(-F.aggregate(places, F.lit(0.0), lambda acc, k: acc + F.get(table_, k))))


def learn(groups: DataFrame, soft: dict[tuple[str, str], float], steps: int = 24, rate: float = 0.4) -> list[float]:
    """Weights of a logistic regression on soft labels by (kind, votes), from groups (kind, votes, features, count); Adam over whole passes.

    Rare features move little (the 1e-2 below).  Kinds count alike, and within a kind a group by the logarithm of how often it was seen and by whether gazetteer and
    context voted: where both abstain, the posterior says little but what the kind's prior is.
    """
    weights, first, second = [0.0] * FEATURES, [0.0] * FEATURES, [0.0] * FEATURES
    label = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("votes") == v), F.lit(float(y))) for (k, v), y in sorted(soft.items())], F.lit(0.0))
    told = F.regexp_replace(F.substring("votes", 2, 2), "0", "")
    voted = F.greatest(F.lit(0.01), F.length(told).cast("double"))
    massed = saved(groups.select("kind", "features", label.alias("y"), (F.log1p("count") * voted).alias("mass")), "pii-groups")
    whole = {r["kind"]: r["mass"] for r in massed.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}  # one row a kind
    share = F.col("mass") / F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in sorted(whole.items())], F.lit(1.0))
    for step in range(1, steps + 1):
        off = (share * (chance(F.col("features"), weights) - F.col("y"))).alias("off")
        slopes = {r["k"]: r["g"] for r in massed.select(F.explode("features").alias("k"), off).groupBy("k").agg(F.sum("off").alias("g")).collect()}  # FEATURES rows at most
        now = rate * (1 - (step - 1) / steps)
        for k, g in slopes.items():
            g = round(g, 12) + 1e-4 * weights[k]  # sums in any order give one model
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            weights[k] -= now * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-2)
    return [round(w, 6) for w in weights]


def fit(found: DataFrame) -> list[float]:
    """The classifier's weights from a column `_found` of candidates."""
    each = found.select(F.explode("_found").alias("x")).select("x.kind", "x.votes", "x.features")
    groups = saved(each.groupBy("kind", "votes", "features").count(), "pii-seen")
    counts: dict[str, dict[str, float]] = {}
    for r in groups.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect():  # at most kinds * 3^4 rows
        counts.setdefault(r["kind"], {})[r["votes"]] = float(r["n"])
    soft = {(kind, p): y for kind, own in counts.items() for p, y in _posteriors(own).items()}
    return learn(groups, soft) if soft else [0.0] * FEATURES


def accepted(found: Column, weights: list[float], least: float = 0.5) -> Column:
    """Base spans and the candidates that the classifier takes; of those that fail their own check only such as follow words that name their kind."""
    named = lambda x: ~x["votes"].startswith("-") | (F.substring(x["votes"], 3, 1) == "+")
    return F.filter(found, lambda x: x["base"] | (named(x) & (chance(x["features"], weights) >= least)))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""

    def part(kind: str) -> Column:
        places = F.array_sort(F.transform(of_kind(spans, kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.transform(places, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.array_distinct(F.concat(*map(part, KINDS))), ",")


def annotated(docs: DataFrame) -> DataFrame:
    """doc_id, spans (all, as structs), and the base spans' counts and digest."""
    found = saved(docs.select("doc_id", candidates(docs["text"]).alias("_found")), "pii")
    base = F.filter("_found", lambda x: x["base"])
    counts = [F.size(of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), accepted(F.col("_found"), fit(found)).alias("_spans"))


def _cut(text: Column) -> Callable[[Column, Column], Column]:
    """(from, to) -> that part of a bound array of a text's blocks of CUT characters, in time of the part."""

    def part(lo: Column, hi: Column) -> Column:
        i, j = F.floor(lo / CUT).cast("int"), F.floor(hi / CUT).cast("int")
        block = lambda k: F.coalesce(F.get(text, k), F.lit(""))
        inner = F.array_join(F.slice(text, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substring(block(i), lo - i * CUT + 1, hi - lo)).otherwise(F.concat(F.substring(block(i), lo - i * CUT + 1, F.lit(CUT)), inner, F.substring(block(j), F.lit(1), hi - j * CUT)))

    return part


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans together, by the first one's."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def made(b: Column, s: Column, ends: Column) -> Column:
        part, n = _cut(b), F.size(s)
        each = F.arrays_zip(s.alias("x"), F.slice(ends, 1, n).alias("upto"))
        pieces = F.transform(F.filter(each, lambda e: e["x"]["start"] >= e["upto"]), lambda e: F.concat(part(e["upto"], e["x"]["start"]), F.lit("["), e["x"]["kind"], F.lit("]")))
        last = F.get(ends, n)
        return F.concat(F.array_join(pieces, ""), part(last, F.greatest(last, (F.size(b) - 1) * CUT + F.length(F.get(b, F.size(b) - 1)))))

    with_ends = lambda b, s: bound(scanned(F.transform(s, lambda x: x["end"]), F.greatest), lambda ends: made(b, s, ends))
    return F.when(F.size(spans) > 0, bound(blocks, lambda b: bound(ordered, lambda s: with_ends(b, s)))).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets."""
    rows = docs.select(row_of(docs).alias("row"))
    found = saved(rows.withColumn("_found", candidates(F.col("row.text"))), "pii-documents")
    weights = fit(found)
    text = replaced(F.col("row.text"), accepted(F.col("_found"), weights))
    return found.select(F.col("row").withField("text", F.when(F.size("_found") > 0, text).otherwise(F.col("row.text"))).alias("row")).select("row.*")
