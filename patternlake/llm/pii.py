"""Personal data: base rules, and proposals of generous generators that boosted trees select. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.llm.common import shared_dir, stash

KINDS = ["email", "ip", "card", "phone"]

#: The base rules. Runs are possessive and begin where they have to (or where the match before ended), so that a long run is read once and without recursion; what they match is the
#: leftmost longest match of the plain pattern. Card and phone take the number of digits into the pattern, since a run of digits can only match whole.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9]|[0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])",
}
#: Proposals: what might be one of the kind, written in any common way. They overlap each other and the base spans.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?(?:\.|\(\.\)|\[\.\]|\(dot\)|\[dot\]) ?[0-9]{1,3}+){3}+(?![0-9A-Za-z])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{2,6}){2,5}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
CUES = {"email": "mail|contact|write to", "ip": "ip|host|server|addr", "card": "card|visa|master|credit|pay", "phone": "phone|tel|call|fax|mobile"}
_AT, _DOT, _NO_DIGITS = ("@", " (at) "), (r"\.(?=[A-Za-z0-9-]+$)", " dot "), (r"\.?[0-9]+", "")
#: How a span of a base rule is also written: (kind, (pattern, replacement) ...), one after the other.
REWRITES = [
    ("email", _AT),
    ("email", _DOT),
    ("email", _AT, _DOT),
    ("email", _NO_DIGITS),
    ("email", _NO_DIGITS, _AT, _DOT),
    ("ip", (r"\.", "[.]")),
    ("card", (r"^([0-9]{4})([0-9]{4})([0-9]{4})", "$1.$2.$3.")),
    ("phone", (r"^\+[0-9]{1,2}[ .-]?(?=\(?[0-9]{2,4})", "")),
]
#: And how it is spoiled: a number that is no octet, too few parts. A card's last digit is replaced by the next besides, so that it fails the check.
SPOILS = [("ip", (r"^[0-9]+", "913")), ("phone", (r"[0-9]{4}$", "")), ("email", (r"\.[A-Za-z0-9-]+$", "")), ("email", (r"\.[A-Za-z0-9-]+$", ""), _NO_DIGITS)]
#: Characters of context on each side.
AROUND = 24
#: Prefix sums go over blocks of this many matches.
BLOCK = 256
#: A task of the training has about this many rows, each a set of equal features.
TASK_ROWS = 200_000


def _empty() -> Column:
    return F.array().cast("array<string>")


def _located(text: Column, pattern: str, gate: Column) -> tuple[Column, Column]:
    """(matches, what stands before, between and behind them) of a pattern in a text."""
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_empty())
    return found, F.when(gate, F.split(text, pattern, -1)).otherwise(_empty())


def _placed(found: Column, gaps: Column) -> Column:
    """Array of (start, end, body, left, right): code points, end exclusive. Lengths are added up within blocks, then over blocks, so that a text may have very many matches."""
    each = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("body"), F.substring(g, -AROUND, AROUND).alias("left"))),
        F.slice(gaps, F.lit(2), F.size(found)),
        lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), x["body"].alias("body"), x["left"].alias("left"), F.substring(g, 1, AROUND).alias("right")),
    )
    shape = "array<struct<start:int,end:int,body:string,left:string,right:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["body"].alias("body"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def moved(acc, b):
        out = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["body"].alias("body"), x["left"].alias("left"), x["right"].alias("right")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], out).alias("out"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(each, b * BLOCK + 1, F.lit(BLOCK)), zero, step))
    return F.when(F.size(found) > 0, F.aggregate(parts, zero, moved)["out"]).otherwise(F.array().cast(shape))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.coalesce(F.when(i % 2 == 1, F.substring(back, i, F.lit(1))).otherwise(F.substring(twice, i, F.lit(1))).cast("int"), F.lit(0)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _octets(body: Column, by: str = r"\.") -> Column:
    return F.forall(F.split(body, by, -1), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _kinds(docs: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """``docs`` with an array of placed matches for each kind."""
    text, gates = F.col("text"), {"email": F.lit(True) if prefix == "p" else F.contains("text", F.lit("@")), "phone": F.lit(True) if prefix == "p" else F.contains("text", F.lit("+"))}
    digits = F.col("text").rlike("[0-9]")
    for kind, pattern in patterns.items():
        found, gaps = _located(text, pattern, gates.get(kind, digits))
        docs = docs.withColumn(f"__{prefix}m_{kind}", found).withColumn(f"__{prefix}g_{kind}", F.when(F.size(f"__{prefix}m_{kind}") > 0, gaps).otherwise(_empty()))
    return docs.select("*", *[_placed(F.col(f"__{prefix}m_{k}"), F.col(f"__{prefix}g_{k}")).alias(f"__{prefix}_{k}") for k in patterns]).drop(*[f"__{prefix}{x}_{k}" for k in patterns for x in "mg"])


def _checked(kind: str, spans: Column) -> Column:
    """Spans that pass the check of their kind; what fails is dropped, nothing else is tried in its place."""
    test = {"ip": lambda x: _octets(x["body"]), "card": lambda x: luhn(_digits(x["body"]))}.get(kind)
    return F.filter(spans, test) if test else spans


def _count(body: Column, what: str) -> Column:
    return F.length(F.regexp_replace(body, f"[^{what}]", "")).cast("double")


def features(kind: Column, x: Column) -> Column:
    """Format and context of a proposal as an array of doubles: see FEATURES."""
    body, left, right = x["body"], x["left"], x["right"]
    digits = _digits(body)
    groups = F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out = [flag(kind == k) for k in KINDS]
    out += [F.length(digits).cast("double"), _count(body, "A-Za-z"), _count(body, " "), _count(body, "."), _count(body, "-"), _count(body, "@"), _count(body, ":"), F.size(groups).cast("double")]
    out += [F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"), F.coalesce(F.array_min(F.transform(groups, F.length)), F.lit(0)).cast("double")]
    out += [flag(luhn(digits)), flag(F.forall(groups, lambda g: g.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))), flag(body.rlike(r"^\+")), flag(body.rlike(r"\([0-9]+\)"))]
    out += [flag(body.rlike(r"(?i)(?:@|[(\[{]at[)\]}])")), flag(body.rlike(r"(?i)(?:\.|[(\[{ ]dot[)\]} ]) ?[a-z]{2,6}$"))]
    out += [flag(left.rlike("[A-Za-z0-9]$")), flag(right.rlike("^[A-Za-z0-9]")), flag(left.rlike("[=\"'/#:]\\s?$")), flag(right.rlike("^[\"'/%]"))]
    out += [flag(F.lower(left).rlike(f"\\b(?:{CUES[k]})")) for k in KINDS]
    return F.array(*out)


FEATURES = [*KINDS, "digits", "letters", "spaces", "dots", "hyphens", "ats", "colons", "groups", "longest group", "shortest group", "luhn", "octets", "plus", "parentheses", "at", "domain", "glued left", "glued right", "assigned", "quoted", *[f"cue {k}" for k in KINDS]]


@dataclass(frozen=True)
class Model:
    """Boosted trees, each as nested (feature, threshold, left, right) or a number; the line that calibrates their sum; a threshold for each kind, absent where none is good enough."""

    trees: list
    weights: list[float]
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, f: Column) -> Column:
        """Calibrated probability of a proposal with features ``f``, as an expression."""

        def walk(t):
            return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        margin = sum((w * walk(t) for w, t in zip(self.weights, self.trees)), F.lit(0.0))
        return 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.offset))))


def _nested(node) -> float | tuple:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild()))


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def _edited(edits: list[tuple[str, str]], body: Column) -> Column:
    for pattern, replacement in edits:
        body = F.regexp_replace(body, pattern, replacement)
    return body


def _broken(body: Column) -> Column:
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.translate(F.substring(body, -1, 1), "0123456789", "1234567890"))


def _examples(kind: str, y: int, spans: Column, change=lambda body: body) -> Column:
    """Spans as labelled rows, rewritten by ``change``."""

    def row(x):
        body = change(x["body"])
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"), x["left"].alias("left"), x["right"].alias("right"), F.lit(y).alias("y"))

    return F.transform(spans, row)


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, f, y, fold, n): every labelled proposal of ``docs``, counted by what the trees see of it.

    Spans of the base rules count as personal data, as found, as their rewritings and with their own context; spoiled, and proposals that touch no base span, they count as none.
    Equal proposals in equal context share a fold.
    """
    rows = _kinds(_kinds(docs.select(F.coalesce("text", F.lit("")).alias("text")), BASE, "b"), GENERATORS, "p")
    every = F.concat(*[F.transform(_checked(k, F.col(f"__b_{k}")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    made = []
    for kind in KINDS:
        base = _checked(kind, F.col(f"__b_{kind}"))
        made.append(_examples(kind, 1, base))
        written = [partial(_edited, edits) for k, *edits in REWRITES if k == kind]
        spoiled = [partial(_edited, edits) for k, *edits in SPOILS if k == kind] + ([_broken, *[lambda body, w=w: _broken(w(body)) for w in written]] if kind == "card" else [])
        made += [_examples(kind, y, base, change) for y, changes in ((1, written), (0, spoiled)) for change in changes]
        made.append(_examples(kind, 0, F.filter(F.col(f"__p_{kind}"), lambda x: ~_overlaps(F.col("__every"), x))))
    rows = rows.withColumn("__every", every)
    each = rows.select(F.explode(F.flatten(F.array(*made))).alias("x")).select("x.*").withColumn("fold", F.pmod(F.xxhash64("kind", "body", "left", "right", "y"), F.lit(3)))
    seen = each.select("kind", features(F.col("kind"), F.struct("body", "left", "right")).alias("f"), F.col("y").cast("double").alias("y"), "fold")
    return seen.groupBy("kind", "f", "y", "fold").agg(F.count("*").cast("double").alias("n"))


def train(docs: DataFrame, trees: int = 12, depth: int = 4, precision: float = 0.98) -> Model | None:
    """Boosted trees from all labelled proposals of ``docs`` (text), two thirds for the trees and one to calibrate them.

    The sum of the trees is calibrated by logistic regression. A kind's threshold is the lowest probability from which on ``precision`` of the held-out proposals are personal data;
    a kind without one adds nothing. None if the proposals are too few to have both sorts on both sides.

    Proposals with equal features are one row, weighted by their number. Bins are so many that Spark, which looks for splits in a sample of ``maxBins`` squared rows, takes all.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    rows = stash(labelled(docs), f"{shared_dir(spark)}/labelled")
    sides = {(r["held"], r["y"]): r["count"] for r in rows.groupBy((F.col("fold") == 0).alias("held"), "y").count().collect()}
    if len(sides) < 4:
        return None
    size = sum(sides.values())
    # in a fixed order, since sums of doubles depend on it
    rows = rows.repartition(1 + size // TASK_ROWS, "kind", "f").sortWithinPartitions("kind", "f", "y", "fold")
    table = rows.where("fold <> 0").select("n", F.col("y").alias("label"), array_to_vector("f").alias("features"))
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11, minInstancesPerNode=5, maxBins=max(32, isqrt(size) + 1), weightCol="n").fit(table)
    raw = Model([_nested(t._java_obj.rootNode()) for t in fitted.trees], [float(w) for w in fitted.treeWeights], 1.0, 0.0, {})
    held = rows.where("fold = 0").select("kind", "n", F.col("y").alias("label"), raw.probability(F.col("f")).alias("p"))
    held = held.withColumn("margin", F.log(F.col("p") / (1 - F.col("p"))))
    line = LogisticRegression(regParam=1e-4, weightCol="n").fit(held.select("n", "label", array_to_vector(F.array("margin")).alias("features")))
    slope, offset = float(line.coefficients[0]), float(line.intercept)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("margin") + F.lit(offset))))
    counts = held.select("kind", F.round(p, 6).alias("p"), "n", "label").where("p >= 0.5").groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))  # at most 500,001 rows a kind, by the rounding
    sums = counts.select("kind", "p", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits"))
    good = {r["kind"]: r["least"] - 1e-6 for r in sums.where(F.col("hits") >= precision * F.col("n")).groupBy("kind").agg(F.min("p").alias("least")).collect()}
    return Model(raw.trees, raw.weights, slope, offset, good)


def _resolve(spans: Column) -> Column:
    """Of spans in the order of their start: all base spans; of proposals those that overlap nothing kept before them, or only a proposal with a smaller probability, whose place they take."""
    zero = F.struct(F.array().cast("array<struct<start:int,order:int,end:int,p:double>>").alias("out"), F.lit(None).cast("struct<start:int,order:int,end:int,p:double>").alias("last"), F.lit(0).alias("before"), F.lit(0).alias("reach"))

    def state(out, last, before, reach):
        return F.struct(out.alias("out"), last.alias("last"), before.alias("before"), reach.alias("reach"))

    def step(acc, x):
        base = x["p"] > 1
        clear = x["start"] >= acc["reach"]
        weak = acc["last"].isNotNull() & (acc["last"]["p"] <= 1) & (acc["last"]["p"] < x["p"]) & (x["start"] >= acc["before"])  # the only one in the way, and weaker
        done = F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))
        replaced = state(acc["out"], x, acc["before"], F.greatest(acc["before"], x["end"]))
        added = state(done, x, acc["reach"], F.greatest(acc["reach"], x["end"]))
        return F.when(~clear & weak, replaced).when(clear | base, added).otherwise(acc)

    return F.aggregate(spans, zero, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text); null counts as empty.

    Returns doc_id, n_email, n_ip, n_card, n_phone (spans of the base rules, leftmost and non-overlapping per kind), base_sha256 (of ``kind:start:end``, by start, then kind as listed,
    comma-joined; code points, end exclusive), spans (the base spans and those selected, joined likewise) and n_added. A selected proposal reaches its kind's threshold and overlaps no base span; of
    proposals that overlap, the more probable stays. Repeated rows each return; other columns are ignored. Without a model there are base spans only.

    One pass, without shuffle: trees are expressions over the proposals of a row.
    """
    rows = _kinds(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), BASE, "b")
    rows = rows.select("doc_id", "text", *[_checked(k, F.col(f"__b_{k}")).alias(f"__b_{k}") for k in KINDS])

    def listed(order, kind):
        return F.transform(F.col(f"__b_{kind}"), lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(2.0).alias("p")))

    def proposed(kind):
        return F.transform(F.col(f"__p_{kind}"), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end"), features(F.lit(kind), x).alias("f"), F.lit(model.thresholds[kind]).alias("least")))

    base = F.array_sort(F.concat(*[listed(n, k) for n, k in enumerate(KINDS)]))
    rows = rows.select("doc_id", "text", base.alias("base"), *[F.size(f"__b_{k}").cast("long").alias(f"n_{k}") for k in KINDS])
    used = {k: GENERATORS[k] for k in KINDS if model and k in model.thresholds}
    more = _kinds(rows, used, "p") if used else rows
    shaped = [proposed(k) for k in used]
    more = more.withColumn("more", F.concat(*shaped)) if shaped else more
    if shaped:
        scored = F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), model.probability(x["f"]).alias("p"), x["least"].alias("least")))
        more = more.withColumn("more", F.filter(scored, lambda x: x["p"] >= x["least"]))
        chosen = F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), F.least(x["p"], F.lit(1.0)).alias("p")))
        every = F.when(F.size("more") > 0, F.array_sort(_resolve(F.array_sort(F.concat("base", chosen))))).otherwise(F.col("base"))
    else:
        every = F.col("base")
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["order"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = more.select("doc_id", *[f"n_{k}" for k in KINDS], "base", every.alias("every"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; spans that overlap are replaced as one, by the kind of the first."""
    found = find(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"), model).select("doc_id.doc_id", "doc_id.text", "spans")
    spans = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.get(F.split(s, ":"), F.lit(1)).cast("int").alias("start"), F.get(F.split(s, ":"), F.lit(2)).cast("int").alias("end"), F.get(F.split(s, ":"), F.lit(0)).alias("kind")))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), s["kind"], F.lit("]")))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select("doc_id", F.when(text.isNotNull(), done).alias("text"))
