"""Personal data: exact base patterns, and further spans by boosted trees over candidates.

Generators with high recall propose spans that look like numbers of people or like mail addresses, alone or inside longer runs;
they may overlap base spans and each other. Boosted trees score them from their format and their surroundings. A candidate's
label comes from evidence beside the base pattern that a span would be added to: it is positive where a valid base span
covers it, negative where it fails a check that any such item passes, and unknown otherwise. Unknown candidates are left out of
fitting; they are those that may be added. A fixed list of worded examples counts in every part, so that small tables and
formats without base spans have evidence too. Documents are split by their text: one part fits the trees, one calibrates scores
to probabilities (isotonic regression), one sets the probability from which spans are added. All of it is built from SQL functions:
the trees are fitted to counts by feature values, whose number does not depend on the rows, and applied as CASE expressions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import documents, stored

BASE_KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds. Possessive quantifiers and look-behinds change no match; they keep long runs linear.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Fixed patterns of the generators.
_AT, _DOT = r"(?:\x20?(?:\(at\)|\[at\]|@)\x20?|\x20at\x20)", r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)"
GENERATORS = {
    "digits": r"(?<![0-9A-Za-z])[0-9]{7,19}+(?![0-9A-Za-z])",
    "quad": r"(?<![0-9A-Za-z]|[0-9]\.)[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9A-Za-z]|\.[0-9])",
    "grouped": r"(?<![0-9A-Za-z.])(?:\+?[0-9]{1,4}[\x20-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20-])[0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,3}(?![0-9A-Za-z]|[.-][0-9])",
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
}
#: Base kinds that confirm a generator's candidates.
CONFIRM = {"digits": ("card", "phone"), "quad": ("ip",), "grouped": ("card", "phone"), "mail": ("email",)}
TALK = r"(tel|phone|call|fax|mobile|cell|contact|dial)[^a-z]*$"
MONEY = r"(card|visa|credit|debit|account|iban|bank)[^a-z]*$"
MAIL = r"(mail|contact|write|reach)[^a-z]*$"
CODE = r"(id|no|nr|order|item|part|version|build|v|ref|isbn)[^a-z0-9]{0,2}$"
FEATURES = ("family", "digits", "groups", "last", "first", "paren", "dash", "space", "luhn", "talk", "money", "write", "code", "sign", "ending", "worded", "dotted")
#: Fixed examples with what they should be, each counted as so many candidates.
EXAMPLES = [
    ("call 743-555-3824 now", True), ("tel (743) 555-3824 or", True), ("phone: 0743 555 3824 and", True), ("fax 49 30 1234 5678", True), ("contact 212-555-0187", True),
    ("me at (212) 555-0187 today", True), ("+1 (212) 555-0187 10.20.30.40", True), ("card 4111 1111 1111 1111", True), ("visa 5500000000000004 4111111111111111", True),
    ("number 4012888888881881 4111111111111111", True), ("mobile 07435553824", True), ("10.20.30.40.", True), ("from 192.168.10.20 port", True), ("+1 (212) 555-0187 172.16.4.9 x", True),
    ("mail joe(at)example(dot)com", True), ("joe.doe [at] example [dot] org", True), ("write to jane at example dot com", True), ("reach ann_b @ mail.example.net", True), ("amy(at)mail.example.com", True),
    ("on 2024-05-06 12-30-15", False), ("years 1990-1995 1996-1999", False), ("order no 743555382", False), ("id=7435553824", False), ("id 20240506123015", False), ("part 12-34-5678-90", False),
    ("isbn 978-3-16-148410-0", False), ("item #99887766", False), ("version 1.22.333.4", False), ("build 4.3.2.1", False), ("300.1.2.3 points", False), ("9.8.7.1 section", False),
    ("total 1234567890123456", False), ("pages 100 200 300 400", False), ("look at home.then", False), ("was at once.and", False), ("stay at 10.30", False), ("arrive at noon.We", False), ("a@b.1x", False),
    ("val=7435553824", False), ("x/7435553824/y", False), ("total 7435553824 units", False), ("sum 743555382 and", False),
]
EXAMPLE_WEIGHT = 10.0
TREES, RATE, DEPTH, PRECISION, LEAST_LEAF = 40, 0.3, 3, 0.95, 5.0
#: Of ten parts by a hash of the text, those that fit the trees and those that calibrate; the rest sets the threshold.
FIT, CALIBRATE = 6, 8


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _found(text: Column, pattern: str) -> Column:
    """Matches as structs: text, length of the piece before it, that piece's last characters in lower case, the character after."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # Cut up once, outside of the function that looks at each match; the piece behind the last match has none.
    zipped = F.filter(F.arrays_zip(found, pieces, F.slice(pieces, 2, 1 << 30)), lambda x: x["0"].isNotNull())

    def one(x: Column) -> Column:
        return F.struct(x["0"].alias("text"), F.length(x["1"]).alias("gap"), F.lower(F.substring(x["1"], -16, 16)).alias("before"), F.substring(x["2"], 1, 1).alias("after"))

    return F.when(F.size(found) > 0, F.transform(zipped, one)).otherwise(F.array().cast("array<struct<text:string,gap:int,before:string,after:string>>"))


def valid(kind: str, text: Column) -> Column:
    digits = F.length(digits_of(text))
    if kind == "ip":
        # A part's value is at most 255 whatever its leading zeros.
        return ~text.rlike(r"(^|\.)0*+([3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})(\.|$)")
    if kind == "card":
        return digits.between(14, 19) & luhn(digits_of(text))
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _fails(c: Column, family: Column) -> Column:
    """Whether a candidate fails a check that every item of its family passes."""
    text, digits = c, digits_of(c)
    n = F.length(digits)
    number = ((n >= 14) & ~luhn(digits)) | text.rlike(r"^(19|20)[0-9]{2}[\x20-]([01][0-9]|(19|20)[0-9]{2})[\x20-]") | digits.rlike(r"^([0-9])\1*$")
    mail = ~text.rlike(r"(\.|dot\x20|[)\]]\x20?)[a-z]{2,10}$") | text.rlike(r"^[._%+-]|\.[.-]|-\.")
    return F.when(family == "mail", mail).when(family == "quad", ~valid("ip", text)).otherwise(number)


def _features(family: Column) -> Column:
    text, before, after = F.col("text"), F.col("before"), F.col("after")
    digits = F.length(digits_of(text))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    runs = F.split(F.regexp_replace(text, "[^0-9]+$|^[^0-9]+", ""), "[^0-9]+")
    mail = family == "mail"
    zero = lambda x: F.when(mail, 0).otherwise(x)
    values = {
        "family": F.array_position(F.array(*map(F.lit, GENERATORS)), family),
        "digits": zero(F.least(digits, F.lit(20))),
        "groups": zero(F.least(F.size(runs), F.lit(6))),
        "last": zero(F.least(F.length(F.element_at(runs, -1)), F.lit(5))),
        "first": zero(F.least(F.length(F.element_at(runs, 1)), F.lit(5))),
        "paren": zero(flag(text.contains("("))),
        "dash": zero(flag(text.contains("-"))),
        "space": zero(flag(text.contains(" "))),
        "luhn": zero(flag(digits.between(14, 19) & luhn(digits_of(text)))),
        "talk": flag(before.rlike(TALK)),
        "money": flag(before.rlike(MONEY)),
        "write": flag(before.rlike(MAIL)),
        "code": flag(before.rlike(CODE)),
        "sign": flag(before.rlike(r"[=_/\"'#.-]$") | after.rlike(r"[=_/\"']")),
        "ending": F.when(mail, F.least(F.length(F.regexp_extract(text, "[A-Za-z0-9]+$", 0)), F.lit(8))).otherwise(0),
        "worded": flag(mail & text.rlike(r"\x20at\x20")),
        "dotted": F.when(mail & text.rlike(r"dot[)\]\x20]"), 2).when(mail & text.rlike(r"at[)\]]|@"), 1).otherwise(0),
    }
    return F.struct(*(values[f].cast("int").alias(f) for f in FEATURES))


Counted = list[tuple[tuple[int, ...], float, float]]


def fit_trees(rows: Counted, trees: int = TREES, rate: float = RATE) -> list[tuple]:
    """Boosted trees on (feature values, positives, negatives), by Newton steps on the logistic loss.

    A tree is (feature, cut, left, right), where left and right are the same with numbers as leaves; rows with a value of at most
    cut go left.
    """
    scores = [0.0] * len(rows)
    out = []
    for _ in range(trees):
        grad, hess = [], []
        for (_, pos, neg), s in zip(rows, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            grad.append(pos * (1 - p) - neg * p)
            hess.append((pos + neg) * p * (1 - p))
        tree = _grow(rows, list(range(len(rows))), grad, hess, DEPTH, rate)
        out.append(tree)
        scores = [s + score(tree, x) for (x, _, _), s in zip(rows, scores, strict=True)]
    return out


def _grow(rows, at, grad, hess, depth, rate):
    g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
    leaf = rate * g / (h + 1.0)
    if not depth:
        return leaf
    best = (1e-9, None)
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for i in at:
            s = sums[rows[i][0][f]]
            s[0] += grad[i]
            s[1] += hess[i]
            s[2] += rows[i][1] + rows[i][2]
        n, gl, hl, nl = sum(s[2] for s in sums.values()), 0.0, 0.0, 0.0
        for cut in sorted(sums)[:-1]:
            gl, hl, nl = gl + sums[cut][0], hl + sums[cut][1], nl + sums[cut][2]
            if min(nl, n - nl) < LEAST_LEAF:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    sides = [i for i in at if rows[i][0][f] <= cut], [i for i in at if rows[i][0][f] > cut]
    return (f, cut, *(_grow(rows, s, grad, hess, depth - 1, rate) for s in sides))


def score(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree, features: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(features[FEATURES[tree[0]]] <= tree[1], tree_column(tree[2], features)).otherwise(tree_column(tree[3], features))


def total(trees: list[tuple], x: tuple[int, ...]) -> float:
    return sum(score(t, x) for t in trees)


def calibrated(rows: Counted, trees: list[tuple]) -> list[tuple[float, float]]:
    """Isotonic regression of the share of positives on the score: (lowest score of a step, probability), rising."""
    sums: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, pos, neg in rows:
        s = sums[round(total(trees, x), 9)]
        s[0] += pos
        s[1] += pos + neg
    steps: list[list[float]] = []
    for s in sorted(sums):
        steps.append([s, *sums[s]])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, pos, n = steps.pop()
            steps[-1][1] += pos
            steps[-1][2] += n
    return [(s, pos / n) for s, pos, n in steps]


def probability(steps: list[tuple[float, float]], value: float) -> float:
    return max((p for s, p in steps if s <= value + 1e-6), default=0.0)


def cut_off(rows: Counted, trees: list[tuple], steps: list[tuple[float, float]]) -> float | None:
    """The lowest score whose step and all higher ones have the wanted share of positives, by calibration and on left-out documents."""
    scored = sorted(((round(total(trees, x), 9), pos, neg) for x, pos, neg in rows), reverse=True)
    best = None
    for least, p in sorted(steps, reverse=True):
        pos, n = (sum(v) for v in zip((0.0, 0.0), *((a, a + b) for s, a, b in scored if s >= least), strict=True))
        if p < PRECISION or pos < PRECISION * n:
            break
        best = least
    return best


def _scanned(rows: DataFrame, *carry: str) -> DataFrame:
    """Each row of ``(row, text)`` with ``part`` and the matches of all patterns that have any; the text is left out."""
    every = [F.struct(F.lit(k).alias("kind"), _found(F.col("text"), p).alias("found")) for k, p in (PATTERNS | GENERATORS).items()]
    part = F.pmod(F.xxhash64("text"), F.lit(10)).alias("part")
    return rows.select("row", *carry, part, F.filter(F.array(*every), lambda x: F.size(x["found"]) > 0).alias("matches"))


def _matched(scanned: DataFrame) -> DataFrame:
    """One row a match that holds: row, part, kind, begin, end, text, before, after.

    A match's place is a running sum over the lengths before it, in a window of its document and kind.
    """
    kinds = scanned.select("row", "part", F.explode("matches").alias("m"))
    kinds = kinds.select("row", "part", "m.kind", F.posexplode("m.found").alias("at", "m"))
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.text")).over(order).cast("int")
    placed = kinds.select("row", "part", "kind", (end - F.length("m.text")).alias("begin"), end.alias("end"), "m.text", "m.before", "m.after")
    checks = [(F.col("kind") == k) & valid(k, F.col("text")) for k in PATTERNS]
    return placed.where(reduce(Column.__or__, checks) | F.col("kind").isin(*GENERATORS))


def _labelled(spans: DataFrame) -> DataFrame:
    """Candidates with ``features``, ``free`` (no base span overlaps) and ``label`` (null: unknown), by two running windows."""
    base = F.col("kind").isin(*BASE_KINDS)
    down = Window.partitionBy("row").orderBy("begin", (~base).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("row").orderBy(F.col("begin").desc(), "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    over = spans
    for k in BASE_KINDS:
        own = F.col("kind") == k
        left, right = F.max(F.when(own, F.col("end"))).over(down), F.min(F.when(own, F.col("begin"))).over(up)
        over = over.withColumn(f"on_{k}", F.coalesce(left > F.col("begin"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False)))
    confirmed = [(F.col("kind") == f) & reduce(Column.__or__, [F.col(f"on_{k}") for k in kinds]) for f, kinds in CONFIRM.items()]
    label = F.when(reduce(Column.__or__, confirmed), 1).when(_fails(F.col("text"), F.col("kind")), 0)
    free = ~reduce(Column.__or__, [F.col(f"on_{k}") for k in BASE_KINDS])
    over = over.where(~base)
    return over.select("row", "part", "kind", "begin", "end", _features(F.col("kind")).alias("features"), free.alias("free"), label.alias("label"))


def _counted(rows) -> Counted:
    sums: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for features, pos, neg in rows:
        sums[tuple(features)][0] += pos
        sums[tuple(features)][1] += neg
    return sorted((x, p, n) for x, (p, n) in sums.items())


def learned(candidates: DataFrame) -> tuple[list[tuple], list[tuple[float, float]], float | None]:
    """Trees, calibration and the score from which candidates are added, from counts by feature values."""
    spark = candidates.sparkSession
    texts = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(int(y)).alias("wanted")) for t, y in EXAMPLES))
    rows = spark.range(1).select(F.posexplode(texts).alias("row", "x")).select("row", "x.text", "x.wanted")
    taught = _labelled(_matched(_scanned(rows))).join(rows.select("row", "wanted"), "row").groupBy("features", "wanted").count().collect()
    examples = [(r.features, EXAMPLE_WEIGHT * r["count"] * r.wanted, EXAMPLE_WEIGHT * r["count"] * (1 - r.wanted)) for r in taught]
    parts = F.when(F.col("part") < FIT, 0).when(F.col("part") < CALIBRATE, 1).otherwise(2)
    known = candidates.where("label is not null").groupBy("features", parts.alias("use")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    known = known.collect()
    use = [_counted([*examples, *((r.features, float(r.pos), float(r.neg)) for r in known if r.use == k)]) for k in range(3)]
    trees = fit_trees(use[0])
    steps = calibrated(use[1], trees)
    return trees, steps, cut_off(use[2], trees, steps)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (begin, order, end, kind) sorted by begin and then kind.

    Positions are code points, ends exclusive. Base kinds are email, ip, card and phone; digits, quad, grouped and mail are
    spans that the trees add where no base span overlaps. Null and empty texts have no spans. Null ids and repeated rows
    are rows like any other; further columns are left out. Texts are read once and not shuffled; only matches are, by
    document, so a document's cost grows with its length and not with the square of its spans.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Written once: the numbers given to the rows are fixed from here on.
    scanned = stored(_scanned(rows, "id"), "scanned")
    spans = stored(_matched(scanned), "spans")
    candidates = stored(_labelled(spans), "candidates")
    trees, _, least = learned(candidates)
    kinds = [*PATTERNS, *GENERATORS]
    span = F.struct("begin", (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).cast("int").alias("order"), "end", "kind").alias("span")
    chosen = spans.where(F.col("kind").isin(*BASE_KINDS)).select("row", span)
    if least is not None:
        added = candidates.where("free").withColumn("score", reduce(Column.__add__, [tree_column(t, F.col("features")) for t in trees]))
        added = added.where(F.col("score") >= F.lit(least - 1e-6))
        # Of spans that overlap, the one that begins first stays.
        before = Window.partitionBy("row").orderBy("begin", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
        added = added.withColumn("taken", F.coalesce(F.max("end").over(before), F.lit(0))).where("begin >= taken")
        chosen = chosen.unionByName(added.select("row", span))
    per_row = chosen.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return scanned.select("row", "id").join(per_row, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    line = lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS)), line), ",")
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(documents(spark, sf_dir)))
