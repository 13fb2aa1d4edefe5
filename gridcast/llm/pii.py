"""Personal data: checked patterns, and candidates judged by boosted trees. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import hash60
from gridcast.session import stage

KINDS = ("email", "ip", "card", "phone")

# Each pattern finds what the plain one in its comment finds, leftmost first. Possessive repeats and the look at what stands
# before a match only keep long runs of letters or digits from being tried again from every position.
_FRESH = r"(?:(?<![{0}])|\G)"
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": _FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: wide patterns that take in disguised and badly delimited forms, and the kinds they may be.
GENERATORS = {
    "mail": (_FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.(?!\x20[A-Z])|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++", ("email",)),
    "dots": (_FRESH.format("0-9") + r"[0-9]++(?:(?:\.|\[\.\]|\(\.\))[0-9]++){3}+", ("ip",)),
    "number": (r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++", ("card", "phone")),
}
#: Telephone numbers written without + and country: an area in brackets, or three, three and four digits. Groups are bounded, as
#: an open repeat is matched by recursion; seven groups of two digits are more than the 15 digits of the longest number.
LOCAL = r"^(?:1[\x20.-]?)?\((?:[0-9]{3}|0[0-9]{1,4})\)[\x20.-]{0,2}[0-9]{3,4}(?:[\x20.-]?[0-9]{2,4}){1,7}$|^(?:1[\x20.-])?[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"
#: Cards whose groups of four are parted by more or other characters than the base takes.
GROUPED = r"^\(?[0-9]{4}(?:[\x20().-]{1,2}[0-9]{4}){3}(?:[\x20().-]{1,2}[0-9]{1,3})?$"
#: Words before a span that hint at its kind.
HINTS = r"(?i)(?:mail|contact|card|visa|call|phone|tel|mobile|fax|host|server|ip|addr)[a-z]*\W{0,3}$"
#: Characters around a span that are looked at.
CONTEXT = 16

#: Different candidates, each with its number, that one task of the fit holds.
FIT_ROWS = 50_000
TREES, DEPTH = 20, 3
#: A leaf stands for so many candidates at least, and a feature is cut at all places between its values up to so many different candidates.
LEAF, BINS = 5, (32, 4096)
#: A threshold is the least score from which at least this share of held-out candidates are confirmed.
PRECISION = 0.95
#: The share of a kind counts so many candidates of the mean of all kinds above the same score beside its own, so a kind with few held-out candidates has a threshold too.
PRIOR = 5
FEATURES = "kind check chars digits letters dots hyphens spaces parts small_parts checksum before_space after_space after_letter hint".split()
SPAN = "struct<kind:int,start:int,stop:int>"


# --- places of matches --------------------------------------------------------------


def pieces(text: Column, pattern: str) -> Column:
    """struct(gaps, found): the text between the matches (length and what touches them), and the matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.char_length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(1)).alias("after")))
    return F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


_BLOCK = 64


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def steps(name: str) -> Column:
    """How far each match starts behind the start of the one before it."""
    gaps, found = F.col(f"{name}.gaps"), F.col(f"{name}.found")
    earlier = lambda i: F.char_length(F.element_at(found, F.greatest(i, F.lit(1))))
    return F.transform(found, lambda m, i: F.element_at(gaps, i + 1)["n"] + F.when(i == 0, 0).otherwise(earlier(i)))


def with_starts(stored: DataFrame, names: list[str]) -> DataFrame:
    """``stored`` with ``{name}_starts`` for each pieces column: where its matches start, in code points.

    Sums over blocks of 64 steps are made first, so a text with k matches takes about 64 k + (k / 64)^2 additions.
    """
    stored = stored.withColumns({f"{n}_steps": steps(n) for n in names})

    def blocks(name: str) -> Column:
        steps = F.col(f"{name}_steps")
        count = F.ceil(F.size(steps) / _BLOCK).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))).otherwise(F.array().cast("array<int>"))

    def starts(name: str) -> Column:
        steps, sums = F.col(f"{name}_steps"), F.col(f"{name}_blocks")
        offsets = F.transform(sums, lambda s, b: _sum(F.slice(sums, F.lit(1), b)))
        return F.flatten(F.transform(offsets, lambda o, b: F.transform(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)), lambda x, i: o + _sum(F.slice(steps, b * _BLOCK + 1, i + 1)))))

    return stored.withColumns({f"{n}_blocks": blocks(n) for n in names}).withColumns({f"{n}_starts": starts(n) for n in names})


def spans_of(name: str) -> Column:
    """array<struct(text, start, stop, before, after)> from the stored pieces and their starts."""
    found, gaps, starts = F.col(f"{name}.found"), F.col(f"{name}.gaps"), F.col(f"{name}_starts")
    return F.transform(found, lambda m, i: F.struct(
        m.alias("text"), F.element_at(starts, i + 1).alias("start"), (F.element_at(starts, i + 1) + F.char_length(m)).alias("stop"),
        F.element_at(gaps, i + 1)["before"].alias("before"), F.element_at(gaps, i + 2)["after"].alias("after"),
    ))


# --- checks of the base ----------------------------------------------------------------


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def small_number(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.char_length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


def luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits have a right check digit."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    right = F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(F.char_length(digits).between(16, 19), right).otherwise(False)


def confirmed(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(text, r"\.", -1), small_number)
    if kind == "card":
        return luhn(digits_of(text))
    return F.char_length(digits_of(text)).between(8, 15)


def base_spans(kind: str) -> Column:
    kept = F.filter(spans_of(kind), lambda s: confirmed(kind, s["text"]))
    return F.transform(kept, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop")))


# --- candidates --------------------------------------------------------------------------


def undone(kind: str, text: Column) -> Column:
    """The candidate in the form that the base would take, as far as its features see it.

    Brackets, spaces around marks, [at] and [dot], the separators of a card, and the + and country of a telephone number
    leave no trace, so a disguised form has the features of the plain one.
    """
    if kind == "email":
        bare = F.regexp_replace(F.regexp_replace(text, r"\[at\]|\(at\)", "@"), r"\[dot\]|\(dot\)", ".")
        return F.replace(bare, F.lit(" "), F.lit(""))
    if kind == "ip":
        return F.regexp_replace(text, r"[\[\]()]", "")
    if kind == "card":
        return F.regexp_replace(F.regexp_replace(text, r"^[+(]", ""), r"[\x20().-]+", "-")
    bare = F.regexp_replace(text, r"[+()]", "")
    return F.when(text.rlike(LOCAL) & ~text.startswith("1"), F.concat(F.lit("1 "), bare)).otherwise(bare)


def disguised(kind: str, text: Column, plain: Column) -> Column:
    """Whether a candidate that the base does not find is one of its kind once its disguise is ``undone``.

    Words or numbers may stand around a spaced @ too (``10 @ 3.20``): there, a name must end as names of hosts do.
    """
    if kind == "email":
        return text.rlike(r"\[at\]|\(at\)|\[dot\]|\(dot\)") | plain.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "ip":
        return confirmed(kind, plain)
    if kind == "card":
        return text.rlike(GROUPED) & luhn(digits_of(text))
    return text.rlike(LOCAL) & F.char_length(digits_of(plain)).between(8, 15)


def candidate_features(kind: str, s: Column) -> Column:
    """struct(start, stop, disguised, and FEATURES as ints): the form of the span, its disguise undone, and what stands around it."""
    text, digits = undone(kind, s["text"]), digits_of(s["text"])

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    parts = F.split(text, r"\.", -1)
    values = {
        "kind": F.lit(KINDS.index(kind)), "check": confirmed(kind, text).cast("int"), "chars": F.char_length(text), "digits": count("[0-9]"), "letters": count("[A-Za-z]"),
        "dots": count(r"\."), "hyphens": count("-"), "spaces": count(" "),
        "parts": F.size(parts), "small_parts": F.size(F.filter(F.slice(parts, 1, 9), lambda p: p.rlike("^[0-9]+$") & small_number(p))),
        "checksum": luhn(digits).cast("int"), "before_space": s["before"].rlike(r"(^|\s)$").cast("int"), "after_space": s["after"].rlike(r"^(\s|$)").cast("int"),
        "after_letter": s["after"].rlike(r"^\p{L}").cast("int"), "hint": s["before"].rlike(HINTS).cast("int"),
    }
    return F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"), disguised(kind, s["text"], text).alias("disguised"), *[values[f].cast("int").alias(f) for f in FEATURES])


def overlaps(s: Column, others: Column, same_kind: bool) -> Column:
    return F.exists(others, lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]) & ((s["kind"] == b["kind"]) if same_kind else F.lit(True)))


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble as plain nested tests, and the threshold of each kind (none: nothing of the kind is added)."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[int, float]

    def margin(self, x) -> Column:
        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + F.lit(weight) * _tests(tree, x)
        return total


def _tests(node, x) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, at, left, right = node
    return F.when(x[FEATURES[feature]] <= at, _tests(left, x)).otherwise(_tests(right, x))


def _nested(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def fit_trees(candidates: DataFrame) -> Trees | None:
    """Boosted trees on all candidates (FEATURES, confirmed, fold), two folds of three to fit and one to set thresholds.

    Candidates with the same features and label are one row with their number as its weight, which takes far fewer rows than there
    are candidates. Without confirmed and other candidates in the fitting folds there is nothing to learn: no model.
    """
    names = [f for f in FEATURES]
    known = stage(candidates.groupBy(*names, "confirmed", (F.col("fold") == 0).alias("held_out")).agg(F.count(F.lit(1)).alias("n")))
    total = known.where("not held_out").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.count_distinct("confirmed").alias("sorts")).first()
    if total["sorts"] < 2:
        return None
    known = VectorAssembler(inputCols=names, outputCol="x").transform(known)
    # tasks are dealt and ordered by value: in a single one the sums, and so the trees, come out the same each time
    tasks = -(-total["rows"] // FIT_ROWS)
    fitting = known.where("not held_out").withColumn("y", F.col("confirmed").cast("double"))
    fitting = fitting.repartition(tasks, F.xxhash64(*names)).sortWithinPartitions(*names, "confirmed").select("x", "y", F.col("n").cast("double").alias("n"))
    # cuts are looked for among as many rows as the square of the bins: with as many as this, among all
    bins = min(max(math.isqrt(total["rows"]) + 1, BINS[0]), BINS[1])
    model = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="n", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, minWeightFractionPerNode=min(LEAF / total["n"], 0.49), seed=1
    ).fit(fitting)
    java = model._java_obj
    trees = Trees(tuple(_nested(t.rootNode()) for t in java.trees()), tuple(float(w) for w in java.treeWeights()), {})
    scored = known.where("held_out").select("kind", "confirmed", "n", F.round(trees.margin({f: F.col(f) for f in names}), 2).alias("m"))
    counts = scored.groupBy("kind", "m").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("confirmed"), F.col("n")).otherwise(0)).alias("good")).collect()
    thresholds = {}
    for kind in {r["kind"] for r in counts}:
        n = good = 0
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["m"])
        for r, lower in zip(own, [*(x["m"] for x in own[1:]), None], strict=True):
            n, good = n + r["n"], good + r["good"]
            above = [x for x in counts if x["m"] >= r["m"]]
            mean = sum(x["good"] for x in above) / sum(x["n"] for x in above)
            if good + PRIOR * mean >= PRECISION * (n + PRIOR) and r["good"]:
                # no held-out candidate lies between a score and the next lower one: the middle parts them best
                thresholds[kind] = (r["m"] + lower) / 2 if lower is not None else min(r["m"], 0.0) - 0.005
    return Trees(trees.trees, trees.weights, thresholds)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base, added, spans (arrays of struct(kind, start, stop), code points, stop exclusive).

    ``base`` are the matches of the four patterns that pass their check, sorted by kind, then start. Generators propose wide,
    overlapping candidates; boosted trees score them by context and by form after ``undone``; they are fitted on all of them, on whether the base confirms a
    candidate as it stands or undone (never seeing the document's id or other columns), and a threshold per kind is set on held-out documents so that at least 95 % of what passes is
    confirmed (the mean of all kinds counts like ``PRIOR`` more candidates of each, so there is one rule for few and many). What passes and overlaps no base span is ``added``, the best first where such candidates
    overlap. ``spans`` are both, sorted alike.

    A null text counts as empty and has no spans. Rows are decided one by one, so ids may repeat or be null.
    Where no candidates or only such of one sort exist, nothing is added. An empty table gives none.

    Texts are scanned once, by native expressions; what is written holds matches and lengths, not texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [*BASE, *GENERATORS]
    scans = [pieces(text, p).alias(n) for n, p in BASE.items()] + [pieces(text, p).alias(n) for n, (p, _) in GENERATORS.items()]
    stored = stage(docs.select(F.col(id_col).alias("doc_id"), *scans))
    placed = with_starts(stored, names)
    base = F.concat(*[base_spans(k) for k in KINDS])
    proposed = F.concat(*[F.transform(spans_of(g), partial(candidate_features, k)) for g, (_, kinds) in GENERATORS.items() for k in kinds])
    rows = stage(placed.select("doc_id", base.alias("base"), proposed.alias("proposed")))

    trees = fit_trees(labelled(rows))
    found = rows.select("doc_id", "base", added_spans(trees).alias("added"))
    return found.select("*", F.array_sort(F.concat("base", "added")).alias("spans"))


def labelled(rows: DataFrame) -> DataFrame:
    """The proposed candidates one by one: FEATURES, fold, and whether a base span of their kind overlaps them or they are one once undone.

    Base spans of a kind do not overlap each other, so of those that start before a candidate's end the last reaches furthest. A window
    over both finds it; looking through all base spans for each candidate would be quadratic in a text's matches.
    """
    h = hash60(F.lit("pii"), F.col("doc_id"))
    names = [f for f in FEATURES if f != "kind"]
    mine = F.transform("proposed", lambda c: F.struct(c["kind"].alias("kind"), c["stop"].alias("at"), F.lit(None).cast("int").alias("reaches"), c.alias("c")))
    none = F.lit(None).cast(rows.schema["proposed"].dataType.elementType)
    others = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("at"), b["stop"].alias("reaches"), none.alias("c")))
    single = rows.where(F.size("proposed") > 0).select(F.monotonically_increasing_id().alias("row"), F.pmod(h, F.lit(3)).alias("fold"), F.concat(mine, others).alias("both"))
    single = single.select("row", "fold", F.inline("both"))
    # at one place the candidate comes first: a span that starts where it ends does not overlap it
    before = Window.partitionBy("row", "kind").orderBy("at", F.col("reaches").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = single.withColumn("furthest", F.last("reaches", ignorenulls=True).over(before)).where("c IS NOT NULL")
    return found.select("fold", (F.coalesce(F.col("furthest") > F.col("c.start"), F.lit(False)) | F.col("c.disguised")).alias("confirmed"), "kind", *[F.col(f"c.{f}").alias(f) for f in names])


def added_spans(trees: Trees | None) -> Column:
    """Candidates that reach their threshold and overlap neither a base span nor a better candidate."""
    none = F.array().cast(f"array<{SPAN}>")
    if trees is None or not trees.thresholds:
        return none
    least = F.lit(None).cast("double")
    scored = F.transform("proposed", lambda c: F.struct((-trees.margin(c)).alias("m"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")))

    def threshold(kind: Column) -> Column:
        value = least
        for k, t in sorted(trees.thresholds.items()):
            value = F.when(kind == k, F.lit(t)).otherwise(value)
        return value

    passed = F.array_sort(F.filter(scored, lambda c: F.coalesce(-c["m"] >= threshold(c["kind"]), F.lit(False)) & ~overlaps(c, F.col("base"), same_kind=False)))
    narrow = F.transform(passed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return F.aggregate(narrow, none, lambda kept, c: F.when(overlaps(c, kept, same_kind=False), kept).otherwise(F.concat(kept, F.array(c))))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<{}>") -> Column:
    """``text`` with every span replaced by the name of its kind in brackets; spans inside or across earlier ones go with those."""
    names = F.array(*[F.lit(mark.format(k)) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    end = F.aggregate(ordered, begin, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("done"), s["stop"].alias("at"),
    )).otherwise(F.struct(a["done"].alias("done"), F.greatest(a["at"], s["stop"]).alias("at"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["done"], F.substring(text, end["at"] + 1, F.char_length(text))))
