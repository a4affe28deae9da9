"""Personal data: wide candidate generators, boosted trees on format and context, calibrated thresholds. Columns only.

Four base kinds are defined by pattern and check (``BASE``); their spans always stay. ``GENERATORS`` propose more,
overlapping ones: loosely written mail addresses, account numbers, bare phone numbers, long keys. Each candidate
gets numbers on its format and on the 32 characters before it. Boosted trees, trained on the candidates of the whole
corpus, score it, and a threshold per generator, calibrated on the quarter kept out of the training, decides. Labels
come from strict checks (checksums, a naming word and sign right before). A candidate that passes its strict check
stays whatever the corpus held, so a kind too rare to be calibrated is found. Candidates with equal numbers are one
weighted row.
The trees become one SQL expression of nested conditions, evaluated inside each document's row: no shuffle, no
Python. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.ranking import running_sums
from ripplepanel.llm.common import texts
from ripplepanel.session import cut

# The base kinds in their order. A run is entered at its start, or where the last match ended; what
# was taken without alternative is not given back. Both keep matches as they are and matching linear.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9]){11,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[](?:at|AT)[)\]])\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{2,63}+){1,6}+"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z-])"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
)
KINDS = ("email", "ip", "card", "phone", "account", "secret")
CONTEXT = 32
TREES, DEPTH = 12, 3
#: The share of chosen calibration rows that must be right.
PRECISION = 0.98

_NAMES = {
    "says_mail": r"(?i)e-?mail|contact|mailto|write",
    "says_phone": r"(?i)\b(?:tel|phone|fax|mobile|call|cell|telefon|llame|appel)",
    "says_account": r"(?i)\b(?:iban|account|konto|cuenta|compte|bank)",
    "says_secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private|credential|bearer|auth)",
    "assigned": r"(?:=|:)\s*[\"']?$",
    "quoted": r"[\"'`]$",
}
FEATURES = (
    "length", "digits", "lower", "upper", "signs", "distinct", "changes", "hex", "at", "dots", "parens", "blanks",
    "checksum", *_NAMES)
_SPAN = "array<struct<start:int,end:int,kind:string,s:string>>"


def spans_of(rows: DataFrame, name: str, kind: str, pattern: str, when: Column | None = None) -> DataFrame:
    """Adds ``name``: all matches of a pattern in ``text`` with their offsets.

    The texts between the matches give the offsets: a match starts after all gaps and matches before it.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_found", found if when is None else F.when(when, found).otherwise(none))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(none))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(done: Column, i: Column) -> Column:
        first = done["at"] + F.length(F.get("_gaps", i))
        last = first + F.length(F.get("_found", i))
        span = F.struct(first.alias("start"), last.alias("end"), F.lit(kind).alias("kind"), F.get("_found", i).alias("s"))
        return F.struct(last.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    places = F.when(F.size("_found") > 0, F.sequence(F.lit(0), F.size("_found") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(name, F.aggregate(places, start, step, lambda done: done["spans"])).drop("_found", "_gaps")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(parts, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the remainder check (letters count 10 to 35)."""
    plain = F.regexp_replace(account, r"\x20", "")
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")

    def take(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(moved, lambda c: c.rlike("^[A-Z0-9]$")), F.lit(0), take) == 1


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of the four base kinds by start, then kind in its order."""
    has = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind, pattern in BASE:
        rows = spans_of(rows, f"_{kind}", kind, pattern, has.get(kind))
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    kept = {
        "email": F.col("_email"),
        "ip": F.filter("_ip", lambda x: F.forall(F.split(x["s"], r"\."), small)),
        "card": F.filter("_card", lambda x: F.length(_digits(x["s"])).between(12, 19) & luhn(_digits(x["s"]))),
        "phone": F.filter("_phone", lambda x: F.length(_digits(x["s"])).between(9, 15)),
    }
    return rows.withColumn("base", in_order(F.concat(*kept.values()))).drop(*(f"_{k}" for k, _ in BASE))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    keyed = F.transform(spans, lambda x: F.struct(x["start"], rank[x["kind"]].alias("rank"), x["end"], x["kind"].alias("kind"), x["s"].alias("s")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"], x["end"], x["kind"], x["s"]))


def features(s: Column, before: Column) -> dict[str, Column]:
    """Numbers on a candidate's format and on the text right before it."""
    size = F.length(s)
    count = lambda p: F.length(s) - F.length(F.regexp_replace(s, p, ""))
    out = {
        "length": size, "digits": count("[0-9]"), "lower": count("[a-z]"), "upper": count("[A-Z]"),
        "signs": count("[^A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(s, ""))),
        "changes": F.regexp_count(s, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")), "hex": count("[0-9a-fA-F]"),
        "at": count("@"), "dots": count(r"\."), "parens": count(r"[()\[\]]"), "blanks": count(r"\x20"),
        "checksum": F.when(s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]+$"), mod97(s)).otherwise(F.lit(False)).cast("int"),
    }
    out |= {name: before.rlike(pattern).cast("int") for name, pattern in _NAMES.items()}
    return {k: out[k].cast("double") for k in FEATURES}


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``proposed``: every generator's spans that are not base spans, with the text right before each."""
    for i, (kind, pattern) in enumerate(GENERATORS):
        rows = spans_of(rows, f"_g{i}", kind, pattern)
    every = F.concat(*(f"_g{i}" for i in range(len(GENERATORS))))
    fresh = F.filter(every, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    before = F.transform(fresh, lambda x: F.struct(
        x["start"], x["end"], x["kind"], x["s"],
        F.substring("text", F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(x["start"], F.lit(CONTEXT))).alias("before")))
    return rows.withColumn("proposed", before).drop(*(f"_g{i}" for i in range(len(GENERATORS))))


def seed_label(kind: Column, f: dict[str, Column]) -> Column:
    """The strict checks that label candidates."""
    named = {"phone": "says_phone", "secret": "says_secret"}
    return (
        F.when(kind == "email", (f["at"] + f["parens"] >= 1) & ((f["parens"] >= 2) | (f["blanks"] == 0)))
        .when(kind == "account", f["checksum"] == 1)
        .when(kind == "phone", (f[named["phone"]] == 1) & (f["digits"] >= 9) & (f["digits"] <= 13))
        .otherwise((f[named["secret"]] == 1) & (f["assigned"] == 1) & (f["digits"] >= 4) & (f["changes"] >= 3))
        .cast("double"))


@dataclass(frozen=True)
class Detector:
    """Each tree as a nested SQL condition over ``x.<feature>``, and the least score per generator kind."""

    trees: tuple[str, ...]
    floor: dict[str, float]

    def score(self) -> str:
        total = " + ".join(self.trees) or "-20.0D"
        return f"1 / (1 + exp(-2 * ({total})))"

    def chosen(self, proposed: str) -> Column:
        """The proposed spans (with features) that pass their strict check or reach their generator's threshold."""

        def strict(x: Column) -> Column:
            return seed_label(x["kind"], {k: x[k] for k in FEATURES}) == 1

        if not self.floor:
            return F.filter(proposed, strict)
        floors = " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in sorted(self.floor.items()))
        scored = F.expr(f"filter({proposed}, x -> {self.score()} >= CASE x.kind {floors} ELSE 2.0D END)")
        return F.array_union(scored, F.filter(proposed, strict))


def _tree_sql(node, weight: float) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{weight * node.prediction()!r}D"
    split = node.split()
    left, right = _tree_sql(node.leftChild(), weight), _tree_sql(node.rightChild(), weight)
    return f"(CASE WHEN x.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {left} ELSE {right} END)"


def fit_detector(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Detector:
    """Train on three quarters of all generators' candidates, by hash of text and place, and calibrate on the rest.

    A corpus without both labels gives a detector of the strict checks alone. A candidate that a document repeats
    with the same text before it counts once.
    """
    rows = candidates(base_spans(texts(docs, keys=("doc_id",))))
    each = rows.select("doc_id", F.explode("proposed").alias("c")).select("doc_id", "c.kind", "c.s", "c.before").distinct()
    made = features(F.col("s"), F.col("before"))
    each = each.select("kind", (F.pmod(F.xxhash64("s", "before"), F.lit(4)) > 0).alias("learn"),
                       seed_label(F.col("kind"), made).alias("label"), *(c.alias(k) for k, c in made.items()))
    table = cut(each.groupBy("kind", "learn", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")), "private")
    learn = table.where("learn").groupBy("label", *FEATURES).agg(F.sum("weight").alias("weight"))
    learn = learn.repartition(*FEATURES).sortWithinPartitions(*FEATURES, "label")
    if learn.select("label").distinct().count() < 2:
        return Detector((), {})
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
                          stepSize=0.3, seed=11).fit(gather.transform(learn))
    nodes = tuple(_tree_sql(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True))
    made_of = ", ".join(f"'{k}', {k}" for k in FEATURES)
    scored = table.where("not learn").withColumn("x", F.expr(f"named_struct({made_of})"))
    return Detector(nodes, thresholds(scored.select("kind", "label", "weight", F.expr(Detector(nodes, {}).score()).alias("score"))))


def calibrate(rows: Sequence[tuple[str, float, float]], precision: float = PRECISION) -> dict[str, float]:
    """``thresholds`` of (kind, score, label) rows in hand, each counted once."""
    floor = {}
    for kind in sorted({k for k, _, _ in rows}):
        mine = sorted(((s, y) for k, s, y in rows if k == kind), reverse=True)
        right = 0.0
        for i, (s, y) in enumerate(mine):
            right += y
            last_of_ties = i + 1 == len(mine) or mine[i + 1][0] < s
            if last_of_ties and s >= 0.5 and right / (i + 1) >= precision:
                floor[kind] = round(s - 1e-9, 9)
    return floor


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the least score, 0.5 or more, from which the given share of the weight is labelled 1; absent without such.

    ``scored`` has kind, label, weight and score; only a score per kind reaches the driver.
    """
    steps = scored.where("score >= 0.5").groupBy("kind", (-F.col("score")).alias("down")).agg(
        F.sum("weight").alias("whole"), F.sum(F.col("weight") * F.col("label")).alias("right"))
    upto = running_sums(steps, ["kind"], ["down"], ["whole", "right"]).where(F.col("right_upto") / F.col("whole_upto") >= precision)
    found = upto.groupBy("kind").agg((-F.max("down")).alias("score")).collect()
    return {r["kind"]: round(r["score"] - 1e-9, 9) for r in sorted(found)}


def find_personal_data(docs: DataFrame, detector: Detector, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``text`` (null: empty), ``base`` and ``all_spans`` (base and added, by start, then kind)."""
    rows = candidates(base_spans(texts(docs, keys=tuple(keep))))

    def with_features(x: Column) -> Column:
        return F.struct(x["start"], x["end"], x["kind"], x["s"], *(c.alias(k) for k, c in features(x["s"], x["before"]).items()))

    rows = rows.withColumn("_scored", F.transform("proposed", with_features))
    rows = rows.withColumn("_more", detector.chosen("_scored"))
    more = F.transform("_more", lambda x: F.struct(x["start"], x["end"], x["kind"], x["s"]))
    return rows.withColumn("all_spans", in_order(F.concat("base", more))).drop("proposed", "_scored", "_more")


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, detector: Detector) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` and ``spans`` for every row.

    A null or empty text has no spans (the hash of nothing). Repeated rows and null ids keep a row each; only id
    and text are read. Equal spans of two generators count once.
    """
    found = find_personal_data(docs, detector)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k, _ in BASE), F.sha2(_said("base").cast("binary"), 256).alias("base_sha256"),
        _said("all_spans").alias("spans"))


def redact(text: str = "text", spans: str = "all_spans") -> Column:
    """The text with each stretch of overlapping spans replaced by the kind of its first span in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        fresh = F.concat(done["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"),
                        F.when(x["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
