"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Documents are added up to cells of source, language and topic. Each dimension has a factor per value; a round goes
through the dimensions and multiplies a dimension's factors by target over current share, until all shares agree.
Cells carry their factors; a round is one job that writes them anew, and only its largest deviation and the sums for the
extrapolation reach the driver. From two rounds a third set of factors is extrapolated (Irons and
Tuck, on logarithms); where that brings the shares no nearer, it goes on from the rounds' own factors. A cell's weight is the product of its factors. Probabilities are at most 1 and keep the asked share of
tokens: raking goes on under that bound until tokens times probability have the shares too. A value that would need
more than all its tokens is kept whole, and the others of its dimension share the rest (``mixture_shares`` tells). A
document stays when the hash of its id, as a number from 0 to 1, lies below the probability of its cell.

Documents have no topic column; unless the caller names one, the topic is the form of the text (``form_of``).
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ripplepanel.session import cut as write_table
from ripplepanel.session import cut_at, discard

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its own share to this power, scaled to one. Below 1 small values gain.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
KEEP_SHARE, TOLERANCE, ROUNDS = 0.6, 1e-4, 30
#: Rounds of the raking under the bound, which settles more slowly.
BOUND_ROUNDS = 100
#: Files of a table of cells or factors: these hold a row per value, not per document.
FILES = 8


def cut(df: DataFrame, tag: str) -> DataFrame:
    return write_table(df.coalesce(FILES), tag)


def words_of(text: str = "text") -> Column:
    """The number of words of a text, null: 0."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def form_of(text: str = "text") -> Column:
    """The form of a text as its topic: marked, shouted, listed, lined or prose; null and empty are prose."""
    said, size = F.coalesce(F.col(text), F.lit("")), F.greatest(F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    count = lambda s: (F.octet_length(said) - F.octet_length(F.replace(said, F.lit(s), F.lit("")))) / len(s)
    return (
        F.when(count("|") > size / 40, "listed").when(count("!") > size / 40, "shouted")
        .when(count("***") + count("$$$") > size / 60, "marked").when(count("\n") > size / 120, "lined").otherwise("prose"))


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Adds the document's cell, size and draw under private names; null dimensions are values of their own."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), F.lit(1 << 40))
    return docs.withColumns({
        "_source": F.coalesce(F.col("source"), F.lit("\x00none")), "_lang": F.coalesce(F.col("lang"), F.lit("\x00none")),
        "_topic": F.coalesce(topic if topic is not None else form_of(), F.lit("\x00none")),
        "_tokens": words_of(), "_draw": draw / float(1 << 40)})


def tempered_targets(cells: DataFrame, temper: Mapping[str, float] = TEMPER) -> dict[str, DataFrame]:
    """Per dimension a table ``value, target``."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        sums = sums.withColumn("raw", F.pow("tokens", F.lit(temper[d])))
        whole = sums.agg(F.sum("raw")).first()[0]
        out[d] = sums.select("value", (F.col("raw") / (whole or 1.0)).alias("target"))
    return out


def _weight(bounded: bool) -> Column:
    """The product of a cell's factors, 0 where a dimension has none; bounded, at most 1, and 1 in cells of a whole value."""
    weight, whole = F.lit(1.0), F.lit(False)
    for d in DIMENSIONS:
        weight, whole = weight * F.coalesce(F.col(f"_f_{d}"), F.lit(0.0)), whole | F.coalesce(F.col(f"_w_{d}"), F.lit(False))
    return F.when((weight > 0) & whole, 1.0).otherwise(F.least(F.lit(1.0), weight)) if bounded else weight


def _placed(cells: DataFrame, factors: Mapping[str, DataFrame]) -> tuple[DataFrame, str, bool]:
    """Cells with aim, factor and whole of their values, written; and whether a value with an aim has no cell at all.

    ``_one_<dimension>`` marks one cell of each value, so that what is added up over values counts each once.
    """
    rows, lost = cells, None
    for d in DIMENSIONS:
        named = factors[d].select(F.col("value").alias(f"_{d}"), F.col("aim").alias(f"_a_{d}"), F.col("factor").alias(f"_f_{d}"),
                                  F.lit(None).cast("double").alias(f"_l_{d}"), F.col("whole").alias(f"_w_{d}"))
        bare = named.where(f"_a_{d} > 0").join(cells, f"_{d}", "left_anti").select(F.lit(1).alias("one"))
        lost = bare if lost is None else lost.union(bare)
        rows = rows.join(named, f"_{d}", "left")
    for d in DIMENSIONS:
        order = Window.partitionBy(f"_{d}").orderBy(*(f"_{k}" for k in DIMENSIONS))
        rows = rows.withColumn(f"_one_{d}", (F.row_number().over(order) == 1) & F.col(f"_a_{d}").isNotNull())
    made, path = cut_at(rows.coalesce(FILES), "mix_round")
    return made, path, lost.limit(1).count() > 0


def _round(state: DataFrame, bounded: bool) -> tuple[DataFrame, str, dict]:
    """The cells after one step of every dimension, as one written table, with the factors before (``_l_``).

    What is observed while writing: the largest deviation before a step, and the sums for the extrapolation.
    """
    off, along, turn, drop = [], [], [], []
    for d in DIMENSIONS:
        aim, factor, last, of_value = F.col(f"_a_{d}"), F.col(f"_f_{d}"), F.col(f"_l_{d}"), Window.partitionBy(f"_{d}")
        weight = F.col("_weight")
        full = (weight >= 1) if bounded else F.lit(False)
        state = state.withColumn("_weight", _weight(bounded)).withColumns({
            "_held": F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(of_value),
            "_free": F.sum(F.when(~full, F.col("tokens") * weight).otherwise(0.0)).over(of_value)})
        held, free = F.col("_held"), F.col("_free")
        ratio = F.when((free > 0) & (aim > held), (aim - held) / free)
        fresh = F.when(held + free > 0, factor * F.coalesce(ratio, aim / (held + free))).otherwise(0.0)
        state = state.withColumns({
            f"_f_{d}": F.when(aim.isNotNull(), fresh), f"_l_{d}": factor, f"_o_{d}": last,
            f"_off_{d}": F.when(aim > 0, F.abs((held + free) / aim - 1)).otherwise(0.0)}).drop("_held", "_free")
        factor, last, older = F.col(f"_f_{d}"), F.col(f"_l_{d}"), F.col(f"_o_{d}")
        moved, earlier = F.log(factor) - F.log(last), F.log(last) - F.log(older)
        known = F.col(f"_one_{d}") & (factor > 0) & (last > 0) & (older > 0)
        off.append(F.col(f"_off_{d}"))
        along.append(F.when(known, moved * (moved - earlier)).otherwise(0.0))
        turn.append(F.when(known, (moved - earlier) * (moved - earlier)).otherwise(0.0))
        drop += [f"_o_{d}", f"_off_{d}"]
    seen = Observation()
    made, path = cut_at(state.observe(
        seen, F.max(F.greatest(*off)).alias("off"), F.sum(along[0] + along[1] + along[2]).alias("along"),
        F.sum(turn[0] + turn[1] + turn[2]).alias("turn")).drop("_weight", *drop).coalesce(FILES), "mix_round")
    return made, path, seen.get


def _sweeps(
    cells: DataFrame, factors: dict[str, DataFrame], tolerance: float, rounds: int, bounded: bool,
) -> tuple[DataFrame, float]:
    """Cells with ``weight`` after rounds over the dimensions, and how far the worst value was off in the last one.

    ``factors`` has ``value, aim, factor, whole`` per dimension. Bounded weights are at most 1, and 1 in cells of a
    value that is kept whole; a step then moves only what lies below 1. The factors stand in the cells' own rows: a
    round is one job, whose steps add up the cells of each value.
    """
    spark, none = cells.sparkSession, F.lit(None).cast("double")
    now, path, lost = _placed(cells, factors)
    worst, safe, since = 0.0, None, 0
    for number in range(rounds):
        before = path
        now, path, got = _round(now, bounded)
        off, along, turn = max(got["off"] or 0.0, float(lost)), got["along"] or 0.0, got["turn"] or 0.0
        since += 1
        if safe is not None and since == 1 and off > 2 * safe[1]:  # the extrapolated factors were worse
            discard(spark, path)
            now, path, worst, since = safe[0].withColumns({f"_l_{d}": none for d in DIMENSIONS}), safe[2], safe[1], 0
            safe = None
            continue
        discard(spark, before)
        worst = off
        if worst <= tolerance or number == rounds - 1:
            break
        if since >= 2 and turn > 0 and along < 0:
            safe, since = (now, worst, path), 0
            power = F.lit(min(-along / turn, 1e3))
            now = now.withColumns(
                {f"_f_{d}": F.when((F.col(f"_f_{d}") > 0) & (F.col(f"_l_{d}") > 0),
                                   F.col(f"_f_{d}") * F.pow(F.col(f"_f_{d}") / F.col(f"_l_{d}"), power)).otherwise(F.col(f"_f_{d}"))
                 for d in DIMENSIONS} | {f"_l_{d}": none for d in DIMENSIONS})
    return now.withColumn("weight", _weight(bounded)).select(*cells.columns, "weight"), worst


def _unsettled(worst: float, rounds: int, strict: bool) -> None:
    said = f"shares still off by {worst:g} after {rounds} rounds: the targets contradict each other"
    if strict:
        raise ValueError(said)
    warnings.warn(said, stacklevel=3)


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, strict: bool = False,
) -> DataFrame:
    """Adds ``weight``: multipliers for which the weighted tokens have the target shares in each dimension.

    Values without target or tokens get 0. Empty cells may keep targets from being met together; then the shares of
    the last dimension are met and the others as nearly as ``rounds`` rounds bring them, with a warning, or ``strict``
    raises.
    """
    factors = {d: cut(targets[d].select(
        "value", F.col("target").alias("aim"), F.lit(1.0).alias("factor"), F.lit(False).alias("whole")), f"mix_{d}") for d in DIMENSIONS}
    out, worst = _sweeps(cells, factors, tolerance, rounds, False)
    if worst > tolerance:
        _unsettled(worst, rounds, strict)
    return out


def calibrate(cells: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Adds ``probability``: min(1, c weight) with the c that keeps ``keep_share`` of all tokens in expectation.

    When so many cells have weight 0 that the share cannot be kept, all others are kept whole.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    most = cells.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0
    goal, c = keep_share * total, 0.0
    if goal >= most:
        return cells.withColumn("probability", F.when(F.col("weight") > 0, 1.0).otherwise(0.0))
    while True:  # each pass fixes more cells at 1, so this ends after as many passes as there are such steps
        full = F.col("weight") * c >= 1
        held, free = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("tokens") * F.col("weight")))).first()
        fresh = (goal - (held or 0)) / free if free else c
        if fresh <= c * (1 + 1e-12):
            return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * c))
        c = fresh


def attainable(cells: DataFrame, targets: Mapping[str, DataFrame], keep_share: float = KEEP_SHARE) -> dict[str, DataFrame]:
    """Per dimension ``value, target, tokens, aim``: the tokens to keep of each value, the targets' share where that exists.

    A value whose target share of the kept tokens is more than all its tokens is kept whole (``aim = tokens``); the
    other values share the rest in proportion to their targets.
    """
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("tokens"))
        rows = sums.join(targets[d].select("value", "target"), "value", "left").fillna(0.0, ["target"])
        rows = cut(rows.withColumn("weight", F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(0.0)), f"mix_aim_{d}")
        out[d] = calibrate(rows, keep_share).select("value", "target", "tokens", (F.col("tokens") * F.col("probability")).alias("aim"))
    return out


def bound(
    cells: DataFrame, aims: Mapping[str, DataFrame], keep_share: float = KEEP_SHARE, tolerance: float = TOLERANCE,
    rounds: int = BOUND_ROUNDS, strict: bool = False,
) -> DataFrame:
    """Adds ``probability``: at most 1, and tokens times probability add up to the aims of every dimension.

    Raking goes on under the bound from the calibrated weights. Where that does not settle, there is a warning, or
    ``strict`` raises.
    """
    start = cut(calibrate(cells, keep_share), "mix_start")
    if not start.where(F.col("probability") >= 1).limit(1).count():
        return start
    whole = (F.col("target") > 0) & (F.col("aim") >= F.col("tokens") * (1 - 1e-12))
    factors = {d: cut(aims[d].where("tokens > 0 AND target > 0").select(
        "value", "aim", F.lit(1.0).alias("factor"), whole.alias("whole")), f"mix_{d}") for d in DIMENSIONS}
    names = [f"_{d}" for d in DIMENSIONS]
    out, worst = _sweeps(cells.select(*names, "tokens"), factors, tolerance, rounds, True)
    if worst > tolerance:
        _unsettled(worst, rounds, strict)
    return cells.join(out.select(*names, F.col("weight").alias("probability")), names)


def mixture_shares(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``dimension, value, target, share, most``: what the probabilities keep against the target share of each value.

    ``most`` is the largest keep share at which the value can have its target; the least of these is the keep share
    up to which all targets can be met.
    """
    total, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    said = None
    for d, target in (targets or tempered_targets(cells)).items():
        sums = cells.groupBy(F.col(f"_{d}").alias("value")).agg(
            F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("now"))
        rows = target.select("value", "target").join(sums, "value", "full").fillna(0.0, ["target", "now"]).fillna(0, ["tokens"]).select(
            F.lit(d).alias("dimension"), "value", "target", (F.col("now") / float(kept or 1)).alias("share"),
            F.when(F.col("target") > 0, F.col("tokens") / (F.col("target") * float(total or 1))).alias("most"))
        said = rows if said is None else said.unionByName(rows)
    return said


def cell_probabilities(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None,
) -> DataFrame:
    """A row per cell: its dimensions, documents, tokens, weight and probability."""
    cells = with_cells(docs, topic).groupBy(*(f"_{d}" for d in DIMENSIONS)).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("_tokens").alias("tokens"))
    # the first write keeps its tasks: it reads the documents
    cells = cut(write_table(cells, "mix_cells"), "mix_cells")
    targets = targets or tempered_targets(cells)
    raked = cut(rake(cells, targets), "mix_raked")
    return cut(bound(raked, attainable(cells, targets, keep_share), keep_share), "mix_cells")


def sample_mixture(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None,
) -> DataFrame:
    """``doc_id, topic, n_tokens, weight, probability, kept`` for every row of ``docs``.

    Rows of equal id share their draw. A null id draws by its text; null source, language or topic is a value like
    any other; a null or empty text has 0 tokens and its cell's probability (0 in a cell without tokens). Other
    columns are not read.
    """
    cells = cell_probabilities(docs, targets, keep_share, topic).select(*(f"_{d}" for d in DIMENSIONS), "weight", "probability")
    rows = with_cells(docs, topic).select("doc_id", *(f"_{d}" for d in DIMENSIONS), "_tokens", "_draw")
    return rows.join(cells, [f"_{d}" for d in DIMENSIONS]).select(
        "doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "probability",
        (F.col("_draw") < F.col("probability")).alias("kept"))


def keep_mixture(docs: DataFrame, keep_share: float = KEEP_SHARE, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns."""
    cells = cell_probabilities(docs, None, keep_share, topic)
    cells = cells.select(*(f"_{d}" for d in DIMENSIONS), F.col("probability").alias("_probability"))
    rows = with_cells(docs, topic).join(cells, [f"_{d}" for d in DIMENSIONS])
    return rows.where(F.col("_draw") < F.col("_probability")).select(*docs.columns)
