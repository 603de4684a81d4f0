"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target size; target / source size is the expected number of
copies of each of its documents, between 0 and 3. The whole part is taken; the
fractions are rounded by the pivotal method. The mass of a fraction is its share of
the document's words: two fractional documents meet, and as much mass as possible
moves from one to the other, in a direction drawn so that both expectations are
kept, until one of them is taken whole or not at all. So the words of a source stay
what they were expected to be, up to one last document.

The meetings form a reduction tree: documents of a source are dealt by a hash into
blocks of a few dozen, in each of which neighbours by size meet, from the largest
to the smallest; at most one fraction is left of a block, and the blocks' leftovers
meet by the same rule in blocks of blocks. What is left is a large document mostly,
so documents are rounded in a few classes of size, the largest first: the last of a
class meets all smaller documents of its source at once, whose common fraction takes
up the difference. Masses are integers in units of a
2**-30th of a word, and randomness is a hash of the two parties, so reruns agree.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import cut, word_count
from quire.operators.running import running

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
ONE = 1 << 30
BLOCK, FAN_BITS = 48, 5
SEED = 42
#: Sizes from which the classes begin, the largest class first.
CLASSES = (1024, 128, 1)
#: Tables of one row for each source are broadcast up to this many rows (under 10 MB); beyond it they are shuffled.
BROADCAST_SOURCES = 50_000
#: Equal rows that are laid out at once.
_ROWS = 4096
_UNIT = "struct<doc_id:long,size:long,mass:long>"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, n, source_size, target) of sources (source, n, source_size), one row for each source, null among them.

    Sources are numbered by code point, null last; weights repeat along them. The common level t with
    target = min(cap * source_size, weight * t) comes from one pass of running sums over the sources, of which no
    list is collected.
    """
    one = sources.withColumn("all", F.lit(0))
    numbered = running(one, ["all"], [F.col("source").asc_nulls_last()], {"number": ("sum", F.lit(1).cast("long"))})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    weighted = cut(numbered.withColumn("weight", weight).drop("number"))
    all_ = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.sum("weight").alias("weight")).first()
    level = 0.0
    if all_["size"]:
        # If the sources that are first by cap * size / weight are full, the others share the rest: no such level is above the true one.
        reached = F.lit(cap) * F.col("source_size")
        full = running(weighted, ["all"], [reached / F.col("weight"), F.col("source").asc_nulls_last()], {"full": ("sum", reached), "used": ("sum", F.col("weight"))})
        rest = F.lit(float(all_["weight"])) - F.col("used")
        best = full.where(rest > 0.5 * min(weights)).agg(F.max((F.lit(all_["size"]) - F.col("full")) / rest)).first()[0]
        level = max(all_["size"] / all_["weight"], best or 0.0)
    return weighted.select("source", "n", "source_size", F.least(F.col("weight") * F.lit(level), (cap * F.col("source_size")).cast("double")).alias("target"))


def _draw(a: Column, b: Column, source: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(SEED), source, a["doc_id"], a["size"], b["doc_id"], b["size"]), F.lit(ONE)) / F.lit(float(ONE))


def _meet(units: Column, source: Column) -> Column:
    """struct<left: unit or null, won: array of units> after the units met one after another."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("won"))
    full = lambda x: x["size"] * ONE
    holding = lambda x, mass: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), mass.alias("mass"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        to_a = F.least(full(a) - a["mass"], b["mass"])  # the most that can move to a, and to b
        to_b = F.least(full(b) - b["mass"], a["mass"])
        moved = F.when(_draw(a, b, source) * (to_a + to_b) < to_b, to_a).otherwise(-to_b)
        met = F.transform(F.array(moved), lambda m: F.struct(holding(a, a["mass"] + m).alias("a"), holding(b, b["mass"] - m).alias("b")))[0]
        return settle(acc, met["a"], met["b"])

    def settle(acc: Column, a: Column, b: Column) -> Column:
        whole = lambda x: x["mass"] == full(x)
        left = F.when((a["mass"] == 0) | whole(a), b).otherwise(a)
        won = F.filter(F.array(a, b), whole)
        return F.struct(F.when(whole(left), holding(left, F.lit(0).cast("long"))).otherwise(left).alias("left"), F.concat(acc["won"], won).alias("won"))

    def first_or_step(acc: Column, b: Column) -> Column:
        fresh = acc["left"].isNull() | (acc["left"]["mass"] == 0)
        return F.when(fresh, F.struct(holding(b, b["mass"]).alias("left"), acc["won"].alias("won"))).otherwise(step(acc, b))

    return F.aggregate(units, start, first_or_step)


def _level(units: DataFrame) -> DataFrame:
    """One level of the tree: (source, block, depth, left, won) of units (source, block, depth, unit)."""
    by_size = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("unit.size")).alias("k"), F.col("unit")))), lambda x: x["unit"])
    grouped = units.groupBy("source", "block", "depth").agg(by_size.alias("units"))
    return cut(grouped.select("source", "block", "depth", _meet(F.col("units"), F.col("source")).alias("m")).select("source", "block", "depth", "m.left", "m.won"))


def round_fractions(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken (source, doc_id, size), left (source, unit)) of units (source, doc_id, size, mass, n): mass under size * 2**30,
    n at least the units of the source. left is the one fraction that remains of a source, if any."""
    depth = F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(BLOCK)))), F.lit(0)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(SEED), "source", "doc_id", "size"), F.pow(F.lit(2.0), depth).cast("long"))
    level = units.select("source", block.alias("block"), depth.alias("depth"), F.struct("doc_id", "size", "mass").alias("unit"))
    most = units.agg(F.max("n")).first()[0] or 0
    levels = ceil(log2(most / BLOCK) / FAN_BITS) if most > BLOCK else 0
    taken = None
    for _ in range(levels + 1):
        done = _level(level)
        won = done.select("source", F.explode("won").alias("u")).select("source", "u.doc_id", "u.size")
        taken = won if taken is None else taken.union(won)
        level = done.where("left.mass > 0").select("source", F.shiftright("block", FAN_BITS).alias("block"), "depth", F.col("left").alias("unit"))
    return taken, level.select("source", "unit")


def _last_meets_rest(state: DataFrame, left: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state (source, fine), taken) after the last unit of each source met its smaller documents as one.

    rest has (source, words) of these documents, whose fraction is fine out of 2**30. What the last unit gives
    or gets is spread over them evenly. If they are too few to settle it, it is taken with its own probability.
    """
    l = left.select(F.col("source").alias("l_source"), "unit")
    r = rest.select(F.col("source").alias("r_source"), "words")
    met = state.join(l, F.col("source").eqNullSafe(F.col("l_source")), "left").join(r, F.col("source").eqNullSafe(F.col("r_source")), "left")
    words = F.coalesce(F.col("words"), F.lit(0)).cast("double")
    size, mass, held = F.col("unit.size").cast("double"), F.col("unit.mass") / F.lit(float(ONE)), F.col("fine") / F.lit(float(ONE)) * words
    to_unit, to_rest = F.least(size - mass, held), F.least(words - held, mass)
    u = F.pmod(F.xxhash64(F.lit(SEED + 2), "source", "unit.doc_id", "unit.size"), F.lit(ONE)) / F.lit(float(ONE))
    met = cut(met.select("source", "fine", "unit", words.alias("words"), size.alias("size"), mass.alias("mass"), held.alias("held"), F.when(u * (to_unit + to_rest) < to_rest, to_unit).otherwise(-to_rest).alias("moved")))
    after = F.col("mass") + F.col("moved")
    kept = F.when(F.col("unit").isNull() | (F.col("words") == 0), F.col("fine")).otherwise(F.least(F.greatest(F.round((F.col("held") - F.col("moved")) / F.col("words") * ONE).cast("long"), F.lit(0)), F.lit(ONE)))
    v = F.pmod(F.xxhash64(F.lit(SEED + 1), "source", "unit.doc_id", "unit.size"), F.lit(ONE)) / F.lit(float(ONE))
    taken = met.where(F.col("unit").isNotNull() & (v * F.col("size") < after)).select("source", "unit.doc_id", "unit.size")
    return met.select("source", kept.alias("fine")), taken


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row of docs (doc_id, text, source, ...).

    size counts words, 0 for null and empty texts; taken = copies * size. A null source is a source of its
    own, numbered last; null doc_ids are kept. Rows equal in doc_id, source and size share their copies as
    evenly as whole numbers allow and stay separate rows. A source without words has target 0. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    groups = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    sources = groups.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = cut(source_targets(sources, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    fine = F.round(rate * ONE).cast("long")
    rates = cut(targets.select("source", "source_size", "target", F.floor(fine / ONE).alias("whole"), (fine % ONE).alias("fine")))
    few = rates.count() <= BROADCAST_SOURCES
    held = F.broadcast if few else (lambda df: df)  # a hot source is then never one task
    kind = F.coalesce(*[F.when(F.col("size") >= least, k) for k, least in enumerate(CLASSES)])  # null: no words
    sized = groups.withColumn("kind", kind)
    counts = cut(sized.where("kind is not null").groupBy("source", "kind").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words")))
    state, shares, taken = rates.select("source", "fine"), None, None
    for k in range(len(CLASSES)):
        n_of = counts.where(F.col("kind") == k).select(F.col("source").alias("n_source"), "n")
        now = state.join(n_of, F.col("source").eqNullSafe(F.col("n_source"))).select(F.col("source").alias("s_source"), "fine", "n")
        members = sized.where(F.col("kind") == k).join(held(now), F.col("source").eqNullSafe(F.col("s_source")))
        share = F.col("fine") * F.col("rows")
        units = members.select("source", "doc_id", "size", (share % ONE * F.col("size")).alias("mass"), "n").where("mass > 0")
        won, left = round_fractions(units)
        rest = counts.where(F.col("kind") > k).groupBy("source").agg(F.sum("words").alias("words"))
        fines = state.select("source", "fine", F.lit(k).alias("kind"))
        shares = fines if shares is None else shares.union(fines)
        state, last = _last_meets_rest(state, left, rest)
        taken = won.union(last) if taken is None else taken.union(won).union(last)
    of_kind = shares.select(F.col("source").alias("f_source"), F.col("fine").alias("f"), F.col("kind").alias("f_kind"))
    of_source = rates.select(F.col("source").alias("of_source"), "source_size", "target", "whole")
    planned = sized.join(held(of_source), F.col("source").eqNullSafe(F.col("of_source"))).join(held(of_kind), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("kind") == F.col("f_kind")), "left")
    planned = planned.withColumn("sure", F.floor(F.coalesce("f", F.lit(0)) * F.col("rows") / ONE))
    t = taken.select(F.col("source").alias("t_source"), F.col("doc_id").alias("t_doc_id"), F.col("size").alias("t_size"), F.lit(1).alias("won"))
    same = F.col("source").eqNullSafe(F.col("t_source")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("size") == F.col("t_size"))
    decided = planned.join(t, same, "left").select("doc_id", "source", "size", "rows", "source_size", "target", "whole", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("extra"))
    # equal rows are counted off in blocks, so no array holds all of them
    blocks = decided.withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {_ROWS})")))
    each = blocks.withColumn("i", F.explode(F.expr(f"sequence(block * {_ROWS} + 1, least(rows, (block + 1) * {_ROWS}))")))
    copies = F.col("whole") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
