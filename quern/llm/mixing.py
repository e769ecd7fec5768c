"""Mixing sources to target weights, with DataFrame operations only.

A tree (by default domain, language, source) is given a token budget.  Each node passes its
budget to its children by weight.  A child that cannot use its part, because all documents
below it times ``max_epochs`` hold fewer tokens, gets what it can use and its siblings share
the rest by weight; what a whole family cannot use goes to the family's siblings in turn.  A
leaf of budget b and s tokens takes each of its documents floor(b / s) times and then, in the
order of md5(seed:epoch:doc_id), the longest prefix of one more epoch that stays within b.

A child of weight 0 has no room, so what it might have used stays with its siblings.

Only token counts and sums by leaf are shuffled, never texts.  The end of a leaf's prefix is found
by ``ROUNDS`` rounds of sums by the next ``DIGITS`` digits of the digest, each inside the slice
that the budget ended in before, and among the rows of the last slice, so a leaf with a third of
the rows is never sorted in one task.

Odd rows: a null text counts 0 tokens; null levels are nodes of their own; null ids share one
place in the order; equal digests (repeated ids) are taken together or not at all; a leaf
without tokens, and a node of weight 0, yields nothing; an empty table yields no rows; input
columns that are named like an added one are replaced, all others stay; a text of any length is
counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.labelled import fresh
from quern.sources.workspace import Workspace

WORD = r"[^\x09-\x0D\x20]+"
DIGITS = 2
ROUNDS = 3
LEVELS = ("domain", "language", "source")
#: Relative weights among siblings by path; 1 where none is given.
WEIGHTS = {"domain0": 2.0, "domain1": 1.0, "domain2": 1.0, "domain3": 1.0}
LANGUAGE_WEIGHTS = {"en": 3.0, "fr": 1.0, "de": 1.0, "es": 1.0}
SHARE = 0.6
SEED = 11


def token_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _by_weight(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """Share each family's ``budget`` by ``weight`` up to every child's ``room``, as ``given``.

    Children are ordered by room per weight.  A child is full if, were all from it on raised to
    its own level, the family's budget would not be exceeded; the others share what is left.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("level", F.when(F.col("weight") > 0, F.col("room") / F.col("weight")))
    order = family.orderBy(F.col("level").asc_nulls_last(), "name")
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("room"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_on = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("before", before).withColumn("weight_on", weight_on)
    full = F.col("before") + F.col("level") * F.col("weight_on") <= F.col(budget)
    nodes = nodes.withColumn("full", F.coalesce(full, F.lit(False)))
    open_level = F.when(~F.col("full") & (F.col("weight") > 0), (F.col(budget) - F.col("before")) / F.col("weight_on"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumn("open_level", F.first(open_level, ignorenulls=True).over(whole))
    given = F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("room")).otherwise(F.col("weight") * F.col("open_level"))
    return nodes.withColumn("given", given).drop("level", "before", "weight_on", "full", "open_level")


def leaf_budgets(leaves: DataFrame, weight: dict[int, Column], share: float, max_epochs: int) -> DataFrame:
    """``(n0, n1, n2, tokens, budget)`` from the tokens of each leaf, by domain, language, source.

    ``weight`` has a column over n0, n1, n2 for each level; other levels weigh 1.
    """
    keys = ["n0", "n1", "n2"]
    def room(nodes: DataFrame, depth: int, usable: Column) -> DataFrame:
        own = F.coalesce(weight.get(depth, F.lit(1.0)), F.lit(1.0)).cast("double")
        return nodes.withColumn("weight", own).withColumn(f"room{depth}", F.when(F.col("weight") > 0, usable).otherwise(0.0)).drop("weight")

    rooms = room(leaves, 2, F.col("tokens").cast("double") * max_epochs)
    family = room(rooms.groupBy("n0", "n1").agg(F.sum("room2").alias("_r")), 1, F.col("_r")).drop("_r")
    top = room(family.groupBy("n0").agg(F.sum("room1").alias("_r")), 0, F.col("_r")).drop("_r")
    total = leaves.agg(F.floor(F.sum(F.col("tokens").cast("double")) * share).cast("double")).first()[0] or 0.0
    given = top.withColumn("budget", F.lit(float(total)))
    for depth, (nodes, room) in enumerate(((top, "room0"), (family, "room1"), (rooms, "room2"))):
        if depth:
            above = given.select(*(F.col(k).alias(f"_{k}") for k in keys[:depth]), F.col("given").alias("budget"))
            match = None
            for k in keys[:depth]:
                same = F.col(k).eqNullSafe(F.col(f"_{k}"))
                match = same if match is None else match & same
            nodes = nodes.join(above, match).drop(*(f"_{k}" for k in keys[:depth]))
        else:
            nodes = given
        nodes = nodes.withColumn("weight", F.coalesce(weight.get(depth, F.lit(1.0)), F.lit(1.0)).cast("double"))
        nodes = nodes.withColumn("room", F.col(room)).withColumn("name", F.col(keys[depth]))
        given = _by_weight(nodes, keys[:depth], "budget").drop("weight", "room", "name", "budget")
        if depth < 2:
            given = given.drop(room)
    return given.select(*keys, "tokens", F.floor("given").cast("long").alias("budget"))


def _same(a: str, b: str, keys=("n0", "n1", "n2")) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return match


def _within(placed: DataFrame, crossed: DataFrame) -> DataFrame:
    """Rows of ``placed`` in the slice of their leaf, with ``before``: the tokens of the slices before it."""
    same = _same("d", "c") & F.startswith(F.col("d.place"), F.col("c.slice"))
    return placed.alias("d").join(crossed.alias("c"), same).select("d.*", "c.before")


def selection(narrow: DataFrame, weight: dict[int, Column], share: float, max_epochs: int, seed: int, ws: Workspace) -> DataFrame:
    """For every leaf ``(n0, n1, n2, epochs, last)``: whole epochs, and the last place taken in one more.

    ``narrow`` has ``doc_id, n0, n1, n2, tokens``.
    """
    leaves = ws.save(narrow.groupBy("n0", "n1", "n2").agg(F.sum("tokens").alias("tokens")), "leaves")
    plan = leaf_budgets(leaves, weight, share, max_epochs).where("tokens > 0")
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = ws.save(plan, "plan")
    keys = ["n0", "n1", "n2"]
    placed = narrow.alias("d").join(plan.select(*keys, "epochs", "rest").alias("p"), _same("d", "p")).select(*(f"d.{k}" for k in keys), "d.tokens", "p.rest", place(seed, F.col("p.epochs"), F.col("d.doc_id")).alias("place"))
    crossed = plan.select(*keys, F.lit("").alias("slice"), F.lit(0).cast("long").alias("before"))
    for done in range(ROUNDS):
        # each leaf's budget ends in a slice, since it is less than one epoch
        here = _within(placed, crossed).groupBy(*keys, F.substring("place", 1, DIGITS * (done + 1)).alias("slice")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = F.col("start") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        ended = here.withColumn("upto", upto).where("upto > rest").groupBy(*keys).agg(F.min("slice").alias("slice"), F.min_by(F.col("upto") - F.col("tokens"), "slice").alias("before"))
        crossed = ws.save(ended, f"crossed{done}")
    inside = _within(placed, crossed)
    sofar = F.col("before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("sofar", sofar).where("sofar <= rest").groupBy(*keys).agg(F.max("place").alias("place"))
    out = plan.alias("p").join(crossed.alias("c"), _same("p", "c"), "left").join(taken.alias("t"), _same("p", "t"), "left")
    return ws.save(out.select(*(f"p.{k}" for k in keys), "p.epochs", F.coalesce("t.place", "c.slice").alias("last")), "selection")


def mix(documents: DataFrame, levels: list[Column], weight: dict[int, Column], ws: Workspace, share: float = SHARE, max_epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mixture, once for every epoch that takes them, with ``_epoch`` and the levels as ``_n0.._n2``."""
    named = [c.cast("string").alias(f"n{i}") for i, c in enumerate(levels)]
    narrow = ws.save(documents.select(F.col(id_col).alias("doc_id"), *named, token_count(F.col(text_col)).alias("tokens")), "narrow")
    chosen = selection(narrow, weight, share, max_epochs, seed, ws)
    name = {c: fresh(documents.columns, f"_{c}") for c in chosen.columns}
    chosen = chosen.select(*(F.col(c).alias(n) for c, n in name.items()))
    match = F.lit(True)
    for i, c in enumerate(levels):
        match = match & c.cast("string").eqNullSafe(F.col(name[f"n{i}"]))
    # one row for each leaf on the right
    last = F.when(place(seed, F.col(name["epochs"]), F.col(id_col)) <= F.col(name["last"]), 1).otherwise(0)
    copies = fresh([*documents.columns, *name.values()], "_copies")
    joined = documents.join(chosen, match).withColumn(copies, F.col(name["epochs"]) + last).where(F.col(copies) > 0)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))
    added = {"_epoch": epochs} | {f"_n{i}": F.col(name[f"n{i}"]) for i in range(3)}
    return joined.select(*(F.col(f"`{c}`") for c in documents.columns if c not in added), *(e.alias(c) for c, e in added.items()))


def default_levels(source: str = "source", lang: str = "lang") -> list[Column]:
    """Domain, language and source; the domain is the source's number modulo 4."""
    number = F.coalesce(F.regexp_extract(F.col(source), "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return [F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), F.col(lang), F.col(source)]


def _lookup(weights: dict[str, float], name: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col(name)]


def default_weights() -> dict[int, Column]:
    return {0: _lookup(WEIGHTS, "n0"), 1: _lookup(LANGUAGE_WEIGHTS, "n1")}


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The mixture at 60 % of the corpus' tokens and up to three epochs: ``doc_id, domain, language, source, epoch, tokens``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(documents.select("doc_id", "text", "lang", "source"), default_levels(), default_weights(), Workspace(spark, "mixing"), max_epochs=3)
    return mixed.select("doc_id", F.col("_n0").alias("domain"), F.col("_n1").alias("language"), F.col("_n2").alias("source"), F.col("_epoch").alias("epoch"), token_count(F.col("text")).alias("tokens"))


OP4_SQL = r"""
WITH narrow AS (
  SELECT doc_id, lang AS n1, source AS n2,
         'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4)::VARCHAR AS n0,
         coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')), 0)::BIGINT AS tokens
  FROM documents),
rooms AS (SELECT n0, n1, n2, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * 3 AS room FROM narrow GROUP BY ALL),
family AS (SELECT n0, n1, sum(room) AS room FROM rooms GROUP BY ALL),
top AS (SELECT n0, sum(room) AS room FROM family GROUP BY ALL),
nodes0 AS (SELECT n0, room, CASE WHEN n0 = 'domain0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                  (SELECT floor(sum(tokens)::DOUBLE * 0.6::DOUBLE) FROM rooms) AS budget FROM top),
a0 AS (SELECT *, coalesce(sum(room) OVER (ORDER BY room / weight, n0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(weight) OVER (ORDER BY room / weight, n0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM nodes0),
b0 AS (SELECT *, before + room / weight * weight_on <= budget AS is_full FROM a0),
c0 AS (SELECT *, first_value(CASE WHEN NOT is_full THEN (budget - before) / weight_on END IGNORE NULLS)
              OVER (ORDER BY room / weight, n0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM b0),
g0 AS (SELECT n0, CASE WHEN is_full THEN room ELSE weight * lv END AS given FROM c0),
nodes1 AS (SELECT f.n0, f.n1, f.room, CASE WHEN f.n1 = 'en' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, g0.given AS budget
           FROM family f JOIN g0 ON f.n0 IS NOT DISTINCT FROM g0.n0),
a1 AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY n0 ORDER BY room / weight, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(weight) OVER (PARTITION BY n0 ORDER BY room / weight, n1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM nodes1),
b1 AS (SELECT *, before + room / weight * weight_on <= budget AS is_full FROM a1),
c1 AS (SELECT *, first_value(CASE WHEN NOT is_full THEN (budget - before) / weight_on END IGNORE NULLS)
              OVER (PARTITION BY n0 ORDER BY room / weight, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM b1),
g1 AS (SELECT n0, n1, CASE WHEN is_full THEN room ELSE weight * lv END AS given FROM c1),
nodes2 AS (SELECT r.n0, r.n1, r.n2, r.tokens, r.room, 1.0::DOUBLE AS weight, g1.given AS budget
           FROM rooms r JOIN g1 ON r.n0 IS NOT DISTINCT FROM g1.n0 AND r.n1 IS NOT DISTINCT FROM g1.n1),
a2 AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY n0, n1 ORDER BY room / weight, n2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(weight) OVER (PARTITION BY n0, n1 ORDER BY room / weight, n2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM nodes2),
b2 AS (SELECT *, before + room / weight * weight_on <= budget AS is_full FROM a2),
c2 AS (SELECT *, first_value(CASE WHEN NOT is_full THEN (budget - before) / weight_on END IGNORE NULLS)
              OVER (PARTITION BY n0, n1 ORDER BY room / weight, n2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM b2),
plan AS (SELECT n0, n1, n2, tokens AS supply, floor(CASE WHEN is_full THEN room ELSE weight * lv END)::BIGINT AS budget FROM c2 WHERE tokens > 0),
placed AS (SELECT d.*, p.budget // p.supply AS epochs, p.budget - (p.budget // p.supply) * p.supply AS rest,
                  md5('11:' || (p.budget // p.supply)::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, 'null')) AS place
           FROM narrow d JOIN plan p ON d.n0 IS NOT DISTINCT FROM p.n0 AND d.n1 IS NOT DISTINCT FROM p.n1 AND d.n2 IS NOT DISTINCT FROM p.n2),
sums AS (SELECT *, sum(tokens) OVER (PARTITION BY n0, n1, n2 ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar FROM placed),
copies AS (SELECT *, epochs + CASE WHEN sofar <= rest THEN 1 ELSE 0 END AS n FROM sums)
SELECT doc_id, n0 AS domain, n1 AS language, n2 AS source, unnest(range(0, n))::BIGINT AS epoch, tokens FROM copies WHERE n > 0
"""
