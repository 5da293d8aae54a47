"""Mixing sources to target weights by hierarchical budgeting.

A tree (domain, language, source by default) has integer weights on its nodes.
The budget of tokens runs from the root down: a node shares its budget among its
children by weight, but none gets more than the tokens below it can supply in
``max_epochs`` epochs. What a child cannot take goes to its siblings by weight
(water filling); only what all siblings cannot take is missing at their
parent, whose smaller supply its own siblings make up for in the same way. Since
supplies are summed from the leaves first, one pass down does it. Shares are
rounded down to whole tokens: fewer than one token a node stays unspent.

A leaf with a budget of k whole epochs and a rest takes all its documents k
times and, in the epoch after, the prefix of ``rest`` tokens in the order of
md5("seed:epoch:doc_id"). The prefix ends inside a document, which gives its
first tokens. Tokens are words.

All of it is DataFrame expressions. Prefix sums run over 4,096 ranges of
the hash a leaf; only the range where the prefix ends is sorted, so a leaf with a
third of all rows is never in one task. Each leaf's end (one row a leaf) is
joined to the documents, which decide for themselves: texts are not shuffled
unless the leaves outgrow Spark's own broadcast threshold.

Defined cases
    null text            no tokens
    null node            a node named by the empty text
    null doc_id          hashed as the empty text
    weight of 0, missing weight   never chosen; 1
    very long text       counted whole; its first tokens where a prefix ends in it
    empty texts          go with whole epochs and with prefixes that pass them
    leaf without tokens  nothing is chosen from it
    repeated rows        each counts; rows of one id share a place in the order,
                         and where the prefix ends in them each gives its first tokens
    budget above supply  everything, ``max_epochs`` times
    empty table          empty result
    clashing columns     internal columns are structs named ``__m*``; epoch,
                         tokens and take of the input are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosight.llm.common import WS, cut

SPLIT = 3  # hexadecimal digits of the hash: 4,096 ranges a leaf


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS}]+")).cast("bigint")


def _order(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(doc.cast("string"), F.lit(""))))


def _weight(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("bigint")
    for value, w in weights.items():
        out = F.when(level == value, F.lit(int(w)).cast("bigint")).otherwise(out)
    return out


def share(children: DataFrame, parent_keys: list[str], own_key: str) -> DataFrame:
    """Water filling. ``children``: keys, weight, supply and their parent's
    budget. Returns each child's budget."""
    c = children.where("weight > 0")
    up = Window.partitionBy(*parent_keys).orderBy(F.col("supply") / F.col("weight"), own_key)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.select("*", F.coalesce(F.sum("supply").over(before), F.lit(0)).alias("supply_before"),
                 F.sum("weight").over(onward).alias("weight_onward"))
    c = c.withColumn("full", F.expr("supply * weight_onward <= weight * (budget - supply_before)"))
    whole = Window.partitionBy(*parent_keys)
    c = c.select("*", F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(whole).alias("spent"),
                 F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole).alias("open_weight"))
    return c.select(*parent_keys, own_key, "supply", F.when(F.col("full"), F.col("supply")).otherwise(
        F.expr("(weight * (budget - spent)) div greatest(open_weight, 1)")).alias("budget"))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int,
            max_epochs: int) -> DataFrame:
    """``leaves``: level columns and tokens. Returns them with each leaf's budget."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    alloc = None
    for depth in range(len(levels)):
        keys = levels[:depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(F.col(keys[-1]), weights.get(keys[-1], {})))
        if alloc is None:  # the root's children
            nodes = nodes.select("*", F.lit(0).alias("root"), F.lit(budget).cast("bigint").alias("budget"))
            alloc = share(nodes, ["root"], keys[-1]).drop("root", "supply")
        else:
            alloc = share(nodes.join(alloc, keys[:-1]), keys[:-1], keys[-1]).drop("supply")
    return leaves.drop("supply").join(alloc, levels)


def mix(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]],
        budget_share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chosen document and epoch: the input's columns, then epoch,
    tokens (of the document) and take (its first tokens that are chosen; all but
    at the end of a prefix). The budget is ``budget_share`` of all tokens."""
    names = list(levels)
    node = [F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()]
    small = cut(df.select(F.col(id_col).cast("bigint").alias("id"), *node,
                          tokens(F.col(text_col)).alias("tokens")), "mix-documents")
    leaves = cut(small.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = total * budget_share[0] // budget_share[1]
    plan = cut(budgets(leaves, names, weights, budget, max_epochs)
               .where("tokens > 0").select(*names, F.expr("budget div tokens").alias("epochs"),
                                           F.expr("budget % tokens").alias("rest")), "mix-budgets")
    # where each leaf's prefix ends
    partial = small.join(plan.where("rest > 0"), names)
    order = _order(seed, F.col("epochs"), F.col("id"))
    partial = partial.select(*names, "id", "tokens", "rest", order.alias("h"))
    ranges = partial.groupBy(*names, F.substring("h", 1, SPLIT).alias("r")).agg(
        F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*names).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    last = cut(ranges.where("before < rest and before + n >= rest").select(*names, "r", "before"), "mix-ranges")
    inside = partial.withColumn("r", F.substring("h", 1, SPLIT)).join(last, [*names, "r"])
    inside = inside.groupBy(*names, "h", "id").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"),
                                                   F.first("before").alias("before"))
    ahead = Window.partitionBy(*names).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select("*", (F.col("before") + F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).alias("at"))
    ends = inside.where("at < rest and at + tokens >= rest").select(
        *names, F.col("h").alias("end_h"), (F.col("rest") - F.col("at")).alias("end_take"))
    site = F.struct(*names).alias("__msite")
    plan = cut(plan.join(ends, names, "left").select(site, F.struct("epochs", "end_h", "end_take").alias("__mplan")),
               "mix-plan")
    # each document decides by its leaf's row
    own = [c for c in df.columns if c not in ("epoch", "tokens", "take")]
    docs = df.select(*own, F.struct(*node).alias("__msite"), F.struct(
        tokens(F.col(text_col)).alias("n"), F.col(id_col).cast("bigint").alias("id")).alias("__mdoc"))
    docs = docs.join(plan, "__msite")
    p, d = F.col("__mplan"), F.col("__mdoc")
    h = _order(seed, p["epochs"], d["id"])
    rest = (F.when(p["end_h"].isNull() | (h > p["end_h"]), F.lit(None))
            .when(h == p["end_h"], F.least(d["n"], p["end_take"])).otherwise(d["n"]))
    docs = docs.select(*own, F.struct(d["n"].alias("n"), p["epochs"].alias("epochs"), rest.alias("rest")).alias("__mdoc"))
    times = d["epochs"] + F.when(d["rest"].isNull(), 0).otherwise(1)
    docs = docs.where(times > 0).select(
        *own, F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)).alias("epoch"), "__mdoc")
    return docs.select(*own, "epoch", d["n"].alias("tokens"),
                       F.when(F.col("epoch") < d["epochs"], d["n"]).otherwise(d["rest"]).alias("take"))


def prefix(text: Column, n: Column) -> Column:
    """The first ``n`` words, one space between them."""
    words = F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
