"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain / language / source. A node can give as many tokens as its leaves hold, times the
number of epochs. The token budget flows from the root down: siblings share their parent's budget by
weight, what a node cannot use goes to its siblings by their weights, and only what a whole family
cannot use has already gone to the family's own siblings one level up. Each leaf then yields the
prefix of its documents, in seeded order epoch after epoch, that its budget covers.

Weights are whole numbers; tokens times weight must stay below 2**63.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, utf8_size

DOMAINS = ("web", "books", "forums", "reference")
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "forums": 20, "reference": 10}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
OTHER_WEIGHT = 5
SOURCE_WEIGHT = 1
BUDGET_PERCENT = 60
EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of the order key that split the running token count of one leaf over many tasks.
SPLIT_DIGITS = 3

LEVELS = ("domain", "language", "leaf_source")


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four bytes each, rounded up; none for a null text."""
    return F.shiftright(utf8_size(text) + 3, 2)


def domain_of(source: Column) -> Column:
    """The domain of a source by its number; sources without one are forums' siblings under 'other'."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int")), F.lit("other"))


def _weight(weights: dict[str, int], key: str, other: int) -> Column:
    return reduce(lambda c, kv: c.when(F.col(key) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(other).cast("long")


def pour(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share each parent's budget (column budget) among its children by weight within their cap: adds share.

    Children in order of cap / weight are full as long as their part of what is left covers their cap;
    the others divide the rest exactly (cumulative rounding, so that shares add up to the budget).
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    name = F.col(LEVELS[len(parent)])
    fullness = family.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    ordered = (
        nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(fullness), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(fullness), F.lit(0)))
        .withColumn("full", F.expr("(budget - cap_before) * weight >= cap * weight_left"))
        .withColumn("rest", F.col("budget") - F.sum(F.expr("if(full, cap, 0L)")).over(family))
        .withColumn("open_weight", F.sum(F.expr("if(full, 0L, weight)")).over(family))
        .withColumn("open_before", F.coalesce(F.sum(F.expr("if(full, 0L, weight)")).over(family.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    share = F.expr("if(full, cap, rest * (open_before + weight) div open_weight - rest * open_before div open_weight)")
    return ordered.withColumn("share", share).drop("cap_before", "weight_left", "full", "rest", "open_weight", "open_before")


def leaf_budgets(
    leaves: DataFrame,
    *,
    budget_percent: int = BUDGET_PERCENT,
    epochs: int = EPOCHS,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    language_weights: dict[str, int] = LANGUAGE_WEIGHTS,
    source_weight: Column | int = SOURCE_WEIGHT,
) -> DataFrame:
    """Budget of every leaf. leaves: domain, language, leaf_source, held (tokens). Empty leaves get nothing."""
    held = leaves.where("held > 0").withColumn("cap", F.col("held") * epochs)
    domains = (
        held.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("held").alias("held"))
        .withColumn("weight", _weight(domain_weights, "domain", OTHER_WEIGHT))
        .withColumn("total", F.sum("held").over(Window.partitionBy(F.lit(0))))
        .withColumn("budget", F.expr(f"total * {int(budget_percent)} div 100"))
    )
    domains = pour(domains, []).select("domain", F.col("share").alias("budget"))
    languages = (
        held.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
        .withColumn("weight", _weight(language_weights, "language", OTHER_WEIGHT)).join(domains, "domain")
    )
    languages = pour(languages, ["domain"]).select("domain", "language", F.col("share").alias("budget"))
    weight = source_weight if isinstance(source_weight, Column) else F.lit(source_weight)
    sources = held.withColumn("weight", weight.cast("long")).join(languages, ["domain", "language"])
    return pour(sources, ["domain", "language"]).select(*LEVELS, "held", F.col("share").alias("budget"))


def _keyed(docs: DataFrame, seed: str, epoch: Column, tokens: Column | None) -> list[Column]:
    source, lang = F.col("source"), F.col("lang")
    key = F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))).cast("binary"))
    return [
        domain_of(source).alias("domain"), F.coalesce(lang, F.lit("")).alias("language"), F.coalesce(source, F.lit("")).alias("leaf_source"),
        (token_estimate(F.col("text")) if tokens is None else tokens.cast("long")).alias("tokens"), key.alias("order_key"),
    ]


def select_prefixes(docs: DataFrame, *, epochs: int = EPOCHS, seed: str = SEED, tokens: Column | None = None, **weights) -> DataFrame:
    """The mixed epochs: doc_id, domain, language, leaf_source, epoch, tokens, order_key, end_token, budget.

    end_token is the leaf's running token count over all epochs; a row is chosen if it is within the
    budget. Rows of one id stand or fall together, and so do rows without an id that have the same text; null languages and sources count as ''; empty texts
    have no tokens and come with the prefix they lie in; an empty table gives no rows.
    """
    leaf = list(LEVELS)
    passes = docs.select("doc_id", "text", "lang", "source", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    rows = passes.select("doc_id", "epoch", *_keyed(passes, seed, F.col("epoch"), tokens))
    held = docs.select(*_keyed(docs, seed, F.lit(0), tokens)).groupBy(*leaf).agg(F.sum("tokens").alias("held"))
    # written, so that Spark knows the size of the leaf table and broadcasts it only when it is small
    budgets = materialize(leaf_budgets(held, epochs=epochs, **weights), "leaf-budgets")
    wanted = rows.join(budgets, leaf).where("epoch * held < budget").withColumn("part", F.substring("order_key", 1, SPLIT_DIGITS))
    parts = wanted.groupBy(*leaf, "epoch", "part").agg(F.sum("tokens").alias("part_tokens"))
    ahead = Window.partitionBy(*leaf, "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0))).drop("part_tokens")
    within = Window.partitionBy(*leaf, "epoch", "part").orderBy("order_key")
    running = wanted.withColumn("within", F.sum("tokens").over(within)).join(parts, [*leaf, "epoch", "part"])
    ended = running.withColumn("end_token", F.expr("epoch * held + ahead + within"))
    return ended.where("end_token <= budget").select("doc_id", *leaf, "epoch", "tokens", "order_key", "end_token", "budget")


def mix_documents(docs: DataFrame, *, seed: str = SEED, **weights) -> DataFrame:
    """The documents of one mixed epoch, with their own columns: each leaf is cut at its last chosen order key."""
    chosen = select_prefixes(docs.select("doc_id", "text", "lang", "source"), epochs=1, seed=seed, **weights)
    cuts = materialize(chosen.groupBy(*LEVELS).agg(F.max("order_key").alias("_cut")), "leaf-cuts")
    cuts = cuts.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "_cut")
    keyed = docs.select(F.struct("*").alias("_row"), *[c.alias(f"_{n}") for c, n in zip(_keyed(docs, seed, F.lit(0), None), (*LEVELS, "tokens", "order_key"), strict=True)])
    kept = keyed.join(cuts, [f"_{c}" for c in LEVELS]).where("_order_key <= _cut")
    return kept.select("_row.*")


def mixed_sql(epochs: int = EPOCHS, budget_percent: int = BUDGET_PERCENT, seed: str = SEED) -> str:
    """The same selection in DuckDB SQL."""

    def case(weights: dict[str, int], key: str) -> str:
        return "case " + " ".join(f"when {key} = '{k}' then {v}" for k, v in weights.items()) + f" else {OTHER_WEIGHT} end::bigint"

    def poured(name: str, nodes: str, parent: str, own: str) -> str:
        by = f"partition by {parent}" if parent else ""
        before = "rows between unbounded preceding and 1 preceding"
        return f"""{name}_a as (select *, coalesce(sum(cap) over ({by} order by cap / weight, {own} {before}), 0)::bigint cap_before,
            (sum(weight) over ({by}) - coalesce(sum(weight) over ({by} order by cap / weight, {own} {before}), 0))::bigint weight_left from ({nodes})),
        {name}_b as (select *, (budget - cap_before) * weight >= cap * weight_left as is_full from {name}_a),
        {name}_c as (select *, (budget - sum(case when is_full then cap else 0 end) over ({by}))::bigint rest,
            (sum(case when is_full then 0 else weight end) over ({by}))::bigint open_weight,
            coalesce(sum(case when is_full then 0 else weight end) over ({by} order by {own} {before}), 0)::bigint open_before from {name}_b),
        {name} as (select *, case when is_full then cap else rest * (open_before + weight) // open_weight - rest * open_before // open_weight end as share from {name}_c)"""

    number = "try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as bigint)"
    domain = "coalesce(case " + " ".join(f"when {number} % {len(DOMAINS)} = {i} then '{d}'" for i, d in enumerate(DOMAINS)) + " end, 'other')"
    return f"""with d as (select doc_id, {domain} as domain, coalesce(lang, '') as language, coalesce(source, '') as leaf_source,
            ((coalesce(octet_length(encode(text)), 0) + 3) // 4)::bigint as tokens, case when doc_id is null then md5(coalesce(text, '')) end as text_key from documents),
        held as (select domain, language, leaf_source, sum(tokens)::bigint held, sum(tokens)::bigint * {epochs} cap from d group by all having sum(tokens) > 0),
        {poured("dom", f"select domain, sum(cap)::bigint cap, {case(DOMAIN_WEIGHTS, 'domain')} weight, ((select sum(held) from held) * {budget_percent} // 100)::bigint budget from held group by domain", "", "domain")},
        {poured("lng", f"select h.domain, h.language, sum(h.cap)::bigint cap, {case(LANGUAGE_WEIGHTS, 'h.language')} weight, any_value(dom.share) budget from held h join dom using (domain) group by h.domain, h.language", "domain", "language")},
        {poured("src", f"select h.*, {SOURCE_WEIGHT}::bigint weight, lng.share budget from held h join lng using (domain, language)", "domain, language", "leaf_source")},
        p as (select d.*, e.epoch::int as epoch, md5('{seed}|' || e.epoch || '|' || coalesce(doc_id::varchar, text_key)) as order_key from d, range({epochs}) e(epoch)),
        r as (select p.*, src.share as budget, p.epoch * src.held + sum(p.tokens) over (partition by p.domain, p.language, p.leaf_source, p.epoch order by p.order_key) as end_token
            from p join src using (domain, language, leaf_source))
        select doc_id, domain, language, leaf_source, epoch, tokens, order_key, end_token::bigint as end_token, budget::bigint as budget from r where end_token <= budget"""
