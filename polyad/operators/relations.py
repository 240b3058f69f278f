"""Relations between actors: requests, replies, validation, and linking to nodes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import canonical_polarity, normalize, period, python_strip, strip_fence
from polyad.schema import ACT_TYPES, POLARITIES, UNSIGNED_ACTS
from polyad.sources.scratch import materialize

RELATION = "struct<from_entity:string,to_entity:string,act_type:string,polarity:string,issue:string,evidence_quote:string>"
# The parts of a request around the article and its actors. Replies and stored request files go by them.
PROMPT = ("ARTÍCULO:\n", "\n\nACTORES PRESENTES: ", "\n\nExtraé las relaciones políticas explícitas entre estos actores según las instrucciones del sistema. Devolvé SOLO el JSON, sin markdown.")


def prompts(articles: DataFrame, actors: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(key, prompt) for the articles with enough actors (article_id, actors)."""
    a, b, c = map(F.lit, PROMPT)
    return articles.join(actors, "article_id").select(F.col("article_id").alias("key"), F.concat(a, F.substring("body", 1, max_chars), b, F.array_join("actors", ", "), c).alias("prompt"))


def cost_estimate(articles: DataFrame, actors: DataFrame, system_chars: int, price_in: float, price_out: float, max_chars: int = 6000, out_tokens: int = 600) -> DataFrame:
    """One row (items, in_tokens, out_tokens, cost); four characters make a token, prices are per million."""
    size = F.lit(system_chars) + F.length(F.substring("body", 1, max_chars)) + F.length(F.array_join("actors", ", "))
    sums = articles.join(actors, "article_id").agg(F.count(F.lit(1)).alias("items"), (F.coalesce(F.sum(size), F.lit(0)) / 4).alias("in_tokens"))
    return sums.withColumn("out_tokens", F.col("items") * out_tokens).withColumn("cost", F.col("in_tokens") / 1e6 * price_in + F.col("out_tokens") / 1e6 * price_out)


def extract_with(requests: DataFrame, model: Callable) -> DataFrame:
    """(key, prompt) to replies (article_id, text) by a model: it maps an iterator of pandas frames (key, prompt) to frames (article_id, text)."""
    return requests.mapInPandas(model, "article_id string, text string")


def explode_replies(replies: DataFrame) -> DataFrame:
    """(article_id, text) to one row per relation with its place ``ord``; what isn't JSON gives none."""
    got = F.from_json(strip_fence(F.col("text")), f"struct<relations:array<{RELATION}>>")
    return replies.select("article_id", F.posexplode(got["relations"]).alias("ord", "r")).select("article_id", "ord", "r.*")


def evidence_gate(rows: DataFrame, bodies: DataFrame, min_len: int = 8) -> DataFrame:
    """Adds ``passed``: the quote, without white space around it, is long enough and stands in the article's body."""
    quote = python_strip(F.coalesce("evidence_quote", F.lit("")))
    return (
        rows.join(bodies.select("article_id", F.col("body").alias("__body")), "article_id", "left")
        .withColumn("passed", (F.length(quote) >= min_len) & F.contains(F.coalesce("__body", F.lit("")), quote))
        .drop("__body")
    )


@dataclass
class Rules:
    """Which rules a relation has to pass."""

    require_evidence: bool = True
    min_quote_len: int = 8
    normalize_passive: bool = True
    dedup: bool = True
    act_types: tuple[str, ...] = ACT_TYPES
    max_per_article: int | None = 10
    min_confidence: float | None = None
    both_in_quote: bool = False
    consistent_polarity: bool = False
    require_actors_in_text: bool = False
    #: Acts whose polarity can't be the opposite one.
    polarity_of: dict[str, str] = field(default_factory=lambda: {"endorses": "positive", "allies_with": "positive", "attacks": "negative", "accuses": "negative", "distances_from": "negative", "questions": "negative"})


def rules_from_json(text: str) -> Rules:
    """Rules from the ``validation`` part of a prompt's JSON file, or from that part alone; what it doesn't name keeps its default."""
    spec = json.loads(text)
    spec = spec.get("validation", spec)
    names = {
        "require_evidence_substring": "require_evidence",
        "min_quote_len": "min_quote_len",
        "normalize_passive_direction": "normalize_passive",
        "dedup": "dedup",
        "allowed_act_types": "act_types",
        "max_relations_per_article": "max_per_article",
        "require_both_in_quote": "both_in_quote",
        "enforce_polarity_consistency": "consistent_polarity",
        "require_actors_in_text": "require_actors_in_text",
        "min_confidence": "min_confidence",
    }
    return Rules(**{names[k]: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k in names})


def turn_passive(rows: DataFrame) -> DataFrame:
    """Swaps the ends where the quote says that the first ``fue`` or ``es`` something ``por`` the second."""
    a, b = F.col("from_entity"), F.col("to_entity")
    last = lambda c: F.lower(F.substring_index(F.trim(c), " ", -1))
    quote = F.lower(F.coalesce("evidence_quote", F.lit("")))
    head, tail = F.substring_index(quote, " por ", 1), F.substring_index(quote, " por ", -1)
    passive = quote.contains(" por ") & head.rlike(r"\b(fue|fueron|es|son|ser|sido)\b") & head.contains(last(a)) & tail.contains(last(b)) & ~tail.contains(last(a))
    return rows.select(*[c for c in rows.columns if c not in ("from_entity", "to_entity")], F.when(passive, b).otherwise(a).alias("from_entity"), F.when(passive, a).otherwise(b).alias("to_entity"), F.coalesce(passive, F.lit(False)).alias("turned"))


def first_broken(body: Column, rules: Rules) -> Column:
    """The first rule that a relation breaks, null if none."""
    quote = python_strip(F.coalesce("evidence_quote", F.lit("")))
    a, b = F.col("from_entity"), F.col("to_entity")
    missing = a.isNull() | b.isNull() | F.col("act_type").isNull() | F.col("polarity").isNull()
    broken = F.when(missing, "missing_fields").when(~F.col("act_type").isin(*rules.act_types), "invalid_act_type").when(~F.col("polarity").isin(*POLARITIES), "invalid_polarity").when(a == b, "self_loop")
    if rules.require_evidence:
        broken = broken.when(~F.contains(F.coalesce(body, F.lit("")), quote), "quote_not_in_body")
    broken = broken.when(F.length(quote) < rules.min_quote_len, "quote_too_short")
    if rules.both_in_quote:
        broken = broken.when(~(F.contains(quote, a) & F.contains(quote, b)), "actor_not_in_quote")
    if rules.require_actors_in_text:
        broken = broken.when(~(F.contains(body, a) & F.contains(body, b)), "actor_not_in_text")
    if rules.consistent_polarity:
        for act, polarity in rules.polarity_of.items():
            other = "negative" if polarity == "positive" else "positive"
            broken = broken.when((F.col("act_type") == act) & (F.col("polarity") == other), "inconsistent_polarity")
    if rules.min_confidence is not None:
        broken = broken.when(F.coalesce("confidence", F.lit(0.0)) < rules.min_confidence, "low_confidence")
    return broken


def validate(rows: DataFrame, bodies: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Adds ``rejected``: the first rule a relation breaks, null where it passes. ``rows`` has article_id and ord.

    Repeats (same article, ends, act and polarity) after the first and what goes beyond the article's limit are rejected last.
    """
    rules = rules or Rules()
    if rules.normalize_passive:
        rows = turn_passive(rows).drop("turned")
    joined = rows.join(bodies.select("article_id", F.col("body").alias("__body")), "article_id", "left")
    out = joined.withColumn("rejected", first_broken(F.col("__body"), rules)).drop("__body")
    if rules.dedup:
        same = Window.partitionBy("article_id", F.col("rejected").isNull(), "from_entity", "to_entity", "act_type", "polarity").orderBy("ord")
        out = out.withColumn("__rn", F.row_number().over(same)).withColumn("rejected", F.coalesce("rejected", F.when(F.col("__rn") > 1, "duplicate"))).drop("__rn")
    if rules.max_per_article is not None:
        per = Window.partitionBy("article_id", F.col("rejected").isNull()).orderBy("ord")
        out = out.withColumn("__rn", F.row_number().over(per)).withColumn("rejected", F.coalesce("rejected", F.when(F.col("__rn") > rules.max_per_article, "over_limit"))).drop("__rn")
    return out


def waterfall(validated: DataFrame) -> DataFrame:
    """(rule, n): how many relations each rule rejects, and how many pass."""
    return validated.groupBy(F.coalesce("rejected", F.lit("passed")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def canonical_polarities(rows: DataFrame) -> DataFrame:
    return rows.withColumn("polarity", canonical_polarity(F.col("polarity")))


def signed_acts(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """Without acts that have no polarity; null acts stay."""
    return rows if keep_all else rows.filter(~F.col("act_type").isin(*UNSIGNED_ACTS) | F.col("act_type").isNull())


def alias_dictionary(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(form, node_id): one node per normalised form; aliases go before canonical names, then the smaller id."""
    forms = aliases.select(F.col("surface_norm").alias("form"), "node_id", F.lit(0).alias("prio")).unionByName(nodes.select(normalize(F.col("canonical")).alias("form"), "node_id", F.lit(1).alias("prio")))
    return forms.filter("form IS NOT NULL AND form <> ''").groupBy("form").agg(F.min_by("node_id", F.struct("prio", "node_id")).alias("node_id"))


def link(rows: DataFrame, dictionary: DataFrame, articles: DataFrame, any_polarity: bool = False) -> DataFrame:
    """Adds from_node_id, to_node_id, publish_date and ``outcome``: linked, unknown_article, unresolved or self_loop.

    The dictionary is written first, so that the joins read a plain table and hot names can be split; rows without a name
    would all meet in one place, so they get keys of their own, which the dictionary hasn't. A polarity outside the
    vocabulary or no act leaves a relation unresolved, the polarity not with ``any_polarity``.
    """
    known = articles.select("article_id", "publish_date", F.lit(True).alias("__known"))
    words = materialize(dictionary.select("form", "node_id"), "dictionary")
    ends = [words.select(F.col("form").alias(f"__{k}"), F.col("node_id").alias(f"{k}_node_id")) for k in ("from", "to")]
    none = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("article_id"), F.lit(1024)).cast("string"))
    names = {f"__{k}": F.coalesce(normalize(F.col(f"{k}_entity")), none) for k in ("from", "to")}
    out = rows.join(known, "article_id", "left").withColumns(names).join(ends[0], "__from", "left").join(ends[1], "__to", "left")
    valid = F.lit(True) if any_polarity else F.coalesce(F.col("polarity").isin(*POLARITIES), F.lit(False))
    outcome = (
        F.when(F.col("__known").isNull(), "unknown_article")
        .when(F.col("from_node_id").isNull() | F.col("to_node_id").isNull(), "unresolved")
        .when(F.col("from_node_id") == F.col("to_node_id"), "self_loop")
        .when(~valid | (F.coalesce("act_type", F.lit("")) == ""), "unresolved")
        .otherwise("linked")
    )
    return out.withColumn("outcome", outcome).drop("__from", "__to", "__known")


def link_rate(linked: DataFrame) -> DataFrame:
    """One row (n, unresolved, link_rate, strict_rate), in percent; the strict rate counts linked relations only."""
    n = F.count(F.lit(1))
    return linked.agg(n.alias("n"), F.count_if(F.col("outcome") == "unresolved").alias("unresolved"), (100.0 * (n - F.count_if(F.col("outcome") == "unresolved")) / F.greatest(n, F.lit(1))).alias("link_rate"), (100.0 * F.count_if(F.col("outcome") == "linked") / F.greatest(n, F.lit(1))).alias("strict_rate"))


def edges(linked: DataFrame, run_id: str, order: list[str], keys: tuple[str, ...] = ("from_node_id", "to_node_id", "article_id", "act_type")) -> DataFrame:
    """The linked relations as edges, the first by ``order`` of each key."""
    first = Window.partitionBy(*keys).orderBy(*order)
    kept = linked.filter("outcome = 'linked'").withColumn("__rn", F.row_number().over(first)).filter("__rn = 1")
    return kept.select("from_node_id", "to_node_id", "article_id", F.lit(run_id).alias("run_id"), "act_type", "polarity", "issue", "evidence_quote", F.lit(None).cast("double").alias("confidence"), "publish_date", period(F.col("publish_date")).alias("period"))


def resolve_mentions_to_nodes(mentions: DataFrame, assign: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions with the node of their surface, or else of their normalised form; others are left out."""
    by_form = mentions.withColumn("__form", normalize(F.col("text")))
    a, d = assign.select(F.col("surface").alias("text"), F.col("node_id").alias("__a")), dictionary.select(F.col("form").alias("__form"), F.col("node_id").alias("__d"))
    return by_form.join(a, "text", "left").join(d, "__form", "left").withColumn("node_id", F.coalesce("__a", "__d")).filter("node_id IS NOT NULL").drop("__a", "__d", "__form")
