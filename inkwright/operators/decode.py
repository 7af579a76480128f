"""Decoding: price the candidates, take the best reading given what came before, and classify each token.

Pools and channel prices don't depend on context, so they are made once for each distinct token. The
context is what was decoded before: a recurrence along the page. It is solved as a fixpoint: decode all
places at once with the last round's result as history, then again those whose history changed, until
nothing changes. Place i is final after at most i + 1 rounds, and a result that reproduces itself is the
left-to-right answer everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, is_nonword, match_case
from ..shared import packed, settled
from .candidates import candidate_pool
from .channel import Channel, log_channels
from .language import context_free, in_context, ratio_tables, surprisal
from .model import BOUNDARY, bigrams, char_ngrams, language_totals, unigrams


@dataclass(frozen=True)
class Thresholds:
    """The tunables' defaults."""

    low_confidence: float = 0.55
    settled_confidence: float = 0.86
    unsettled_bits: float = 9.0
    surprisal_bits: float | None = None
    substitute_nats: float = 1.0
    close_call_nats: float = 1.5
    prior_weight: float = 1.0
    max_candidates: int = 40


@dataclass(frozen=True)
class Models:
    confusion: DataFrame
    spans: DataFrame
    lexicon: DataFrame
    trigrams: DataFrame
    chars: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, confusion: DataFrame, spans: DataFrame, lexicon: DataFrame, trigrams: DataFrame) -> Models:
        chars = char_ngrams(lexicon)
        return cls(confusion, spans, lexicon, trigrams, chars, language_totals(unigrams(trigrams), chars))

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]) -> Models:
        """From the tables of a snapshot (``sources.sinks.TABLES``)."""
        spans = tables["confusion"].filter("kind = 'span'").select(F.col("a").alias("observed"), F.col("b").alias("truth"), "count")
        trigrams = tables["ngrams"].filter("n = 3").select("w2", "w1", "word", "count")
        settle = [tables["confusion"].filter("kind <> 'span'"), spans, tables["lexicon"], trigrams]
        return cls.of(*map(settled, settle))

    @property
    def unigrams(self) -> DataFrame:
        return unigrams(self.trigrams)

    @property
    def bigrams(self) -> DataFrame:
        return bigrams(self.trigrams)


def reprs(text: Column) -> Column:
    """A string in quotes as Python writes it: double ones if it holds single ones alone."""
    quote = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    body = F.when(text.contains("'") & text.contains('"'), F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)
    return F.concat(quote, body, quote)


def classify(confidence: Column, surprisal_bits: Column, margin: Column, substituted: Column, is_new: Column, observed: Column, best: Column, limits: Thresholds) -> Column:
    """Struct (tier, reason): the first rule that holds."""
    verdict = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), reason.alias("reason"))
    rule = F.when(confidence < limits.low_confidence, verdict("red", F.lit("low recognition confidence"))).when(substituted, verdict("amber", F.concat(F.lit("rescored from "), reprs(observed))))
    if limits.surprisal_bits is not None:
        rule = rule.when(surprisal_bits > limits.surprisal_bits, verdict("amber", F.lit("improbable in context")))
    rule = rule.when(is_new & (margin < limits.close_call_nats), verdict("amber", F.concat(F.lit("close call with "), reprs(best))))
    rule = rule.when((confidence < limits.settled_confidence) & (surprisal_bits > limits.unsettled_bits), verdict("amber", F.lit("unsettled recognition and weak context support")))
    return rule.otherwise(verdict("none", F.lit("")))


def fallback_tier(confidence: Column, threshold: float = 0.55) -> Column:
    """Without a language model: red or none, never amber."""
    return F.when(clamp(confidence) < threshold, "red").otherwise("none")


@dataclass(frozen=True)
class Prices:
    """What a decode looks up: priced candidates of each distinct token, and the shares of words in context."""

    candidates: DataFrame
    ratios: tuple[DataFrame, DataFrame]

    @classmethod
    def of(cls, tokens: DataFrame, models: Models, limits: Thresholds, cut: Callable[[DataFrame], DataFrame]) -> Prices:
        """``cut`` settles a table that every round reads."""
        channel = cut(priced_candidates(tokens, models, limits, cut))
        flat = context_free(channel.select(F.col("candidate").alias("word")), models.trigrams, models.chars, models.totals)
        candidates = channel.withColumnRenamed("candidate", "word").join(flat, "word")
        return cls(cut(candidates), tuple(map(cut, ratio_tables(models.trigrams))))


def priced_candidates(tokens: DataFrame, models: Models, limits: Thresholds, cut: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(token, alternatives, candidate, own, shift) for distinct readable tokens and what was offered for them.

    The provider's confidence prices what the provider read, as ``own``; the channel prices the rest by
    a ``shift`` from the token itself, which costs the same on both scales. A token's confidence changes
    no candidate and no shift, so ``channel_price`` adds it where the token is read: tokens that differ in
    confidence alone share their candidates.
    """
    distinct = cut(tokens.select("token", "alternatives").distinct())
    pool = cut(candidate_pool(distinct, models.lexicon, models.unigrams, models.confusion, models.spans, limits.max_candidates, cut))
    channel = Channel.of(models.confusion)
    lone = pool.select(F.col("token").alias("observed"), "candidate").distinct()
    costs = cut(log_channels(lone, channel))
    selves = costs.filter("observed = candidate").select("observed", F.col("log_channel").alias("self"))
    costs = costs.join(selves, "observed").select(F.col("observed").alias("token"), "candidate", (F.col("log_channel") - F.col("self")).alias("shift"))
    own = F.when(~F.col("is_self") & F.col("alt_confidence").isNotNull(), F.ln(F.greatest("alt_confidence", F.lit(1e-6))))
    return pool.join(costs, ["token", "candidate"]).select("token", "alternatives", "candidate", own.alias("own"), F.when(~F.col("is_self"), F.col("shift")).alias("shift"))


def channel_price(confidence: Column, own: Column, shift: Column) -> Column:
    """What reading a candidate costs; the token itself has neither a price of its own nor a shift."""
    anchor = F.ln(F.greatest(confidence, F.lit(1e-6)))
    return F.coalesce(own, F.when(shift.isNull(), anchor).otherwise(shift + anchor))


def decode_round(tokens: DataFrame, history: DataFrame, prices: Prices, limits: Thresholds, page: str) -> DataFrame:
    """One round: (page, idx, text, tier, ...) of the given readable tokens, given (page, idx, text) of the last."""
    before = lambda n, name: history.select(F.col(page), (F.col("idx") + n).alias("idx"), F.lower("text").alias(name))
    seen = tokens.join(before(1, "w1"), [page, "idx"], "left").join(before(2, "w2"), [page, "idx"], "left").fillna({"w1": BOUNDARY, "w2": BOUNDARY})
    options = seen.join(prices.candidates, ["token", "alternatives"]).withColumn("channel", channel_price(F.col("confidence"), F.col("own"), F.col("shift"))).drop("own", "shift")
    scored = in_context(options, prices.ratios).withColumn("score", F.col("channel") + limits.prior_weight * F.col("log_prob"))
    ranked = F.struct((-F.col("score")).alias("s"), F.col("word").alias("w"))
    own = F.col("word") == F.col("token")
    keep = [c for c in ("observed", "token", "confidence", "substitute_nats") if c in tokens.columns]
    least_gain = F.col("substitute_nats") if "substitute_nats" in keep else F.lit(limits.substitute_nats)
    best = scored.groupBy(page, "idx").agg(*[F.first(c).alias(c) for c in keep], F.slice(F.array_sort(F.collect_list(ranked)), 1, 4).alias("top"), F.max(F.when(own, F.col("score"))).alias("own"), F.max(F.when(own, F.col("log_prob"))).alias("own_log_prob"))
    first, second = F.col("top")[0], F.get("top", F.lit(1))
    score = -first["s"]
    is_new = first["w"] != F.col("token")
    gap = second["s"] - first["s"]
    substituted = is_new & (score - F.col("own") >= least_gain)
    bits = surprisal(F.col("own_log_prob"))
    verdict = classify(F.col("confidence"), bits, F.coalesce(gap, F.lit(math.inf)), substituted, is_new, F.col("observed"), first["w"], limits)
    return best.select(
        page, "idx", F.when(substituted, match_case(F.col("observed"), first["w"])).otherwise(F.col("observed")).alias("text"), F.col("observed").alias("original"), "confidence",
        verdict["tier"].alias("tier"), verdict["reason"].alias("reason"), bits.alias("surprisal"), F.coalesce(gap, F.lit(0.0)).alias("margin"), substituted.alias("substituted"),
        F.when(is_new & ~substituted, match_case(F.col("observed"), first["w"])).alias("suggestion"),
        F.transform("top", lambda c: F.struct(match_case(F.col("observed"), c["w"]).alias("text"), (-c["s"]).alias("score"))).alias("alternatives"),
    )


def decode(observed: DataFrame, models: Models, limits: Thresholds | None = None, *, page: str = "page_id", max_rounds: int = 50, checkpoint: bool = True) -> DataFrame:
    """Decode pages of tokens: (page, idx, observed, confidence, alternatives) in, one row a token out.

    A column ``substitute_nats``, if there is one, takes the place of the threshold of that name.
    ``idx`` counts from 0 without gaps; ``alternatives`` is an array of (text, confidence). The first
    round decodes all places, each later one only those whose two words before have changed, on the
    pages that have such places; a place's last result counts. Rounds are written to the session's
    checkpoint folder. A page that hasn't settled in ``max_rounds`` raises.
    """
    limits = limits or Thresholds()
    conf = clamp(F.coalesce("confidence", F.lit(0.0)))
    rows = observed.select(page, "idx", F.coalesce("observed", F.lit("")).alias("observed"), conf.alias("confidence"), F.coalesce("alternatives", F.array().cast("array<struct<text:string,confidence:double>>")).alias("alternatives"), *[c for c in observed.columns if c == "substitute_nats"])
    rows = rows.withColumn("token", F.lower("observed"))
    cut = packed if checkpoint else (lambda d: d.cache())
    plain = (F.col("observed") == "") | is_nonword(F.col("observed"))
    red = F.col("confidence") < limits.low_confidence
    alt = "array<struct<text:string,score:double>>"
    fixed = rows.filter(plain).select(
        page, "idx", F.col("observed").alias("text"), F.col("observed").alias("original"), "confidence", F.when(red, "red").otherwise("none").alias("tier"),
        F.when(red, "low recognition confidence").otherwise("").alias("reason"), F.lit(0.0).alias("surprisal"), F.lit(0.0).alias("margin"), F.lit(False).alias("substituted"),
        F.lit(None).cast("string").alias("suggestion"), F.array().cast(alt).alias("alternatives"),
    )
    words = cut(rows.filter(~plain))
    prices = Prices.of(words, models, limits, cut)
    history, active, results = cut(rows.select(page, "idx", F.col("observed").alias("text"))), words, []
    for number in range(max_rounds):
        now = cut(decode_round(active, history, prices, limits, page))
        results.append(now.withColumn("_round", F.lit(number)))
        both = history.join(now.select(page, "idx", F.col("text").alias("_t")), [page, "idx"], "left")
        changed = cut(both.filter("text <> _t").select(page, "idx"))
        if changed.isEmpty():
            every = results[0]
            for more in results[1:]:
                every = every.unionByName(more)
            names = [c for c in now.columns if c not in (page, "idx")]
            last = every.groupBy(page, "idx").agg(F.max_by(F.struct(*names), "_round").alias("_r"))
            return fixed.unionByName((last if number else now.select(page, "idx", F.struct(*names).alias("_r"))).select(page, "idx", "_r.*"))
        pages = changed.select(page).distinct()
        history = cut(both.join(pages, page, "left_semi").select(page, "idx", F.coalesce("_t", "text").alias("text")))
        after = changed.select(page, F.explode(F.array(F.col("idx") + 1, F.col("idx") + 2)).alias("idx")).distinct()
        active = cut(words.join(after, [page, "idx"], "left_semi"))
    raise RuntimeError("decode: not settled")


def first_round(observed: DataFrame, models: Models, limits: Thresholds | None = None, *, page: str = "page_id") -> DataFrame:
    """The first round alone: history is what was observed."""
    limits = limits or Thresholds()
    rows = packed(observed.withColumn("confidence", clamp(F.col("confidence"))).withColumn("token", F.lower("observed")).filter(~((F.col("observed") == "") | is_nonword(F.col("observed")))))
    return decode_round(rows, observed.select(page, "idx", F.col("observed").alias("text")), Prices.of(rows, models, limits, packed), limits, page)


def row_counts_match(sent: DataFrame, replied: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, sent, replied, ok): a reply with another number of tokens can't be laid over the page."""
    a = sent.groupBy(page).agg(F.count("*").alias("sent"))
    b = replied.groupBy(page).agg(F.count("*").alias("replied"))
    both = a.join(b, page, "full").fillna(0, ["sent", "replied"])
    return both.withColumn("ok", F.col("sent") == F.col("replied"))


def rank_readings(scored: DataFrame, *keys: str) -> DataFrame:
    """Best reading, runner-up and margin by ``keys`` from (candidate, score); ties by candidate."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate")
    return scored.withColumn("next", F.lead("score").over(order)).withColumn("r", F.row_number().over(order)).filter("r = 1").select(*keys, "candidate", "score", (F.col("score") - F.col("next")).alias("margin"))
