"""Risk flags of tokens, the review queue and what is derived from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

from .joins import met as met_by_page

#: Weights of the flags; any other flag weighs 1.
RISK_WEIGHTS = {
    "digit_conflict": 3.0,
    "cross_model_conflict": 3.0,
    "multi_read_conflict": 2.5,
    "context_conflict": 2.0,
    "script_mismatch": 2.5,
    "invalid_sequence": 1.0,
    "invalid_format": 2.0,
    "digit_uncertain": 1.5,
    "digit_added": 1.5,
    "unknown_word": 0.5,
    "low_conf": 1.0,
}


def flag_tokens(text: Column, conf: Column, threshold: float = 60.0, devanagari: bool = False, digit_conf: float | None = None, dates: bool = False) -> Column:
    """Flags of a token, in fixed order; nothing is repeated."""
    bar = digit_conf if digit_conf is not None else 90.0 if devanagari else 80.0
    rules = [("low_conf", conf < threshold), ("digit_uncertain", T.has_digit(text) & (conf < bar))]
    if devanagari:
        rules += [("script_mismatch", T.script_mismatch(text)), ("invalid_sequence", T.invalid_devanagari(text))]
        rules += [("invalid_format", T.impossible_date(text))] if dates else []
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def risk(flags: Column, text: Column | None = None, repass: Column | None = None, alt: Column | None = None) -> Column:
    """Sum of the flags' weights, repeats counted; 2 more where a re-read has other digits, 0.5 where there is another reading."""
    weights = F.create_map(*(F.lit(x) for pair in RISK_WEIGHTS.items() for x in pair))
    out = F.aggregate(flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(weights, f), F.lit(1.0)))
    if repass is not None and text is not None:
        out = out + F.when(repass.isNotNull() & (T.digits_only(repass) != T.digits_only(text)), 2.0).otherwise(0.0)
    if alt is not None:
        out = out + F.when(alt.isNotNull(), 0.5).otherwise(0.0)
    return out


def review_queue(tokens: DataFrame, page: str = "doc_id", top: int | None = None) -> DataFrame:
    """Flagged tokens with risk and their rank on the page: riskiest first, then by y, x and order.

    With top, ranks beyond it are cut by Spark's own group limit before the shuffle.
    """
    order = Window.partitionBy(page).orderBy(F.col("risk").desc(), "y0", "x0", "pos")
    extra = {n: F.col(n) for n in ("repass_text", "alt_text") if n in tokens.columns}
    rows = tokens.where(F.size("flags") > 0).withColumn("risk", risk(F.col("flags"), F.col("text"), extra.get("repass_text"), extra.get("alt_text")))
    rows = rows.withColumn("rn", F.row_number().over(order).cast("long"))
    return rows.where(F.col("rn") <= top) if top else rows


def unknown_word(tokens: DataFrame, lexicon: DataFrame, words: Column, share: float = 1.0) -> DataFrame:
    """tokens with oov: whether a token without digits has words and at least so large a share is outside lexicon(word).

    Words are looked up by a join, once for each different word of the lexicon; a token's words come together again by
    its key (doc_id, pos).
    """
    each = tokens.where(~T.has_digit(F.col("text"))).select("doc_id", "pos", F.explode(words).alias("word"))
    known = lexicon.select("word").distinct().withColumn("known", F.lit(1))
    met = each.join(known, "word", "left").groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("oov"))
    bad = met.where((F.col("oov") > 0) & (F.col("oov") >= share * F.col("n"))).select("doc_id", "pos", F.lit(True).alias("unknown"))
    return met_by_page(tokens, bad, ["doc_id", "pos"], "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))


def isotonic(conf: Column, xs: list[float], ys: list[float], expanded: bool = False) -> Column:
    """Piecewise-constant calibration of a confidence of 0 to 100: the y of the last x not above it.

    Pairs beyond the shorter list are unused, as published tables have fewer y than x; expanded repeats the last y.
    """
    if expanded and len(ys) < len(xs):
        ys = [*ys, *[ys[-1]] * (len(xs) - len(ys))]
    pairs = list(zip(xs, ys))
    out = F.lit(float(ys[0]))
    for x, y in pairs:
        out = F.when(conf / 100 >= x, F.lit(float(y))).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), out * 100))


def infer_angle(share: Column, confident: Column, vertical: Column, tokens: Column, auto: bool = True, least: int = 5) -> Column:
    """Orientation from line votes and the share of upright boxes: struct(source, angle to turn by, raw angle suspected), by
    the first rule that holds. Votes (null: there are none) count on pages of at least so many tokens. Without auto
    nothing is turned: the source is off and the raw angle tells what would have been done."""
    known = share.isNotNull() & (tokens >= least)
    rules = [(known & (share >= 0.6) & (confident >= 0.4), "votes-180", 180, 180), (vertical >= 0.6, "probe-needed", 0, 90), (known & (share >= 0.5), "vote-ambiguous", 0, 180)]
    source, angle, raw = F.lit("upright"), F.lit(0), F.lit(None).cast("int")
    for rule, name, turn, seen in rules[::-1]:
        source = F.when(rule, name if auto else "off").otherwise(source)
        angle = F.when(rule, turn if auto else 0).otherwise(angle)
        raw = F.when(rule, seen).otherwise(raw)
    return F.struct(source.alias("source"), angle.alias("angle"), raw.alias("raw"))


def harvest_reason(chars: Column, own_share: Column, invalid: Column) -> Column:
    """Why a source is not fit to be harvested, or null."""
    return F.when(chars < 300, "too_little_text").when(own_share < 0.4, "not_the_script").when(invalid > 0.02, "damaged_text")


#: Flags with a colour, in order of precedence; any other flag is drawn as none.
PALETTE = (("digit_conflict", "red"), ("low_conf", "amber"), ("digit_uncertain", "amber"), ("unknown_word", "amber"), ("multi_read_conflict", "amber"), ("context_conflict", "amber"))


def colour(flags: Column) -> Column:
    """Colour of the first flag of the palette that a token has; green without any."""
    out = F.lit("green")
    for flag, name in PALETTE[::-1]:
        out = F.when(F.array_contains(flags, flag), name).otherwise(out)
    return out


def flag_page(tokens: DataFrame, threshold: float = 60.0, devanagari: bool = False, dates: bool = False, calibration: tuple[list[float], list[float]] | None = None, lexicon: DataFrame | None = None, words: Column | None = None) -> DataFrame:
    """tokens(doc_id, pos, text, conf) with flags, in fixed order, and cal_conf, the calibrated confidence to two places
    (null without a calibration). Words outside the lexicon are flagged last, and on Devanagari pages only."""
    rows = tokens.withColumn("flags", flag_tokens(F.col("text"), F.col("conf"), threshold, devanagari, dates=dates))
    rows = rows.withColumn("cal_conf", F.round(isotonic(F.col("conf"), *calibration), 2) if calibration else F.lit(None).cast("double"))
    if not devanagari or lexicon is None or words is None:
        return rows
    met = unknown_word(rows, lexicon, words)
    return met.withColumn("flags", F.when(F.col("unknown"), F.concat("flags", F.array(F.lit("unknown_word")))).otherwise(F.col("flags"))).drop("unknown")
