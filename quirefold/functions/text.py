"""Text as column expressions: normalisation, tokens, digits, Devanagari validity, edit distances."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import edits

#: Characters stripped from both ends of a token before it is compared.
PUNCT = ".,;:!?()[]{}\"'`“”‘’«»·-–—/\\|@#$%^&*+=~<>"
#: Digits of the two scripts.
DEVA_DIGITS, LATIN_DIGITS = "०१२३४५६७८९", "0123456789"
#: Confused digits and the readings they stand for, most frequent first.
DIGIT_PARTNERS = (("9", "1"), ("9", "2"), ("9", "0"), ("3", "1"), ("2", "1"), ("0", "6"), ("0", "8"), ("4", "2"))
#: Names of scripts and what they mean to an engine.
LANGUAGE_ALIASES = {"": "default", "auto": "default", "default": "default", "en": "default", "eng": "default", "devanagari": "devanagari", "deva": "devanagari", "ne": "devanagari", "nep": "devanagari", "hi": "devanagari", "hin": "devanagari"}
#: A number with inner separators, in either script.
DIGIT_RUN = r"[0-9०-९](?:[0-9०-९.,:/-]*[0-9०-९])?"
WHITE = r"(?U)\s+"


def normalize_lines(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one, no blanks around line ends, no empty lines, ends stripped."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t\u00A0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{2,}", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Whitespace runs as one blank, ends stripped."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def norm_token(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(PUNCT)))


def norm_tokens(text: Column, empty: bool = False) -> Column:
    found = F.transform(tokens(text), norm_token)
    return found if empty else F.filter(found, lambda t: t != "")


def distinct_tokens(text: Column, empty: bool = False) -> Column:
    """The different ones of norm_tokens; a token that occurs again is normalised once."""
    found = F.array_distinct(F.transform(F.array_distinct(tokens(text)), norm_token))
    return found if empty else F.filter(found, lambda t: t != "")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def digit_tokens(text: Column) -> Column:
    return F.filter(tokens(text), has_digit)


def fold_digits(text: Column) -> Column:
    return F.translate(text, DEVA_DIGITS, LATIN_DIGITS)


def digit_string(text: Column) -> Column:
    """All numbers, inner separators kept, in ASCII digits and apart by blanks."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(DIGIT_RUN), F.lit(0)), fold_digits), " ")


def digits_only(text: Column) -> Column:
    """Digits of any script in a row, as they are."""
    return F.regexp_replace(text, r"\P{Nd}+", "")


def digits_devanagari(text: Column) -> Column:
    return F.translate(digits_only(text), LATIN_DIGITS, DEVA_DIGITS)


def digit_ratio(text: Column) -> Column:
    solid = F.regexp_replace(text, WHITE, "")
    return F.when(F.length(solid) == 0, 0.0).otherwise(F.length(F.regexp_replace(solid, r"\P{Nd}", "")) / F.length(solid))


def is_digit_crop(text: Column, least: float = 0.5) -> Column:
    return has_digit(text) & (digit_ratio(text) >= least)


def sanitize_field(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\t\r\n]", " "), " +", " "))


def is_deva_word(word: Column) -> Column:
    return (F.length(word) >= 2) & word.rlike("^[ऀ-ॣ॰-ॿ]+$")


def deva_words(text: Column) -> Column:
    """Devanagari words of a text that is in NFC and without joiners."""
    return F.filter(F.regexp_extract_all(text, F.lit("[ऀ-ॣ॰-ॿ]+"), F.lit(0)), is_deva_word)


#: Classes of Devanagari code points. Consonants, vowel signs, virama, nukta, marks, independent vowels.
CLASSES = (
    ("C", r"\x{0915}-\x{0939}\x{0958}-\x{095F}\x{0978}-\x{097F}"),
    ("V", r"\x{093E}-\x{094C}\x{094E}-\x{094F}\x{0955}-\x{0957}\x{0962}-\x{0963}"),
    ("H", r"\x{094D}"),
    ("N", r"\x{093C}"),
    ("M", r"\x{0901}-\x{0903}"),
    ("I", r"\x{0904}-\x{0914}\x{0960}-\x{0961}\x{0972}-\x{0977}"),
)


_CLASS = dict(CLASSES)
#: a vowel sign, virama or nukta without a consonant or nukta before it, or a mark without a base
WRONG = f"(?<![{_CLASS['C']}{_CLASS['N']}])[{_CLASS['V']}{_CLASS['H']}{_CLASS['N']}]|(?<![{_CLASS['C']}{_CLASS['N']}{_CLASS['V']}{_CLASS['M']}{_CLASS['I']}])[{_CLASS['M']}]"


def invalid_devanagari(token: Column) -> Column:
    """Whether a token has a sequence that no Devanagari word has. A vowel sign, virama or nukta needs a consonant or
    nukta before it; a mark needs one of those, a vowel sign, a mark or an independent vowel; U+FFFD is always wrong; a
    token of marks alone is right."""
    body = F.btrim(token, F.lit(PUNCT))
    return token.contains("\ufffd") | (body.rlike(WRONG) & ~body.rlike(f"^[{_CLASS['M']}]+$"))


def devanagari_validity(text: Column) -> Column:
    every = tokens(text)
    deva = F.filter(every, lambda t: t.rlike("[ऀ-ॿ]"))
    bad = F.filter(deva, invalid_devanagari)
    rate = F.when(F.size(deva) > 0, F.round(F.size(bad) / F.size(deva), 4)).otherwise(0.0)
    return F.struct(F.size(every).cast("long").alias("tokens"), F.size(deva).cast("long").alias("devanagari_tokens"), F.size(bad).cast("long").alias("invalid_tokens"), rate.alias("invalid_token_rate"), F.slice(bad, 1, 5).alias("examples"))


def devanagari_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, r"[^\p{L}&&[ऀ-ॿ]]", ""))
    return F.when(letters == 0, 0.0).otherwise(own / letters)


def script_mismatch(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def _number(part: Column) -> Column:
    return fold_digits(part).cast("int")


def _bad_date(year: Column, month: Column, day: Column) -> Column:
    return ~(year.between(1900, 2200) & month.between(1, 12) & day.between(1, 32))


SEPARATED_DATE = r"(?<![0-9०-९])([0-9०-९]{4})[-./।]([0-9०-९]{1,2})[-./।]([0-9०-९]{1,2})(?![0-9०-९])"
BARE_DATE = r"(?<![0-9०-९])((?:२०|१९|20|19)[0-9०-९]{6})(?![0-9०-९])"


def impossible_date(text: Column) -> Column:
    """Whether any date in the text has a year outside 1900-2200, a month outside 1-12 or a day outside 1-32."""
    separated = F.exists(F.regexp_extract_all(text, F.lit(SEPARATED_DATE), F.lit(0)), lambda d: _bad_date(*(_number(F.split(d, "[-./।]")[i]) for i in range(3))))
    bare = F.exists(F.regexp_extract_all(text, F.lit(BARE_DATE), F.lit(1)), lambda d: _bad_date(_number(F.substring(d, 1, 4)), _number(F.substring(d, 5, 2)), _number(F.substring(d, 7, 2))))
    return separated | bare


def date_components(text: Column) -> Column:
    """struct(y, m, d) of the first separated date, else of the first bare one, else null."""
    parts = [_number(F.regexp_extract(text, SEPARATED_DATE, i)) for i in (1, 2, 3)]
    bare = F.regexp_extract(text, BARE_DATE, 1)
    other = [_number(F.substring(bare, i, n)) for i, n in ((1, 4), (5, 2), (7, 2))]
    shape = lambda p: F.struct(*(c.alias(n) for c, n in zip(p, "ymd")))
    return F.when(text.rlike(SEPARATED_DATE), shape(parts)).when(text.rlike(BARE_DATE), shape(other))


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0))


def separator_pattern(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\sA-Za-z\p{Nd}]+"), F.lit(0))


def flags_key(flags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>")))), "|")


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def skeleton(text: Column) -> Column:
    return casefold(normalize(F.regexp_replace(text, r"\p{Nd}", "#")))


def memory_norm(text: Column) -> Column:
    return casefold(normalize(text))


def memory_digits(text: Column) -> Column:
    return F.regexp_replace(digit_string(text), r"\P{Nd}", "")


def memory_shape(text: Column) -> Column:
    return F.transform(F.filter(F.split(digit_string(text), " "), lambda r: r != ""), lambda r: F.length(F.regexp_replace(r, r"\P{Nd}", "")).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Places with different characters, over the shorter length."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce((x != y).cast("long"), F.lit(0).cast("long")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def value_pairs(original: Column, corrected: Column, least: int = 4) -> Column:
    """(digits, original, corrected) of numbers in the same place that one misread digit explains."""
    a, b = (F.regexp_extract_all(x, F.lit(DIGIT_RUN), F.lit(0)) for x in (original, corrected))
    bare = lambda x: F.regexp_replace(fold_digits(x), r"\P{Nd}", "")
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.struct(bare(p["a"]).alias("digits"), p["a"].alias("original"), p["b"].alias("corrected")))
    good = F.filter(pairs, lambda p: (p["original"] != p["corrected"]) & (F.length(p["digits"]) >= least) & (bare(p["corrected"]) != "") & within_one_edit(p["digits"], bare(p["corrected"])))
    return F.when(F.size(a) == F.size(b), good).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def digit_confusions(text: Column, page_values: Column | None = None, limit: int = 2) -> Column:
    """Readings with one digit replaced by one it is confused with: those whose value occurs on the page first, then by
    frequency of the confusion, then by place; distinct; at most limit."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    every = []
    for order, (digit, partner) in enumerate(DIGIT_PARTNERS):
        twin = F.translate(F.lit(digit), LATIN_DIGITS, DEVA_DIGITS), F.translate(F.lit(partner), LATIN_DIGITS, DEVA_DIGITS)

        def chip(i):
            at = F.substring(text, i, F.lit(1))
            put = F.when(at == digit, F.lit(partner)).when(at == twin[0], twin[1])
            new = F.concat(F.substring(text, F.lit(1), i - 1), put, F.substring(text, i + 1, F.length(text)))
            value = F.regexp_replace(fold_digits(new), r"\P{Nd}", "")
            known = F.lit(1) if page_values is None else F.when(F.array_contains(page_values, value), 0).otherwise(1)
            return F.struct(known.alias("tier"), F.lit(order).alias("rank"), i.alias("at"), new.alias("text"))

        every.append(F.filter(F.transform(places, chip), lambda c: c["text"].isNotNull()))
    ranked = F.array_sort(F.flatten(F.array(*every)))
    return F.slice(F.array_distinct(ranked["text"]), 1, limit)


def language_alias(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit("default"))


def corpus_line_ok(line: Column, letters: str = r"\p{L}", own: str = "ऀ-ॿ", allowed: str | None = "ऀ-ॿ0-9 .,;:!?()'\"-", least: int = 10, most: int = 60, share: float = 0.6) -> Column:
    """Whether a line is fit for a corpus: length, no damage, no address, letters mostly of one script, allowed
    characters only, no invalid sequence. own is a character class of the script."""
    text = normalize(line)
    every = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    mine = F.length(F.regexp_replace(text, rf"[^{letters}&&[{own}]]", ""))
    good = F.length(text).between(least, most) & ~text.contains("\ufffd") & ~text.rlike(r"(?i)https?://|www\.") & (every > 0) & (mine / F.greatest(every, F.lit(1)) >= share)
    if allowed is not None:
        good = good & ~text.rlike(f"[^{allowed}]")
    return good & ~F.exists(tokens(text), lambda t: t.rlike("[ऀ-ॿ]") & invalid_devanagari(t))


def label_ok(text: Column, least: int = 3, most: int = 48) -> Column:
    return F.length(text).between(least, most) & text.rlike(r"\p{L}")


def truncate_words(text: Column, most: int = 60, floor: int = 20) -> Column:
    """At most so many characters, cut at the last blank if that leaves more than floor."""
    head = F.substring(text, 1, most)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).when((F.instr(head, " ") > 0) & (cut > floor), F.substring(head, F.lit(1), cut)).otherwise(head)


def token_error_kind(gt: Column, hyp: Column) -> Column:
    """Kind of a misread token: digit (other numbers), order (same characters), unrelated (none shared), matra, consonant,
    other."""
    from .udfs import token_error_kinds

    return token_error_kinds(gt, hyp)


def canonical_label(action: Column, original: Column, corrected: Column) -> Column:
    return F.when(action == "confirmed", original).otherwise(corrected)


def output_name(path: Column, suffix: str, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f"{suffix}.{ext}"))


def cer(gt: Column, hyp: Column) -> Column:
    """Character edits over the truth's length; 0 or 1 where the truth is empty. May exceed 1."""
    g, h = normalize(gt), normalize(hyp)
    return F.when(g == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(edits(g, h) / F.length(g))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def cer_bag(gt: Column, hyp: Column) -> Column:
    return cer(sorted_tokens(gt), sorted_tokens(hyp))


def digit_cer(gt: Column, hyp: Column) -> Column:
    return cer(F.array_join(digit_tokens(gt), " "), F.array_join(digit_tokens(hyp), " "))


def encoded(text: Column, charset: Column) -> Column:
    """Class ids of a text's characters: places in the charset from 1, 0 being a recogniser's blank; others are left out."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.filter(F.transform(chars, lambda c: F.call_function("locate", c, charset)), lambda k: k > 0)


#: The worst flags of a row come first; risks from which a bar is high, or beyond which it is middling.
AMBER, HIGH_RISK, MIDDLE_RISK = ("digit_uncertain", "low_conf", "unknown_word"), 5.0, 1.0


def row_tone(flags: Column) -> Column:
    """Tone of a queue's row: that of its worst flag."""
    return F.when(F.array_contains(flags, "digit_conflict"), "red").when(F.arrays_overlap(flags, F.array(*map(F.lit, AMBER))), "amber").otherwise("neutral")


def risk_tone(risk: Column) -> Column:
    return F.when(risk >= HIGH_RISK, "high").when(risk > MIDDLE_RISK, "mid").otherwise("low")
