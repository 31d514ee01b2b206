"""Lists, tokens and skill bags from text cells, and text cleaning, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no skills, words that say nothing in a title.
SKILL_STOP_WORDS = [
    "a", "an", "and", "or", "the", "of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "is", "it", "this", "that", "be", "are",
    "was", "were", "we", "they", "you", "etc", "via", "using", "use", "used", "able", "also", "any", "such", "into", "over", "than", "then",
    "these", "those", "their", "them", "our", "ours", "very",
]
TITLE_NOISE = ["sr", "jr", "the", "a", "an", "of", "and", "to", "in", "at", "i", "ii"]

ITEM_BREAK = r"[|,;]"
QUOTED_ITEM = r"'[^']*'|\"[^\"]*\""

#: Instruction that goes before a text to encode as a query; profiles get none.
QUERY_PREFIX = "Represent this query for retrieving relevant passages: "


def no_items() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquote(item: Column) -> Column:
    return F.regexp_replace(item, r"^[\s'\"]+|[\s'\"]+$", "")


def _clean(items: Column, drop: list[str]) -> Column:
    low = F.transform(items, lambda x: F.lower(_unquote(x)))
    return F.array_distinct(F.filter(low, lambda x: ~x.isin("", *drop)))


def _bracketed(cell: Column) -> Column:
    return cell.startswith("[") & cell.endswith("]") & (F.length(cell) >= 2)


def list_cell(cell: Column) -> Column:
    """A list cell of a source table as an array: a bracketed list of quoted items, or items between | , ;.

    Items are trimmed, unquoted and lower-cased; empty ones and 'nan' go; the first of equal ones stays.
    Null gives an empty array.
    """
    text = strip(cell)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    quoted = F.regexp_extract_all(inner, F.lit(QUOTED_ITEM), F.lit(0))
    items = F.when(_bracketed(text) & (F.size(quoted) > 0), quoted).when(_bracketed(text), F.split(inner, ITEM_BREAK)).otherwise(F.split(text, ITEM_BREAK))
    return F.coalesce(_clean(items, ["nan"]), no_items())


def runtime_list_cell(cell: Column) -> Column:
    """A list cell as serving reads it: like list_cell, but 'nan' items stay and a bare [a b] splits at white space."""
    text = strip(cell)
    inner = strip(F.substring(text, F.lit(2), F.length(text) - 2))
    quoted = F.regexp_extract_all(inner, F.lit(QUOTED_ITEM), F.lit(0))
    bare = F.when(F.contains(inner, F.lit(",")), F.split(inner, ITEM_BREAK)).otherwise(F.split(inner, r"\s+"))
    items = F.when(_bracketed(text) & (F.size(quoted) > 0), quoted).when(_bracketed(text), bare).otherwise(F.split(text, ITEM_BREAK))
    return F.when(cell.isNull() | (F.lower(text) == "nan"), no_items()).otherwise(_clean(items, []))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda w: w != "")


def _is_skill_word(word: Column) -> Column:
    return F.length(word).between(2, 30) & ~word.isin(SKILL_STOP_WORDS) & ~word.startswith("http")


def _is_pair_word(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(SKILL_STOP_WORDS)


def _phrase_tokens(phrase: Column) -> Column:
    text = F.regexp_replace(F.lower(strip(phrase)), r"[^a-z0-9+\-./# ]+", " ")
    compound, apart = _words(text), _words(F.translate(text, "/-", "  "))
    words = F.when(F.size(apart) > 0, apart).otherwise(compound)
    whole = F.filter(
        F.array(
            F.when(F.size(words).between(1, 3), F.array_join(words, " ")),
            F.when(F.size(compound).between(1, 3) & (compound != words), F.array_join(compound, " ")),
        ),
        lambda x: x.isNotNull(),
    )
    following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), following,
        lambda a, b: F.when(_is_pair_word(a) & _is_pair_word(b), F.concat_ws(" ", a, b)),
    )
    tokens = F.concat(whole, F.filter(F.concat(words, compound), _is_skill_word), F.filter(pairs, lambda x: x.isNotNull()))
    return F.when(F.lower(strip(phrase)).rlike(r"^(https?://|www\.)"), no_items()).otherwise(tokens)


def skill_bag(phrases: Column) -> Column:
    """Skill phrases as a sorted bag of phrases of up to three words, single words and pairs of adjacent words.

    Words joined by / or - count joined and apart; stop words and links are no skills. Null gives an empty bag.
    """
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(phrases, _phrase_tokens)))), no_items())


def title_tokens(title: Column) -> Column:
    """Tokens of a title as training reads it: [a-z0-9+#]+ of two characters or more, without noise words."""
    found = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9+#]+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(TITLE_NOISE))), no_items())


def token_set(text: Column) -> Column:
    """Tokens of a text as serving reads it: lower case, / and - as spaces, split at white space."""
    parts = F.split(F.translate(F.lower(text), "/-", "  "), r"\s+")
    return F.coalesce(F.array_distinct(F.filter(parts, lambda t: t != "")), no_items())


def piped_skills(cell: Column) -> Column:
    """Skills of a profile as training reads them: split at |, case kept, empty ones dropped."""
    return F.coalesce(F.array_distinct(F.filter(F.split(cell, r"\|"), lambda x: x != "")), no_items())


def literal_skills(cell: Column) -> Column:
    """Skills of an opening as training reads them: items of a quoted list literal, none if it is not one."""
    quoted = F.regexp_extract_all(cell, F.lit(QUOTED_ITEM), F.lit(0))
    items = F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(_bracketed(strip(cell)), F.array_distinct(items)).otherwise(no_items())


def number_or(cell: Column, default: float = 0.0) -> Column:
    """A cell as a double, with a default where it is none."""
    return F.coalesce(cell.try_cast("double"), F.lit(float(default)))


def overlap_ratio(part: Column, of: Column) -> Column:
    """Share of the second set that the first holds; 0 for an empty set."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, part)) / F.size(of)).otherwise(F.lit(0.0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dedup_segments(text: Column) -> Column:
    """A text without repeated segments (between two spaces or more): the first of each, case aside, three spaces between.

    A text of one segment, or blank, or null, stays as it is. Segments are sorted by their lower-case form, so
    that a text of many takes no quadratic time.
    """

    def firsts(parts: Column) -> Column:
        keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.lower(p).alias("low"), i.alias("at"), p.alias("part"))))
        kept = bound(keyed, lambda rows: F.filter(rows, lambda x, i: ~x["low"].eqNullSafe(F.get(rows, i - 1)["low"])))
        ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["part"].alias("part"))))
        return F.array_join(F.transform(ordered, lambda x: x["part"]), "   ")

    parts = F.filter(F.transform(F.split(text, " {2,}"), strip), lambda p: p != "")
    return bound(parts, lambda found: F.when(F.size(found) > 1, firsts(found)).otherwise(text))


def text_to_encode(text: Column, is_query: bool, use_prefix: bool = True) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text) if is_query and use_prefix else text


def unit_vector(vector: Column) -> Column:
    """A vector over its Euclidean length, in doubles; a zero vector stays. Null components stay null and add nothing to the length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def preview(text: Column, length: int) -> Column:
    """The first characters of a text, trimmed, with ... where it was cut."""
    cut = strip(F.substring(text, 1, length))
    return F.when(F.length(text) > length, F.concat(cut, F.lit("..."))).otherwise(strip(text))


def snippet(text: Column, length: int = 260) -> Column:
    """White space collapsed and cut, with an ellipsis."""
    clean = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, length), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(clean) > length, cut).otherwise(clean)


def percent(score: Column) -> Column:
    """A score as a whole percentage from 0 to 100; null counts as 0."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5))).cast("int")


def tier(share: Column) -> Column:
    return F.when(share >= 75, "strong").when(share >= 50, "good").otherwise("weak")


def candidate_summary(matched: Column, missing: Column, experience: Column, years: Column, required: Column) -> Column:
    """One line on a candidate: matched and missing skills, else the experience text, else the years."""

    def first(items: Column, n: int) -> Column:
        return F.array_join(F.slice(items, 1, n), ", ")

    have, lack = F.coalesce(F.size(matched), F.lit(0)) > 0, F.coalesce(F.size(missing), F.lit(0)) > 0
    years = F.coalesce(years, F.lit(0.0))
    return (
        F.when(have & lack, F.concat(F.lit("Skills matched: "), first(matched, 4), F.lit(". Not found: "), first(missing, 3), F.lit(".")))
        .when(have, F.concat(F.lit("Strong skill alignment — covers: "), first(matched, 5), F.lit(".")))
        .when(F.coalesce(experience, F.lit("")) != "", experience)
        .when((years >= F.coalesce(required, F.lit(0.0))) & (years > 0), F.concat(F.floor(years + 0.5).cast("string"), F.lit(" years of experience — meets the requirement.")))
        .otherwise("Review resume for skill and experience details.")
    )
