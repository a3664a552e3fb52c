"""Column functions over strings: cleaning, normal forms, tokens, fuzzy name equality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that mean "absent", as extraction and evaluation each know them.
NULLISH_EXTRACTION = ("", "null", "none", "n/a", "na", "nan", "nil", "unknown", "not specified", "not reported", "not stated")
NULLISH_EVALUATION = ("", "null", "none", "n/a", "na", "nan", "nil", "unknown", "not specified", "exact version not specified", "not reported", "not stated", "modern gpus")
# Words that carry no identity in a name.
STOP_WORDS = ("the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "with", "via", "using", "based", "our", "their")


def plain(x: Column) -> Column:
    """Trimmed lower case; null becomes the empty string."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def clean(x: Column, nullish: tuple[str, ...] = NULLISH_EXTRACTION) -> Column:
    """Null where the string only says that nothing is known."""
    return F.when(~F.lower(F.trim(x)).isin(*nullish), x)


def norm(x: Column) -> Column:
    """Lower case without parenthesised parts; runs of anything but a-z and 0-9 become one space."""
    bare = F.regexp_replace(plain(x), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _named(n: Column) -> Column:
    """Words of a normal form that are longer than one character and no stop words."""
    return F.filter(F.split(n, " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def _initials(w: Column) -> Column:
    return F.when(F.size(w) >= 2, F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), ""))


def _acronyms(x: Column, w: Column) -> Column:
    inside = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\(([A-Za-z0-9-]{2,})\)"), F.lit(1))
    inside = F.transform(inside, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    return F.array_distinct(F.array_compact(F.concat(inside, F.array(_initials(w)))))


def tokens(x: Column) -> Column:
    """Distinct words of the normal form that are longer than one character and no stop words."""
    return F.array_distinct(_named(norm(x)))


def initials(x: Column) -> Column:
    """First letters of the tokens in order, if there are two or more; else null."""
    return _let(_named(norm(x)), _initials)


def acronyms(x: Column) -> Column:
    """Parentheses that hold two or more letters, digits and dashes only (dashes are dropped), and the initials."""
    return _let(_named(norm(x)), lambda w: _acronyms(x, w))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def facts(x: Column) -> Column:
    """What the comparison of names needs of each: computed once a row, before rows meet in a join."""
    bare = F.replace(plain(x), F.lit(" "), F.lit(""))

    def of(n: Column) -> Column:
        squeezed = F.replace(n, F.lit(" "), F.lit(""))  # equal normal forms are equal here, too
        return _let(_named(n), lambda w: F.struct(squeezed.alias("squeezed"), F.array_distinct(w).alias("tokens"), _acronyms(x, w).alias("acronyms"), bare.alias("bare")))

    return _let(norm(x), of)


def holds(a: Column, b: Column, least: int) -> Column:
    """The shorter string, of ``least`` characters or more, occurs in the longer one."""
    return F.when(F.length(a) <= F.length(b), (F.length(a) >= least) & F.contains(b, a)).otherwise((F.length(b) >= least) & F.contains(a, b))


def facts_match(a: Column, b: Column) -> Column:
    """Of two ``facts``: an acronym of the other, a shared acronym, half of the tokens shared, equal without blanks, or one inside the other (4 or more characters)."""
    x, y = a["squeezed"], b["squeezed"]
    ta, tb = a["tokens"], b["tokens"]
    half = 3 * F.size(F.array_intersect(ta, tb)) >= F.size(ta) + F.size(tb)  # the Jaccard similarity is 0.5 or more
    return F.when((x == "") | (y == ""), F.lit(False)).otherwise(
        (x == y)
        | holds(x, y, 4)
        | F.array_contains(a["acronyms"], y)
        | F.array_contains(b["acronyms"], x)
        | F.arrays_overlap(a["acronyms"], b["acronyms"])
        | ((F.size(ta) > 0) & (F.size(tb) > 0) & half)
    )


def names_match(a: Column, b: Column) -> Column:
    """Names that are the same but for spelling, as ``facts_match`` of both."""
    return facts_match(facts(a), facts(b))


def slug(x: Column) -> Column:
    """Lower case, other runs than a-z and 0-9 as one dash, none at the ends; null becomes "default"."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("default"))


# Families of models, by a word of their names.
MODEL_FAMILIES = ("qwen", "llama", "mistral", "mixtral", "gemma", "phi", "deepseek", "gpt", "falcon")


def percent(n: Column, d: Column) -> Column:
    """A share as text with one digit, a dash where there is nothing to share."""
    return F.when(d != 0, F.concat(F.format_string("%.1f", 100 * n / d), F.lit("%"))).otherwise("—")


def model_label(x: Column) -> Column:
    """The first model family that the name holds, else its first twelve characters."""
    out, low = F.substring(F.coalesce(x, F.lit("")), 1, 12), F.lower(F.coalesce(x, F.lit("")))
    for family in reversed(MODEL_FAMILIES):
        out = F.when(low.contains(family), family).otherwise(out)
    return out


ARXIV = r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"


def arxiv_id(x: Column) -> Column:
    """The identifier without its version, null if it has another form."""
    return F.when(F.trim(x).rlike(ARXIV), F.regexp_replace(F.trim(x), "v[0-9]+$", ""))


def pdf_url(x: Column) -> Column:
    """The canonical PDF address of an abstract or PDF page, other addresses as they are."""
    found = F.regexp_extract(F.trim(x), r"^https?://arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?$", 1)
    return F.when(found != "", F.concat(F.lit("https://arxiv.org/pdf/"), found, F.lit(".pdf"))).otherwise(F.trim(x))


def repo_key(x: Column) -> Column:
    """host/owner/name in lower case without scheme, www, .git and what follows the name; null if there aren't three parts."""
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^https?://(www\\.)?", ""), "[?#].*$", "")
    parts = F.filter(F.split(F.regexp_replace(path, r"/+$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.regexp_replace(F.get(parts, F.lit(2)), r"\.git$", "")))
