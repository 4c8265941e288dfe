"""Text functions: cleaning of extracted pages, headings, ids and phrase rules.

All are expressions on columns. Patterns name their classes in ASCII, lines end
with ``\\n`` alone, and white space is what :data:`BLANK` lists, so that results
do not depend on an engine's locale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and spaces that cleaning folds.
FOLDS = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (" ", " "), ("­", "")]
BLANK = r"[ \t\r\n\x0B\f]+"
#: Characters of a chunk, at most.
MAX_CHUNK = 4000
# The name from which ids of stored points derive (RFC 4122 URL namespace).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
POINT_NAMESPACE_NAME = "https://docloom.invalid/points"


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(c, F.lit(" \t\r\n\x0b\f"))


def normalise_unicode(c: Column) -> Column:
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def join_hyphenated(c: Column) -> Column:
    """A word broken at a hyphen goes on in its line; the hyphen stays."""
    return F.regexp_replace(c, r"([A-Za-z]+)-\n([a-z]+)", "$1-$2")


def cut_to_start(c: Column, pattern: str) -> Column:
    """From the first match on; a text without one is an error."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, F.substr(c, at)).otherwise(F.raise_error(F.lit(f"no start marker {pattern!r}")))


def cut_at_end(c: Column, pattern: str) -> Column:
    """Up to the first match; a text without one is an error."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(F.raise_error(F.lit(f"no end marker {pattern!r}")))


def remove_footer_numbers(c: Column) -> Column:
    """Lines of digits right before a page marker, and one at the very end."""
    c = F.regexp_replace(c, r"\n[ \t]*[0-9]+[ \t]*\n+(?=--- PAGE [0-9]+ ---)", "\n")
    return F.regexp_replace(c, r"\n[ \t]*[0-9]+[ \t]*\n*\z", "\n")


def remove_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\n---[ \t]*PAGE[ \t]*[0-9]+[ \t]*---\n", "\n")


def remove_running_headers(c: Column, pattern: Column | str) -> Column:
    return F.regexp_replace(c, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(""))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalise_lines(c: Column) -> Column:
    """Stripped lines; one that equals the last non-blank line goes, blank runs become one blank line.

    Non-blank lines carry how many blank ones came before; a line that differs
    from the one before it stays, and two that stay are parted by a blank line
    where that number grew. Every step is one pass over an array.
    """
    stripped = F.transform(F.split(c, "\n", -1), lambda x, i: F.struct(strip(x).alias("l"), i.alias("i")))
    some = F.transform(F.filter(stripped, lambda x: x["l"] != ""), lambda x, j: F.struct(x["l"].alias("l"), (x["i"] - j).alias("blanks")))
    kept = _let(some, lambda own: F.filter(own, lambda x, j: F.when(j == 0, True).otherwise(x["l"] != F.get(own, j - 1)["l"])))
    apart = lambda own, x, j: F.when(j == 0, "").when(x["blanks"] > F.get(own, j - 1)["blanks"], "\n\n").otherwise("\n")
    return _let(kept, lambda own: F.array_join(F.transform(own, lambda x, j: F.concat(apart(own, x, j), x["l"])), ""))


def clean(c: Column, start: str | None = None, end: str | None = None, header: str | None = None) -> Column:
    """All cleaning steps in order; patterns act before white space is folded."""
    c = cut_to_start(c, start) if start else c
    c = cut_at_end(c, end) if end else c
    c = remove_page_markers(remove_footer_numbers(c))
    c = remove_running_headers(c, header) if header else c
    return F.concat(strip(normalise_lines(join_hyphenated(normalise_unicode(c)))), F.lit("\n"))


def split_text(c: Column, limit: int = MAX_CHUNK) -> Column:
    """Parts of at most ``limit`` characters, packed line by line.

    A text within the limit is one part. A longer line is cut into stretches of
    ``limit``. A line opens a new part when the part's characters, a line end
    counted for each line, would pass the limit. Blank parts are dropped.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("parts"), none.alias("own"), F.lit(0).alias("size"))
    joined = lambda own: F.when(F.size(own) > 0, F.array(F.array_join(own, "\n"))).otherwise(none)

    def step(s: Column, x: Column) -> Column:
        hard, full = F.length(x) > limit, (s["size"] + F.length(x) + 1 > limit) & (F.size(s["own"]) > 0)
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(limit)), lambda i: F.substring(x, i + 1, F.lit(limit)))
        return F.struct(
            F.when(hard, F.concat(s["parts"], joined(s["own"]), pieces)).when(full, F.concat(s["parts"], joined(s["own"]))).otherwise(s["parts"]).alias("parts"),
            F.when(hard, none).when(full, F.array(x)).otherwise(F.concat(s["own"], F.array(x))).alias("own"),
            F.when(hard, F.lit(0)).otherwise(F.when(full, F.lit(0)).otherwise(s["size"]) + F.length(x) + 1).alias("size"),
        )

    packed = F.aggregate(F.split(c, "\n", -1), start, step, lambda s: F.concat(s["parts"], joined(s["own"])))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.filter(packed, lambda x: strip(x) != ""))


def slug(path: Column) -> Column:
    return F.lower(F.replace(F.array_join(path, "-"), F.lit(" "), F.lit("-")))


def version_slug(document: Column, version: Column) -> Column:
    return F.concat(document, F.lit("@v"), version)


def chunk_id(document: Column, version: Column, path: Column, part: Column, parts: Column) -> Column:
    base = F.concat(version_slug(document, version), F.lit("-"), slug(path))
    return F.when(parts > 1, F.concat(base, F.lit("-part-"), part.cast("string"))).otherwise(base)


def citation(path: Column) -> Column:
    return F.array_join(path, " — ")


def heading(title: Column, cited: Column) -> Column:
    """Citation and title; a title that the citation holds, in any case, is left out."""
    cited, title = strip(F.coalesce(cited, F.lit(""))), strip(F.coalesce(title, F.lit("")))
    held = F.instr(F.lower(cited), F.lower(title)) > 0
    return F.when((title == "") | ((cited != "") & held), cited).when(cited == "", title).otherwise(F.concat(cited, F.lit(": "), title))


def contextual_text(document: Column, head: Column, content: Column) -> Column:
    """Document title and heading, an empty line, and the content."""
    none = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    top = F.concat_ws("\n", none(document), none(head))
    return F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("\n\n"))), content)


def uuid5(namespace: Column, name: Column) -> Column:
    """UUID version 5 from a namespace in hex and a name."""
    h = F.sha1(F.concat(F.unhex(namespace), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def point_id(chunk: Column) -> Column:
    """The stored point's id: the same for the same chunk id, always."""
    namespace = F.replace(uuid5(F.lit(URL_NAMESPACE), F.lit(POINT_NAMESPACE_NAME)), F.lit("-"), F.lit(""))
    return F.when(F.coalesce(chunk, F.lit("")) == "", F.raise_error(F.lit("an id needs a chunk id"))).otherwise(uuid5(namespace, chunk))


# Conversational inputs with their intents, and the pattern of their drawn-out forms.
EXACT_INTENTS = {
    "hi": "greeting",
    "hey": "greeting",
    "hello": "greeting",
    "morning": "greeting",
    "good morning": "greeting",
    "good afternoon": "greeting",
    "good evening": "greeting",
    "who are you": "identity",
    "what are you": "identity",
    "what is your name": "identity",
    "what can you do": "identity",
    "thanks": "gratitude",
    "thank you": "gratitude",
}
DRAWN_OUT = r"^(hello+|hey+|hi+|thanks? (a lot|so much|very much))$"


def normalise_input(c: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), BLANK, " "), F.lit(" .!?,;:"))


def exact_intent(c: Column) -> Column:
    """The intent of a known phrase, else null."""
    x = normalise_input(c)
    known = F.create_map(*[F.lit(v) for pair in EXACT_INTENTS.items() for v in pair])
    drawn = F.when(x.rlike("^thank"), "gratitude").otherwise("greeting")
    return F.coalesce(F.try_element_at(known, x), F.when(x.rlike(DRAWN_OUT), drawn))


# Phrases of a rewrite that name a provision, an instrument or a number are refused.
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
    "billion", "half", "double", "treble",
)
REFUSED = [
    r"(?i)\b(?:article|art|section|sec|cap|chapter|part|schedule)\.?\s*\(?[0-9]|\bs\.\s*[0-9]|\bconstitution\b",
    r"\b(?:Act|Code)\b",
    r"(?i)[0-9]|\b(?:" + "|".join(NUMBER_WORDS) + r")\b",
]


def rewrite_clean(phrases: Column, limit: int = 3, longest: int = 120) -> Column:
    """Up to ``limit`` usable phrases, the first of each spelling in lower case."""
    tidy = F.transform(F.filter(phrases, lambda x: x.isNotNull()), lambda x: F.btrim(F.regexp_replace(x, BLANK, " "), F.lit(" \"'.;,")))
    fits = F.filter(tidy, lambda x: (x != "") & (F.length(x) <= longest) & ~(x.rlike(REFUSED[0]) | x.rlike(REFUSED[1]) | x.rlike(REFUSED[2])))
    fold = F.aggregate(fits, F.array().cast("array<string>"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))
    return F.slice(fold, 1, limit)


def rerank_query(question: Column, phrases: Column) -> Column:
    return F.when(F.size(phrases) > 0, F.concat(question, F.lit("\nRelated legal terms: "), F.array_join(phrases, "; "))).otherwise(question)


def without_sentences(c: Column, markers: list[str]) -> Column:
    """Without the sentences that hold one of ``markers`` (in lower case), and without blank ones."""
    clean = lambda x: F.forall(F.array(*[F.lit(m) for m in markers]), lambda m: F.instr(F.lower(x), m) == 0) & (strip(x) != "")
    return strip(F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), r"\. "), clean), ". "))


def render(sufficient: Column, polar: Column, opening: Column, statements: Column, qualifications: Column, missing: Column, refusal: str, note: str, markers: list[str]) -> Column:
    """The answer's text: a refusal with what is missing, or opening, statements, bulleted qualifications and note."""
    told = strip(F.array_join(F.filter(statements, lambda x: x != ""), " "))
    first = F.when(polar & opening.isNotNull(), strip(F.concat(opening, F.lit(" "), told))).otherwise(told)
    bullets = F.when(F.size(qualifications) > 0, F.concat(F.lit("Important qualifications:\n\n"), F.array_join(F.transform(qualifications, lambda x: F.concat(F.lit("- "), x)), "\n\n")))
    some = lambda c: F.when(c != "", c)
    reason = without_sentences(missing, markers)
    return F.when(sufficient, F.concat_ws("\n\n", some(first), bullets, some(F.lit(note)))).otherwise(F.concat_ws("\n\n", F.lit(refusal), some(reason)))


def source_block(sources: Column) -> Column:
    """Numbered sources with citation and content, for a model's context."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["citation"], F.lit("\n"), s["content"])), "\n\n")


def cache_key(*parts: Column, digits: int = 24) -> Column:
    """Leading hex digits of the digest of a JSON list."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, digits)


def excerpt(c: Column, limit: int = 8000) -> Column:
    """The first ``limit`` characters: what a judge is shown of a section."""
    return F.substring(c, 1, limit)


def relative_path(c: Column, root: str) -> Column:
    """A path without ``root`` before it."""
    return F.when(F.startswith(c, F.lit(root)), F.substr(c, F.lit(len(root) + 1))).otherwise(c)


def is_reasoning_model(c: Column) -> Column:
    """Whether a model's name is that of a reasoning model: an o and a digit."""
    return F.lower(strip(c)).rlike("^o[0-9]")
