"""Text functions as Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation classes of display text and the particles that stay joined to the word before them.
CLOSING = ".,!?;:%…)]}»”"
OPENING = "([{«“"
AMBIGUOUS_QUOTES = "\"'’"
TERMINAL = ".!?…"
GUARD = "\u2060"
HYPHEN_PARTICLES = ("то", "либо", "нибудь", "ка", "таки", "де", "с")

SENTENCE_END = r"[.!?…][\"'»”’)]*$"
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@cache
def _folds() -> dict[str, str]:
    """What folding makes of characters in lower case, where that is another text, by the rules of this Python's Unicode."""
    return {c: c.casefold() for c in map(chr, range(0x80, 0x1E944)) if c == c.lower() != c.casefold()}


def folded(text: Column) -> Column:
    """Case folded, as `str.casefold` does it: lower case, and ß as ss, both sigmas as one, ligatures apart.

    Characters that fold to one other are translated; the few that fold to several are replaced, in texts that have one.
    """
    one = {c: f for c, f in _folds().items() if len(f) == 1}
    many = {c: f for c, f in _folds().items() if len(f) > 1}
    single = F.translate(F.lower(F.translate(text, "Σ", "σ")), "".join(one), "".join(one.values()))  # a capital sigma's lower case depends on its place
    parts = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    apart = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(parts[c], c)), "")
    return F.when(single.rlike("[" + "".join(many) + "]"), apart).otherwise(single)


def compact(text: Column) -> Column:
    """Folded letters and digits only, ё as е: the key by which text and words are aligned."""
    return F.regexp_replace(F.translate(folded(text), "ё", "е"), r"[^\p{L}\p{N}]", "")


def tokens(text: Column) -> Column:
    """Lower-cased words: letters and digits, with apostrophes and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def visible_length(text: Column) -> Column:
    """Characters, a line break counting as one space."""
    return F.length(F.regexp_replace(text, r"\R", " "))


def stripped_visible_length(text: Column) -> Column:
    """Characters after each line is trimmed."""
    return F.length(F.array_join(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), " "))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def is_closing(text: Column) -> Column:
    return text.rlike(r"^[.,!?;:%…)\]}»”]+$")


def is_opening(text: Column) -> Column:
    return text.rlike(r"^[(\[{«“]+$")


def is_hyphen_suffix(text: Column) -> Column:
    return text.rlike(r"(?iu)^-(" + "|".join(HYPHEN_PARTICLES) + r")[^\p{L}\p{N}_]*$")


def is_vocalisation(text: Column) -> Column:
    """At least two hyphens."""
    return F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit(""))) >= 2


def bare_token(text: Column) -> Column:
    """Lower-cased, without the punctuation around it."""
    return F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def split_embedded_sentences(text: Column) -> Column:
    """A space after a sentence end that is glued to the next sentence."""
    return F.regexp_replace(text, r"([.!?…][\"'»”’)]*)(?=[A-ZА-ЯЁ«“\"(\[])", "$1 ")


def tail(text: Column, n: int = 200) -> Column:
    return F.right(text, F.lit(n))


def vtt_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def vtt_unescape(text: Column) -> Column:
    """Null where a reference is unknown or markup is left."""
    plain = F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.when(~F.regexp_replace(text, "&(amp|lt|gt);", "").rlike("[&<>]"), plain)


def ass_escape(text: Column) -> Column:
    """A backslash is followed by a guard (the word joiner, which is doubled itself), braces come after a backslash, line breaks are \\N."""
    out = F.regexp_replace(F.replace(text, F.lit(GUARD), F.lit(GUARD * 2)), r"\r\n?", "\n")
    for mark, escaped in (("\\", "\\" + GUARD), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        out = F.replace(out, F.lit(mark), F.lit(escaped))
    return out


def ass_unescape(text: Column) -> Column:
    """The inverse of `ass_escape`; null where a brace or a guard stands alone, or a backslash before anything else."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\\{{}}{GUARD}]+|{GUARD}{GUARD}|\\[{GUARD}{{}}N]"), 0)
    plain = lambda p: F.when(p == "\\N", "\n").when(p == "\\" + GUARD, "\\").when(F.startswith(p, F.lit("\\")) | F.startswith(p, F.lit(GUARD)), F.right(p, F.lit(1))).otherwise(p)
    return F.when(F.array_join(parts, "") == text, F.array_join(F.transform(parts, plain), ""))


def join_words(words: Column) -> Column:
    """Words with a space between them, but none before closing marks."""
    return F.ltrim(F.array_join(F.transform(words, lambda w: F.when(is_closing(w), w).otherwise(F.concat(F.lit(" "), w))), ""))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is made once; where a lambda names an expression, it is made for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column, block: int = 16) -> Column:
    """Sums of an array of integers up to each element: within blocks, then of blocks, so that a long array is not summed once per element."""

    def upto(x: Column) -> Column:
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, n: a + n))

    def within(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int"))
        return bound(F.transform(starts, lambda k: F.transform(F.array(F.slice(x, k * block + 1, block)), upto)[0]), joined)

    def joined(parts: Column) -> Column:
        before = F.transform(parts, lambda p: F.element_at(p, -1))
        return bound(F.aggregate(before, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)), lambda sums: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.get(sums, k)))))

    return bound(numbers, lambda x: F.when(F.size(x) > block, within(x)).otherwise(upto(x)))


def join_glued(words: Column) -> Column:
    """Words with a space between them, but none after one that ends in a hyphen."""

    def joined(w: Column) -> Column:
        return F.array_join(F.transform(w, lambda x, i: F.when((i == 0) | F.get(w, i - 1).endswith("-"), x).otherwise(F.concat(F.lit(" "), x))), "")

    return bound(words, joined)


def ngrams(words: Column, n: int) -> Column:
    """Sliding n-grams as 64-bit hashes of their words' hashes; none for shorter arrays."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # transform over one element binds the hashes, so that they are made once
    bound = F.transform(F.array(hashes), lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])))
    return F.get(bound, F.lit(0))


def repeated_ngrams(words: Column, n: int) -> Column:
    """How many n-grams are there beyond the first of their kind."""
    grams = ngrams(words, n)
    return F.size(grams) - F.size(F.array_distinct(grams))


def optional_text(text: Column) -> Column:
    """Without blanks around, or null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def json_field(document: Column, name: str) -> Column:
    """A top-level field of a JSON object as text, or null."""
    return F.get_json_object(document, f"$.{name}")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole of what a shell pattern matches: ``*``, ``?``, ``[ab]``, ``[!ab]``; case counts."""
    out, at = "", 0
    while at < len(glob):
        c, at = glob[at], at + 1
        end = glob.find("]", at + (glob[at : at + 1] == "!") + 1) if c == "[" else -1
        if c == "[" and end > 0:
            inside = glob[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out, at = out + "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]", end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and ord(c) < 128 else c
    return f"(?s)\\A(?:{out})\\z"


def matches_any(name: Column, globs: tuple[str, ...]) -> Column:
    """Does a name match one of the shell patterns? None matches nothing."""
    return name.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def safe_relative(path: Column) -> Column:
    """A path inside a folder, with slashes only; null for one that is absolute, has a drive, goes up, or names nothing."""
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    bad = F.startswith(slashed, F.lit("/")) | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def output_name(path: Column, fmt: str) -> Column:
    """The subtitle's path beside its source; SRT has no format in its name."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(".srt" if fmt == "srt" else f".{fmt}.{fmt}"))


def duration_label(seconds: Column) -> Column:
    """h:mm:ss or m:ss, rounded half up."""
    s = F.floor(seconds + 0.5).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON; nulls count."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
