"""Text columns: whitespace, HTML, sections of a description, years of experience, safe path names.

Everything is built-in expressions, so it stays in the JVM; nothing here needs a shuffle.
"""
from __future__ import annotations

import html.entities
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspan import vocab

# Characters that count as whitespace in every language's text (built-in trim knows only the space).
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)
SPACE_RUN = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Non-text markup, then tags; both become a cut between text pieces.
HIDDEN_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>"
CUT = "\x01"
NAMED_ENTITIES = json.dumps({name: char for name, char in html.entities.html5.items() if name.endswith(";")})
FREQUENT_ENTITIES = ["nbsp", "amp", "lt", "gt", "quot", "apos", "rsquo", "lsquo", "ldquo", "rdquo", "ndash", "mdash", "bull", "middot", "hellip",
                     "copy", "reg", "trade", "eacute"]  # tried before the whole table, which is searched one by one
_SMART = ("‘’‚‛“”„‟\xa0", "''''\"\"\"\" ")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row however often it is used: a one-element transform."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def if_any(value: Column) -> Column:
    """A generator that keeps the row when the value is not null. Filtering on a computed column instead would have the
    optimizer push the filter down and compute the value twice."""
    return F.explode(F.array_compact(F.array(value)))


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def collapse_ws(col: Column) -> Column:
    return F.regexp_replace(col, SPACE_RUN, " ")


def norm_text(col: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return collapse_ws(F.lower(trim_ws(col)))


def blank_to_null(col: Column) -> Column:
    return F.nullif(trim_ws(col), F.lit(""))


def contains_any(col: Column, words: list[str]) -> Column:
    """True when any of the words is a substring."""
    return reduce(or_, (col.contains(w) for w in words), F.lit(False))


def literal(word: str) -> str:
    """A regex that matches the word itself; valid for Java and RE2."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def any_word(words: list[str], ignore_case: bool = True) -> str:
    """Pattern for any of the words between word boundaries; the words are trimmed first."""
    body = "|".join(literal(w.strip()) for w in words if w.strip())
    return ("(?i)" if ignore_case else "") + rf"\b(?:{body})\b"


def smart_quotes(col: Column) -> Column:
    """Curly quotes and hard spaces made plain; texts of ASCII alone and others without any skip the character-by-character pass."""
    return let(col, lambda c: F.when((F.octet_length(c) > F.length(c)) & c.rlike(f"[{_SMART[0]}]"), F.translate(c, *_SMART)).otherwise(c))


def decode_entities(col: Column) -> Column:
    """Numeric and named HTML entities (the standard's whole table), each decoded once."""
    table = F.from_json(F.lit(NAMED_ENTITIES), "map<string,string>")

    def decoded(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*;)", 1)
        dec = F.regexp_extract(piece, r"^#(\d{1,6});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,5});", 1)
        code = F.when(dec != "", F.hex(dec.try_cast("int"))).when(hexa != "", hexa)
        named = F.when(name == "", F.lit(None).cast("string"))
        for word in FREQUENT_ENTITIES:
            named = named.when(name == word + ";", html.entities.html5[word + ";"])
        named = named.otherwise(F.try_element_at(table, name))
        char = F.coalesce(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), named)
        rest = F.regexp_replace(piece, r"^#?[A-Za-z0-9]+;", "")
        return F.when(i == 0, piece).when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    return F.array_join(F.transform(F.split(col, "&", -1), decoded), "")


def html_to_text(col: Column, separator: str = "\n") -> Column:
    """Visible text of HTML: pieces between tags, trimmed, empties dropped, joined by the separator.

    Text without ``<`` passes unchanged; null gives "". Curly quotes and hard spaces are made plain.
    """
    def visible(cut: Column) -> Column:
        text = F.when(cut.contains("&"), decode_entities(cut)).otherwise(cut)
        return F.array_join(F.filter(F.transform(F.split(text, CUT, -1), trim_ws), lambda p: p != ""), separator)

    def shown(plain: Column) -> Column:  # hidden markup begins with one of these, so most texts have none to look for
        return F.when(plain.contains("<!--") | plain.contains("<s") | plain.contains("<S"),
                      F.regexp_replace(plain, HIDDEN_MARKUP, CUT)).otherwise(plain)

    # The mark for a cut is a control character, so texts lose it first.
    cut = F.regexp_replace(let(F.replace(col, F.lit(CUT), F.lit("")), shown), TAG, CUT)
    return smart_quotes(F.coalesce(F.when(col.contains("<"), let(cut, visible)).otherwise(col), F.lit("")))


def strip_tags(col: Column) -> Column:
    """Tags to spaces, whitespace collapsed and trimmed."""
    return trim_ws(collapse_ws(F.regexp_replace(col, "<[^>]+>", " ")))


def at_least(col: Column, n: int) -> Column:
    """The text when it is longer than n characters, else null."""
    return let(col, lambda text: F.when(F.length(text) > n, text))


# ------------------------------------------------------------------ sections
SECTION_PATTERNS = {
    "STOP": vocab.STOP_PATTERN,
    "requirements": vocab.REQUIREMENTS_PATTERN,
    "skills": vocab.SKILLS_PATTERN,
    "responsibilities": vocab.RESPONSIBILITIES_PATTERN,
}
SECTION_ORDER = ["requirements", "skills", "responsibilities"]


def header_class(
    line: Column,
    patterns: dict[str, str] = SECTION_PATTERNS,
    max_len: int = vocab.HEADER_MAX_LEN,
    ratio: float = vocab.HEADER_MATCH_RATIO,
) -> Column:
    """Class of a heading line, or null for content. The first match of a pattern must cover enough of the line;
    the patterns are tried in their order, so the stop headings come first."""
    def judge(core: Column) -> Column:
        size = F.length(core)
        out = F.when((size == 0) | (size > max_len), F.lit(None).cast("string"))
        for name, pattern in patterns.items():
            covered = F.length(F.regexp_substr(core, F.lit("(?i)" + pattern)))
            out = out.when(covered / size >= ratio, F.lit(name))
        return out

    return let(trim_ws(F.rtrim(trim_ws(line), F.lit(":"))), judge)


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK, -1)


def section_text(
    col: Column,
    patterns: dict[str, str] = SECTION_PATTERNS,
    order: list[str] = SECTION_ORDER,
    max_len: int = vocab.HEADER_MAX_LEN,
    ratio: float = vocab.HEADER_MATCH_RATIO,
    max_chars: int | None = None,
    html: bool = True,
) -> Column:
    """The parts of a description under wanted headings, in the given order; the plain text when there are none. The whole text
    unless ``max_chars`` is given.

    Linear in the text and without a shuffle: heading lines become a cut plus their class, content lines a mark plus their
    text; all are joined and split again at the cuts, so each segment starts with the class that holds for it.
    """
    def mark(line: Column) -> Column:
        content = F.concat(F.lit("\x02"), trim_ws(line))
        return let(
            header_class(line, patterns, max_len, ratio),
            lambda head: F.when(head.isNotNull(), F.concat(F.lit(CUT), head)).when(content != "\x02", content),
        )

    def bodies(segments: Column, key: str) -> Column:
        head = key + "\x02"
        own = F.filter(segments, lambda s: s.startswith(head))
        return F.transform(own, lambda s: F.replace(
            F.substring(s, F.lit(len(head) + 1), F.length(s)), F.lit("\x02"), F.lit(" ")))

    def chosen(plain: Column) -> Column:
        marked = F.array_join(F.array_compact(F.transform(split_lines(plain), mark)), "")
        parts = let(F.split(marked, CUT, -1), lambda segs: F.flatten(F.array(*[bodies(segs, k) for k in order])))
        return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), plain)

    plain = html_to_text(col) if html else F.coalesce(col, F.lit(""))
    # The marks of lines and cuts are control characters, so texts lose them first.
    plain = F.replace(F.replace(plain, F.lit(CUT), F.lit("")), F.lit("\x02"), F.lit(""))
    out = let(plain, chosen)
    return F.substring(out, 1, max_chars) if max_chars else out


def embed_text(title: Column, parsed: Column, max_chars: int | None = None) -> Column:
    """Title, blank line, selected text; null when nothing but whitespace is left."""
    text = F.concat(
        F.coalesce(F.concat(F.nullif(title, F.lit("")), F.lit("\n\n")), F.lit("")), parsed)
    text = F.substring(text, 1, max_chars) if max_chars else text
    return let(text, lambda t: F.when(trim_ws(t) != "", t))


# ------------------------------------------------------------------ years of experience
def extract_years(
    col: Column,
    pattern: str = vocab.YEARS_PATTERN,
    sub_pattern: str = vocab.SUB_YEARS_PATTERN,
    low: int = 1,
    high: int = 20,
) -> Column:
    """First year count in range that is not also stated as a sub-requirement; the first of all when every one is."""
    def values(p: str) -> Column:
        found = F.transform(F.regexp_extract_all(col, F.lit("(?i)" + p), F.lit(1)), lambda v: v.cast("int"))
        return F.filter(found, lambda v: v.between(low, high))

    def first(every: Column) -> Column:
        main = let(values(sub_pattern), lambda sub: F.filter(every, lambda v: ~F.array_contains(sub, v)))
        return F.when(F.size(every) > 0, F.coalesce(F.get(main, F.lit(0)), F.get(every, F.lit(0))))

    return let(values(pattern), first)


# ------------------------------------------------------------------ paths
def path_safe(col: Column, max_chars: int = 100) -> Column:
    """A name usable as a path segment."""
    return F.substring(collapse_ws(F.regexp_replace(trim_ws(col), r'[<>:"/\\|?*]', "")), 1, max_chars)


def description_path(company: Column, title: Column, key: Column) -> Column:
    short = F.when(F.coalesce(key.cast("string"), F.lit("")) != "", F.substring(F.sha1(key.cast("string")), 1, 12))
    return F.concat(
        F.lit("descriptions/"), path_safe(company), F.lit("/"), path_safe(title), F.lit("_"),
        F.coalesce(short, F.lit("x")), F.lit(".txt"),
    )


def chunk_path(company: Column, title: Column, job_id: Column, index: Column) -> Column:
    return F.concat(
        F.lit("chunks/"), path_safe(company), F.lit("/"), path_safe(title), F.lit("_"), job_id.cast("string"),
        F.lit("_chunk_"), index.cast("string"), F.lit(".txt"),
    )
