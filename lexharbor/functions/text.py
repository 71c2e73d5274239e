"""Text expressions: pure column functions, so Catalyst can push, prune and generate code for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it; spelled out because Java's \\s and trim() differ.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"
#: The same characters one by one.
_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Letters, letter numbers and other numbers: Java's own \\w minus digits would differ on combining marks.
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
#: Fixed by the data: the word class of the language vote.
VOTE_WORD = r"[a-zA-ZÀ-ÿ]+"


def once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """The kept columns and new ones that are computed once a row.  The optimizer writes a column's expression into every later use
    of it: into filters, which it moves below the select, and into lambdas, where it is then computed for every element.
    It does neither through a generator, here of one row; below that stands a select, where equal parts are computed
    once."""
    new = df.select(*keep, *columns)
    return new.select(*keep, F.inline(F.array(F.struct(*new.columns[len(keep) :]))))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACES}]+", ""), f"[{SPACES}]+$", "")


def _plain_spaces(text: Column) -> Column:
    """All white space as one character: Java matches a negated class with members beyond Latin-1 about six times slower
    than one of a single character.  translate() looks every character up, so it is left to texts with characters in the
    range of the wide spaces."""
    latin = "".join(f"\\x{ord(c):02x}" for c in _SPACE_CHARS if c != " " and ord(c) < 256)
    return F.when(text.rlike(r"[\x{1680}-\x{3000}]"), F.translate(text, _SPACE_CHARS, " " * len(_SPACE_CHARS))).otherwise(F.regexp_replace(text, f"[{latin}]", " "))


def word_count(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.coalesce(F.regexp_count(_plain_spaces(text), F.lit("[^ ]++")), F.lit(0))


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case letter runs with the long s made an s; the length counts after that."""
    return F.filter(F.transform(letter_runs(text), folded), lambda t: F.length(t) >= least)


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTERS), 0)


def folded(word: Column) -> Column:
    """replace() and not translate(), which looks every character up."""
    return F.replace(F.lower(word), F.lit("ſ"), F.lit("s"))


def vote_words(text: Column, most: int = 400) -> Column:
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(VOTE_WORD), 0), 1, most), F.lower)


def shingles(words: Column, n: int = 5) -> Column:
    """Runs of n words joined by a space; none for shorter texts."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    """NULL where the text is no date of the form (ANSI mode would raise)."""
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def valid_date(text: Column, year: Column) -> Column:
    return F.coalesce((F.length(text) == 10) & (F.year(parse_date(text)) == year), F.lit(False))


def scan_name(name: Column) -> Column:
    """date, page, edition and lccn of an archive member's name; NULL if it has another form.  The edition is what
    follows the eight date digits in the last part but one, where there are five parts."""
    base = basename(name)
    parts = F.split(F.regexp_replace(base, r"\.json$", ""), "_")
    ok = base.rlike(r"^\d{4}-\d{2}-\d{2}_p\d+_.*\.json$")
    edition = F.when(F.size(parts) >= 5, F.substring(F.element_at(parts, -2), 9, 1000)).otherwise("")
    lccn = F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise("")
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("date"), F.get(parts, F.lit(1)).alias("page"), edition.alias("edition"), lccn.alias("lccn")))


PAGE_PATH = r"(?:^|/)(sn\d+|[a-z]{1,3}\d+)/(\d{4})/(\d{2})/(\d{2})/ed-(\d+)/seq-(\d+)/ocr\.txt$"


def page_path(path: Column) -> Column:
    """lccn, year, month, day, edition and sequence of a page's path; NULL if it has another form."""
    part = lambda i, n: F.regexp_extract(path, PAGE_PATH, i).alias(n)
    names = ("lccn", "year", "month", "day", "edition", "seq")
    return F.when(path.rlike(PAGE_PATH), F.struct(*[part(i + 1, n) for i, n in enumerate(names)]))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def tei_year(xml: Column) -> Column:
    return F.regexp_extract(xml, r'<date type="publication">\s*(\d{4})', 1).try_cast("int")


def tei_body(xml: Column) -> Column:
    """Text of a TEI file: after the first <text, without running heads, with line-end hyphens joined, without tags.
    Character references stay; see unescape()."""
    at = F.locate("<text", xml)
    body = F.when(at > 0, F.substring(xml, at + 5, F.length(xml))).otherwise(xml)
    body = F.regexp_replace(body, r"(?s)<fw\b[^>]*>.*?</fw>", " ")
    body = F.regexp_replace(body, r"[-¬]\s*<lb\s*/>\s*", "")
    return strip_tags(body)


def unescape(text: Column) -> Column:
    """HTML character references become characters; the value of a text without any stays as it is."""

    @F.pandas_udf("string")
    def rest(s):
        import html

        return s.map(html.unescape, na_action="ignore")

    return F.when(text.rlike(r"&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)"), rest(text)).otherwise(text)


def literal_fields(value: Column, names: tuple[str, ...]) -> Column:
    """Fields of a dictionary written in Python's notation (None, single or double quotes, escapes), as a struct of
    strings; NULL where a field is missing or None, or the text is no dictionary."""

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def fields(s):
        import ast

        import pandas as pd

        def one(x):
            try:
                m = ast.literal_eval(x) if x else {}
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                m = {}
            get = m.get if isinstance(m, dict) else {}.get
            return [None if get(n) is None else str(get(n)) for n in names]

        return pd.DataFrame([one(x) for x in s], columns=list(names), dtype=object)

    return fields(value)


def tei_file_year(name: Column) -> Column:
    """The year in the name of a TEI file, 9999 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"_(\d{4})\d*\.TEI", 1).try_cast("int"), F.lit(9999))


def word_like_share(text: Column) -> Column:
    """Our own measure: the share of white-space words that are letters with at most edge punctuation."""
    plain = _plain_spaces(text)
    words = F.regexp_count(plain, F.lit("[^ ]++"))
    # Possessive: what stands after each part can't begin in the part itself, so going back never helps.
    like = F.regexp_count(plain, F.lit(r"(?:^| )\p{P}*+\p{L}++(?:['’-]\p{L}++)*+\p{P}*+(?![^ ])"))
    return F.coalesce(like / F.nullif(words, F.lit(0)), F.lit(float("nan")))


def safe_year(value: Column) -> Column:
    """int(float(value)), NULL where that fails."""
    number = F.trim(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))


def hash_fraction(key: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the key's SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def stable_shard(key: Column, n: int) -> Column:
    """The key's SHA-1, as a 160-bit number, modulo n: folded digit by digit so that nothing overflows."""
    digits = F.transform(F.split(F.sha1(key), "(?!$)"), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, h: (a * 16 + h) % n)


def meta_json(*columns: Column) -> Column:
    """JSON with the given (sorted) columns, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
