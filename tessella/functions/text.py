"""Text functions as column expressions: tokens, stems, counts, templates, URLs, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never help matching (our own list).
STOPWORDS = tuple("a an and are as at be been but by can could did do does for from had has have he her him his how i if in is it its me my no not of on or our she so that the their them then there they this to up us was we were what when where which who why will with would you your".split())
MAX_TOKEN = 32
VOWELS = "[aeiouy]"


def let(value: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; apostrophes between letters are dropped first."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(\p{L})['’](\p{L})", "$1$2")
    return F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_noise(token: Column) -> Column:
    """Tokens that are not indexed: one character, over-long, stopwords, numbers, hash-like."""
    return (F.length(token) < 2) | (F.length(token) > MAX_TOKEN) | token.isin(*STOPWORDS) | token.rlike(r"^\d+$") | token.rlike(r"^(?=.*\d)[a-z0-9]{16,}$")


def _undouble(base: Column) -> Column:
    n = F.length(base)
    last = F.substring(base, -1, 1)
    same = (n >= 3) & F.endswith(base, F.concat(last, last)) & ~F.substring(base, -2, 2).isin("ll", "ss", "zz", "ff") & ~last.rlike(VOWELS)
    return F.when(same, F.substring(base, F.lit(1), n - 1)).otherwise(base)


def _less(word: Column, k: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - k)


def stem(token: Column) -> Column:
    """Strips one English inflection (s, es, ies, ing, ed, ied, ly) and a final e; short tokens and those with digits stay."""
    n = F.length(token)
    stripped = (
        F.when(token.rlike("(ies|ied)$") & (n >= 5), F.concat(_less(token, 3), F.lit("y")))
        .when(token.rlike("ing$") & (n >= 6), F.when(_less(token, 3).rlike(VOWELS), _undouble(_less(token, 3))).otherwise(token))
        .when(token.rlike("[^e]ed$") & (n >= 5), F.when(_less(token, 2).rlike(VOWELS), _undouble(_less(token, 2))).otherwise(token))
        .when(token.rlike("ly$") & (n >= 6), _less(token, 2))
        .when(token.rlike("([sxz]|ch|sh)es$") & (n >= 5), _less(token, 2))
        .when(token.rlike("s$") & ~token.rlike("(ss|us|is)$") & (n >= 4), _less(token, 1))
        .otherwise(token)
    )
    final = lambda s: F.when((F.length(s) >= 5) & F.endswith(s, F.lit("e")) & ~F.endswith(s, F.lit("ee")), _less(s, 1)).otherwise(s)
    return F.when((n <= 3) | token.rlike(r"\d"), token).otherwise(let(stripped, final))


def index_terms(token: Column) -> Column:
    """What is indexed for a token: its stem, and its surface form where that differs."""
    return F.array_distinct(F.array(stem(token), token))


def word_count(text: Column) -> Column:
    """Letter and digit runs; a contraction counts once."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+(['’]\p{L}+)*")).cast("long")


def caps_words(text: Column) -> Column:
    """Words of two letters and more, without digits: all of them, and those in capitals, as a struct (words, caps)."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.rlike(r"\p{N}"))
    shouted = F.filter(words, lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))
    return F.struct(F.size(words).cast("long").alias("words"), F.size(shouted).cast("long").alias("caps"))


def normalised(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "‘’“”", "''\"\""), r"\s+", " "))


def title_key(text: Column) -> Column:
    """Key under which titles count as equal."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def url_key(url: Column) -> Column:
    """URL without scheme, www., query, fragment and trailing slashes, in lower case."""
    out = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", "")
    for pattern in (r"^www\.", r"[?#].*$", r"/+$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def edit_ratio(a: Column, b: Column, limit: int = 4000) -> Column:
    """Levenshtein distance over the longer length, of at most `limit` characters each."""
    x, y = F.substring(a, 1, limit), F.substring(b, 1, limit)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 0.0).when((F.length(x) == 0) | (F.length(y) == 0), 1.0).otherwise(F.levenshtein(x, y) / longest)


def strip_variables(template: Column) -> Column:
    """Template text without its variables."""
    return F.regexp_replace(template, r"\{\{[^{}]*\}\}", "")


def list_variables(template: Column) -> Column:
    """Names of the variables, each once, in order of appearance."""
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*([A-Za-z0-9_]+)\s*(\|[^{}]*)?\}\}"), F.lit(1))
    return F.array_distinct(F.transform(names, F.lower))


def placeholder(name: str) -> str:
    """What stands for a variable without value."""
    return "[ENTER " + " ".join(name.replace("_", " ").split()).upper() + "]"


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fills {{name}} and {{name|fallback}}: value, else fallback, else a placeholder; blank values count as missing.

    The expression's size is that of `values`; variables that it doesn't name become their fallback, or a placeholder that keeps the name.
    """
    out = template
    for name, value in values.items():
        given = F.nullif(F.trim(value), F.lit(""))
        var = rf"(?i)\{{\{{\s*{name}\s*\}}\}}"
        fall = rf"(?i)\{{\{{\s*{name}\s*\|\s*([^{{}}]*?)\s*\}}\}}"
        safe = F.regexp_replace(given, r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(fall), F.coalesce(safe, F.lit("$1")))
        out = F.regexp_replace(out, F.lit(var), F.coalesce(safe, F.lit(placeholder(name))))
    out = F.regexp_replace(out, r"\{\{\s*[A-Za-z0-9_]+\s*\|\s*([^{}]*?)\s*\}\}", "$1")
    rest = F.regexp_extract_all(out, F.lit(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"), F.lit(1))
    filled = lambda t, name: F.regexp_replace(t, F.concat(F.lit(r"\{\{\s*"), name, F.lit(r"\s*\}\}")), F.concat(F.lit("[ENTER "), F.upper(F.regexp_replace(name, "_", " ")), F.lit("]")))
    return F.aggregate(F.array_distinct(rest), out, filled)


def placeholders(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[ENTER [^\]]+\]"), F.lit(0)))


def iban_ok(iban: Column) -> Column:
    """ISO 13616 check: letters are 10 to 35, the first four characters go last, modulo 97 is 1."""
    s = F.upper(F.regexp_replace(iban, r"[ \t]", ""))
    moved = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    left = F.aggregate(moved, F.lit(0), lambda r, c: F.when(value(c) >= 10, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97)
    return F.length(s).between(15, 34) & (left == 1)


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by underscores; Latin letters lose their marks."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "ß", "ss"), "æ", "ae"), "œ", "oe")
    plain = F.translate(plain, "àáâãäåāăąçćčďđèéêëēęěğìíîïīıłñńňòóôõöøōőřśşšţťùúûüūůűýÿźżž", "aaaaaaaaacccddeeeeeeegiiiiiilnnnoooooooorsssttuuuuuuuyyzzz")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def noise_word(token: str) -> bool:
    """is_noise for tasks that hold tokens as Python strings."""
    digits = [c for c in token if "0" <= c <= "9"]
    plain = all("0" <= c <= "9" or "a" <= c <= "z" for c in token)
    return len(token) < 2 or len(token) > MAX_TOKEN or token in STOPWORDS or len(digits) == len(token) or (len(token) >= 16 and plain and bool(digits))


def stem_word(token: str) -> str:
    """stem for tasks that hold tokens as Python strings."""
    n = len(token)
    if n <= 3 or any("0" <= c <= "9" for c in token):
        return token
    voiced = lambda s: any(c in "aeiouy" for c in s)
    single = lambda s: s[:-1] if len(s) >= 3 and s[-1] == s[-2] and s[-2:] not in ("ll", "ss", "zz", "ff") and s[-1] not in "aeiouy" else s
    s = token
    if token.endswith(("ies", "ied")) and n >= 5:
        s = token[:-3] + "y"
    elif token.endswith("ing") and n >= 6:
        s = single(token[:-3]) if voiced(token[:-3]) else token
    elif token.endswith("ed") and token[-3] != "e" and n >= 5:
        s = single(token[:-2]) if voiced(token[:-2]) else token
    elif token.endswith("ly") and n >= 6:
        s = token[:-2]
    elif token.endswith(("ses", "xes", "zes", "ches", "shes")) and n >= 5:
        s = token[:-2]
    elif token.endswith("s") and not token.endswith(("ss", "us", "is")) and n >= 4:
        s = token[:-1]
    return s[:-1] if len(s) >= 5 and s.endswith("e") and not s.endswith("ee") else s
