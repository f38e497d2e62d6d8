"""Text functions as Catalyst expressions: pattern counts, the structural fingerprint, names, truncation."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the structural features, as the survey gives them: their behaviour is fixed.
#: They lie in the common subset of Java and RE2; see ``java`` for the flags that Java needs.
DATE = r"\b\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b|\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4}\b"
AMOUNT = r"[$€£¥]\s*[,\d]+\.?\d*|\b\d{1,3}(?:,\d{3})+(?:\.\d{2})?\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"\b(?:\+?\d{1,3}[-\s]?)?\(?\d{2,4}\)?[-\s]?\d{3,4}[-\s]?\d{3,4}\b"
URL = r"https?://\S+"
KEY_VALUE = r"^(.{2,40})\s*[:=]\s*(.+)$"
HEADER = r"^(?:#{1,4}\s+.+|[A-Z][\sA-Z]{2,40}$)"
#: Pattern and flags of each structural feature.
PATTERNS = {"dates": (DATE, "i"), "amounts": (AMOUNT, ""), "emails": (EMAIL, ""), "phones": (PHONE, ""), "urls": (URL, ""), "kv": (KEY_VALUE, "m"), "headers": (HEADER, "m")}
#: What a text must contain for a pattern to match anywhere; texts without it are never searched.
_NEEDS = {"emails": ("@",), "urls": ("://",), "kv": (":", "=")}
FEATURES = [f"f{i:02d}" for i in range(18)]


def java(pattern: str, flags: str = "") -> str:
    """UNIX_LINES and Unicode classes make Java match as Python's ``re`` does."""
    return f"(?dU{flags}){pattern}"


def pattern_count(text: Column, name: str) -> Column:
    pattern, flags = PATTERNS[name]
    found = F.regexp_count(text, F.lit(java(pattern, flags)))
    if name not in _NEEDS:
        return found
    held = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in _NEEDS[name]))
    return F.when(held, found).when(text.isNotNull(), 0)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def table_lines(text: Column) -> Column:
    """Lines with at least two tabs or two pipes."""
    counted = F.size(F.filter(F.split(text, "\n", -1), lambda x: (occurrences(x, "\t") >= 2) | (occurrences(x, "|") >= 2)))
    return F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("|")), counted).when(text.isNotNull(), 0)


def fingerprinted(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` and the 18 features as ``f00`` to ``f17``; null or empty text is all zeros.

    A first projection counts, each pattern once; the features are a second one over the
    counts, which the optimizer doesn't fold into the first.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    counts = {k: pattern_count(t, k) for k in PATTERNS} | {
        "table": table_lines(t), "chars": F.char_length(t), "lines": occurrences(t, "\n") + 1, "words": F.regexp_count(t, F.lit(r"(?U)\S+")), "paragraphs": occurrences(t, "\n\n"),
    }
    counted = docs.select(*keep, *(c.alias(f"count_{k}") for k, c in counts.items()))
    n = {k: F.col(f"count_{k}") for k in counts}
    share = lambda k: F.least(n[k] / n["lines"], F.lit(1.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [
        F.least(n["chars"] / 10000, F.lit(5.0)), F.when(n["chars"] > 0, F.least(n["lines"] / 100, F.lit(5.0))).otherwise(0.0), F.least(n["words"] / 2000, F.lit(5.0)),
        *(share(k) for k in ("dates", "amounts", "emails", "phones", "urls", "kv")), F.least(n["headers"] / 10.0, F.lit(1.0)), share("table"),
        F.when(n["paragraphs"] > 0, F.least((n["paragraphs"] + 1) / n["lines"], F.lit(1.0))).otherwise(0.0),
        *(flag(n[k] > 0) for k in ("dates", "amounts", "emails", "table", "headers")), flag(n["kv"] > 3),
    ]
    return counted.select(*keep, *(v.alias(f) for f, v in zip(FEATURES, values)))


def normalized(features: list[Column]) -> list[Column]:
    """Divided by their Euclidean norm; a zero vector stays."""
    norm = F.sqrt(sum((f * f for f in features[1:]), features[0] * features[0]))
    return [(f / F.when(norm == 0, 1.0).otherwise(norm)).alias(name) for f, name in zip(features, FEATURES)]


def smart_truncate(text: Column, most: int = 2000) -> Column:
    """Head, middle and tail of a long text."""
    part, half = most // 3, most // 3 // 2
    n = F.char_length(text)
    middle = F.substr(text, F.floor(n / 2).cast("int") - half + 1, F.lit(2 * half))
    cut = F.concat(F.substring(text, 1, part), F.lit("\n...\n"), middle, F.lit("\n...\n"), F.substr(text, n - part + 1, F.lit(part)))
    return F.when(n <= most, text).otherwise(cut)


#: Names of plain words with a space between: only letters' case and the spaces change.
_PLAIN = "^(?:[A-Z0-9]+[a-z0-9]*|[a-z0-9]+)(?: (?:[A-Z0-9]+[a-z0-9]*|[a-z0-9]+))*$"


def field_name(name: Column) -> Column:
    """A name's normal form: snake case of ``[a-z0-9_]``."""
    x = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), "([a-z])([A-Z])", "$1_$2")
    for pattern, by in ((r"[-.\s]+", "_"), ("[^a-z0-9_]", ""), ("_+", "_"), ("^_|_$", "")):
        x = F.regexp_replace(F.lower(x) if pattern.startswith("[-") else x, pattern, by)
    return F.when(name.rlike(_PLAIN), F.lower(F.replace(name, F.lit(" "), F.lit("_")))).otherwise(x)


@lru_cache(maxsize=10_000)
def plain_field_name(name: str) -> str:
    """``field_name`` of one string, for code that runs in Python anyway."""
    x = re.sub("([a-z])([A-Z])", r"\1_\2", re.sub(r"(?a)^\s+|\s+$", "", name)).lower()
    for pattern, by in ((r"(?a)[-.\s]+", "_"), ("[^a-z0-9_]", ""), ("_+", "_"), ("^_|_$", "")):
        x = re.sub(pattern, by, x)
    return x


def words_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two descriptions' lower-case words; 0 where either has none."""
    words = [F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != "")) for x in (a, b)]
    both = F.size(F.array_intersect(*words)).cast("double")
    return F.when((F.size(words[0]) == 0) | (F.size(words[1]) == 0), 0.0).otherwise(both / F.size(F.array_union(*words)))


def without_fences(reply: Column) -> Column:
    """A reply without its code-fence lines, if it begins with one."""
    return F.when(F.startswith(F.ltrim(reply), F.lit("```")), F.regexp_replace(reply, "(?m)^```.*$\n?", "")).otherwise(reply)


def value_type(value: Column) -> Column:
    """number, date, boolean or string, by the look of a value."""
    return (
        F.when(value.rlike(r"^[$€£]?-?[0-9][0-9,]*([.][0-9]+)?$"), "number")
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(F.lower(value).isin("true", "false", "yes", "no"), "boolean")
        .otherwise("string")
    )


def key_values(text: Column) -> Column:
    """Array of (line, name, value) of the lines with a key of 2 to 40 characters before their first ``:`` or ``=`` and a value after it."""
    # Places of the marks, not a split by them: a pattern would be compiled for each line.
    first = lambda x: F.when(F.contains(x, F.lit("=")), F.least(*(F.coalesce(F.nullif(F.instr(x, m), F.lit(0)), F.lit(1 << 30)) for m in ":="))).otherwise(F.instr(x, ":"))
    part = lambda x, i: F.struct(i.alias("line"), x.alias("x"), first(x).alias("cut"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), part), lambda x: x["cut"].between(3, 41))
    blank = F.lit(" \t\n\x0b\f\r")
    value = lambda x: F.trim(F.ltrim(F.substr(x["x"], x["cut"] + 1), blank))
    found = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.trim(F.substr(x["x"], F.lit(1), x["cut"] - 1)).alias("name"), value(x).alias("value")))
    return F.filter(found, lambda x: (x["name"] != "") & (x["value"] != ""))
