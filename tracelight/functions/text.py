"""Text tests as SQL expressions that Spark and other ANSI engines share.

An operator's condition is written once, as SQL over the columns `line` and `lower`, with string
constants between two marks; spark() and ansi() put the constants and three function names into
each engine's spelling. Spark gets the expression as an ordinary Column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CONSTANT = re.compile("\x01(.*?)\x02", re.S)
#: One of several constants is contained: what is searched, and the constants.
_ANY = re.compile("\x03(.*?)\x04((?:\x01.*?\x02)+)\x05", re.S)
#: Names that differ: Spark's and the other spelling.
_NAMES = {"rx": ("regexp_like", "regexp_matches"), "octets": ("octet_length", "strlen"), "chars": ("char_length", "length"), "rxcount": ("regexp_count", "rxcount"), "epoch": ("unix_timestamp", "epoch")}


def s(value: str) -> str:
    """A string constant."""
    return f"\x01{value}\x02"


def replaced(of: str, pattern: str, by: str = "") -> str:
    """of with all matches of the pattern replaced."""
    return f"regexp_replace({of}, {s(pattern)}, {s(by)}@all)"


def group(of: str, pattern: str, n: int = 1) -> str:
    """The n-th group of the pattern's first match; empty where it doesn't match."""
    return f"regexp_extract({of}, {s(pattern)}, {n})"


def _one_of(sql: str, form) -> str:
    return _ANY.sub(lambda m: form(m[1], _CONSTANT.findall(m[2])), sql)


def _contains_one(of: str, texts: list[str]) -> str:
    """Plain searches one after another, which are far cheaper than an alternation; of is computed once.

    A lambda here reads nothing but its variables: the optimizer puts a column's whole expression in its place, and it
    numbers variables from 0, so that a lambda that reads the column 1 of a session seems not to read it. Such a
    condition goes to a join's side without that column.
    """
    needles = ", ".join(map(s, texts))
    return f"exists(array({of}), hay -> exists(array({needles}), needle -> contains(hay, needle)))"


#: A pattern given as a constant, and one that is a single class of characters, whose matches are counted.
_PATTERN = re.compile("((?:@rx|@rxcount|regexp_extract|regexp_replace)\\([^\x01\x02]*, \x01)(.*?)(?=\x02)", re.S)
_COUNTED_CLASS = re.compile(r"@rxcount\((\w+), \x01\[(\^?)((?:\\.|[^\\\[\]&]|&(?!&))+)\]\x02\)", re.S)
_CLASS = re.compile(r"(\\.)|\[(\^?)((?:\\.|[^\\\[\]&]|&(?!&))+)\]", re.S)
_RANGE = re.compile(r"(\\.)|([a-z])-([a-z])|([A-Z])-([A-Z])|([0-9])-([0-9])", re.S)


def _spelled(m: re.Match) -> str:
    ends = [x for x in m.groups()[1:] if x]
    return m[0] if m[1] else "".join(map(chr, range(ord(ends[0]), ord(ends[1]) + 1)))


def spelled_out(pattern: str) -> str:
    """The pattern with ranges of letters and digits in classes as single characters: Java looks these up in one table, and tests ranges one by one."""
    return _CLASS.sub(lambda m: m[0] if m[1] else f"[{m[2]}{_RANGE.sub(_spelled, m[3])}]", pattern)


def spark_sql(sql: str) -> str:
    sql = _one_of(sql, _contains_one)
    # The characters of a class are what is left without the runs of others; no list of matches is made.
    sql = _COUNTED_CLASS.sub(lambda m: f"char_length(regexp_replace({m[1]}, {s('[' + ('' if m[2] else '^') + m[3] + ']+')}, {s('')}))", sql)
    sql = _PATTERN.sub(lambda m: m[1] + spelled_out(m[2]), sql)
    sql = sql.replace("@all", "")
    for name, (own, _) in _NAMES.items():
        sql = sql.replace(f"@{name}(", f"{own}(")
    return _CONSTANT.sub(lambda m: "'" + m[1].replace("\\", "\\\\").replace("'", "\\'") + "'", sql)


def ansi_sql(sql: str) -> str:
    sql = _one_of(sql, lambda of, texts: matches("|".join(map(quote, texts)), of))
    sql = re.sub(r"@rxcount\(([^,]+), (\x01.*?\x02)\)", r"len(regexp_extract_all(\1, \2))", sql, flags=re.S)
    sql = sql.replace("@all", ", 'g'")
    for name, (_, other) in _NAMES.items():
        sql = sql.replace(f"@{name}(", f"{other}(")
    return _CONSTANT.sub(lambda m: "'" + m[1].replace("'", "''") + "'", sql)


def column(sql: str) -> Column:
    return F.expr(spark_sql(sql))


def ascii_lower(c) -> Column:
    """Lower case of A-Z alone; other letters stay."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def lowered(sql: str) -> str:
    return f"translate({sql}, {s(ASCII_UPPER)}, {s(ASCII_LOWER)})"


def quote(text: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$/-])", r"\\\1", text)


def both(*tests: str) -> str:
    return "(" + " AND ".join(tests) + ")"


def either(*tests: str) -> str:
    return "(" + " OR ".join(tests) + ")"


def no(test: str) -> str:
    return f"(NOT {test})"


def matches(pattern: str, of: str = "lower") -> str:
    return f"@rx({of}, {s(pattern)})"


def has(text: str, of: str = "lower") -> str:
    return f"contains({of}, {s(text)})"


def any_of(texts, of: str = "lower") -> str:
    """Some of texts is contained."""
    texts = list(texts)
    return has(texts[0], of) if len(texts) == 1 else f"\x03{of}\x04{''.join(map(s, texts))}\x05"


def all_of(texts, of: str = "lower") -> str:
    return both(*[has(t, of) for t in texts])


def starts(texts, of: str = "lower") -> str:
    return matches("^(" + "|".join(map(quote, texts)) + ")", of)


def token(*tokens: str, of: str = "lower") -> str:
    """Some token stands between characters that are none of A-Z, a-z, 0-9 and _. Only texts that hold one of several at all are matched."""
    found = matches("(^|[^a-zA-Z0-9_])(" + "|".join(map(quote, tokens)) + ")($|[^a-zA-Z0-9_])", of)
    return both(any_of(tokens, of), found) if len(tokens) > 2 else found


def tokens(*names: str, of: str = "lower") -> str:
    return both(*[token(t, of=of) for t in names])


def token_count(names, of: str = "lower") -> str:
    return "(" + " + ".join(f"CASE WHEN {token(t, of=of)} THEN 1 ELSE 0 END" for t in names) + ")"


def count_of(texts, of: str = "lower") -> str:
    """How many of texts are contained."""
    return "(" + " + ".join(f"CASE WHEN {has(t, of)} THEN 1 ELSE 0 END" for t in texts) + ")"


def keyword_pattern(keyword: str) -> str:
    """A keyword needs a boundary at each end that is a word character."""
    if "://" in keyword:
        return quote(keyword)
    left = "(^|[^a-zA-Z0-9_])" if re.match(r"[a-z0-9_]", keyword) else ""
    right = "($|[^a-zA-Z0-9_])" if re.search(r"[a-z0-9_]$", keyword) else ""
    return left + quote(keyword) + right


def keyword(keywords, of: str = "lower") -> str:
    return both(any_of(keywords, of), matches("|".join(map(keyword_pattern, keywords)), of))


def first_keyword(keywords, of: str = "lower") -> str:
    """The first of keywords, in their order, that is found; else null."""
    found = "CASE " + " ".join(f"WHEN {both(has(k, of), matches(keyword_pattern(k), of))} THEN {s(k)}" for k in keywords) + " END"
    return f"CASE WHEN {any_of(keywords, of)} THEN {found} END"


def host_in(hosts, of: str) -> str:
    """The host is one of hosts or below it."""
    return matches(r"(^|\.)(" + "|".join(map(quote, hosts)) + ")$", of)


def ordered(rules) -> str:
    """The name of the first rule that holds; else null. rules: (name, test)."""
    return "CASE " + " ".join(f"WHEN {test} THEN {s(name)}" for name, test in rules) + " END"


#: Words between white space.
WORDS = r"@rxcount(lower, " + s(r"\S+") + ")"
URL_SCHEME = any_of(["http://", "https://", "ftp://"])


def with_steps(df: DataFrame, steps) -> DataFrame:
    """df with each (name, expression) of steps as a column, in turn.

    Steps that don't build on each other are made together, by a generator of one row: the
    optimizer doesn't copy an expression past it into every condition that reads the column.
    """
    together: list[tuple[str, str]] = []

    def made(df):
        return df.select("*", F.inline_outer(F.array(F.struct(*[column(sql).alias(name) for name, sql in together]))))

    for name, sql in steps:
        if any(re.search(rf"\b{own}\b", _CONSTANT.sub("", sql)) for own, _ in together):
            df, together = made(df), []
        together.append((name, sql))
    return made(df) if together else df


def steps_sql(source: str, steps) -> str:
    """The same as a nested SELECT over source, a table or a parenthesised query."""
    for name, sql in steps:
        source = f"(SELECT *, {ansi_sql(sql)} AS {name} FROM {source})"
    return source
