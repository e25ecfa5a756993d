"""Text rules of search, keys and references as Column expressions.

The order matters: camel case is cut first, on ASCII classes, then letters are folded, then what is not ASCII is
deleted (not blanked), then the rest is lower-cased and cut at everything else.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search by weight drops from queries.
LEXICAL_STOP = "a an and by describe find for from in of on or show the to which with".split()
#: Words that BM25 drops everywhere ("für" is never met, tokens being ASCII).
BM25_STOP = "a an and are as at bei by das der die ein eine for from für in is mit of on or the to und von with".split()
#: Tokens of names that say nothing about what a key belongs to.
GENERIC_KEY_TOKENS = "CD CODE D F ID KEY KY NO NR NUMBER T V".split()
#: Native type names by family.
FAMILIES = {
    "bool": "bit boolean",
    "binary": "binary image rowversion timestamp varbinary",
    "number": "bigint decimal float int integer money numeric real smallint smallmoney tinyint",
    "date": "date datetime datetime2 datetimeoffset smalldatetime time",
    "text": "char nchar ntext nvarchar text uniqueidentifier varchar",
}
#: Native types whose key segments compare as numbers.
NUMERIC_TYPES = "bigint decimal double float int integer numeric real smallint tinyint".split()
#: Families of Spark's own types; its names would be misread by the native rules (string, double, timestamp).
SPARK_FAMILIES = {"string": "text", "varchar": "text", "char": "text", "tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "number", "double": "number", "decimal": "number", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "boolean": "bool", "binary": "binary"}


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility form has one ASCII character, that character, and those that have several."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
        elif plain:
            longer[chr(code)] = plain
    return "".join(source), "".join(target), longer


def folded(value: Column) -> Column:
    """Camel case cut, letters folded to ASCII by compatibility forms, all else beyond ASCII deleted, lower case."""
    source, target, longer = _folds()
    cut = F.regexp_replace(value, "([a-z0-9])(?=[A-Z])", "$1 ")
    texts = F.map_from_arrays(F.split(F.lit("\x01".join(longer)), "\x01"), F.split(F.lit("\x01".join(longer.values())), "\x01"))
    spelt = F.replace(cut, F.lit("ß"), F.lit("ss"))
    # characters that become several are rare: one pass over the characters, in texts that have such; what is asked is asked of
    # the value itself, so that the text is cut and spelt once
    several = F.array_join(F.transform(F.split(spelt, ""), lambda c: F.coalesce(F.when(c > "\x7f", F.element_at(texts, c)), c)), "")
    # translate looks letters up by hash, a class of hundreds of letters would be tried one by one
    spelt = F.when(F.length(F.translate(value, "".join(longer), "")) < F.length(value), several).otherwise(spelt)
    plain = F.regexp_replace(F.translate(spelt, source, target), r"[^\x00-\x7F]", "")
    return F.when(value.rlike(r"[^\x00-\x7F]"), F.lower(plain)).otherwise(F.lower(cut))


def raw_tokens(value: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(value, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def bm25_tokens(value: Column) -> Column:
    """Tokens in order, stop words left out, repeats kept."""
    return F.filter(F.split(folded(F.coalesce(value, F.lit(""))), "[^a-z0-9]+"), lambda x: ~x.isin("", *BM25_STOP))


def singular(token: Column) -> Column:
    ies = (F.length(token) > 4) & token.endswith("ies")
    s = (F.length(token) > 3) & token.endswith("s") & ~token.rlike("(ss|us|is)$")
    return F.when(ies, F.concat(token.substr(F.lit(1), F.length(token) - 3), F.lit("y"))).when(s, token.substr(F.lit(1), F.length(token) - 1)).otherwise(token)


def lexical_tokens(value: Column) -> Column:
    """Distinct singular tokens."""
    return F.array_distinct(F.transform(raw_tokens(value), singular))


def query_terms(value: Column) -> Column:
    """Sorted distinct singular tokens of a query without stop words."""
    return F.sort_array(F.filter(lexical_tokens(value), lambda x: ~x.isin(*LEXICAL_STOP)))


def type_family(data_type: Column) -> Column:
    """bool, binary, number, date, text or unknown, of a native type name."""
    name = F.lower(F.substring_index(data_type, "(", 1))
    out = F.lit("unknown")
    for family, names in FAMILIES.items():
        out = F.when(name.isin(*names.split()), family).otherwise(out)
    return out


def is_numeric_type(data_type: Column) -> Column:
    return F.split(F.lower(F.trim(data_type)), r"[\s(]").getItem(0).isin(*NUMERIC_TYPES)


def normalized_name(name: Column) -> Column:
    """Lower case without a last id or key part and without underscores."""
    return F.replace(F.regexp_replace(F.lower(name), "(?:^|_)(?:id|key)$", ""), F.lit("_"), F.lit(""))


def normalized_value(value: Column, numeric: bool) -> Column:
    """A key segment as compared: trimmed, empty as null; numeric ones as whole numbers, others null."""
    text = F.trim(value.cast("string"))
    if not numeric:
        return F.when(text != "", text)
    number = F.when(text.rlike(r"^[+-]?[0-9]+([.]0*)?$"), F.regexp_replace(text, "[.]0*$", "")).cast("decimal(38,0)")
    return number.cast("string")


def normalized_reference(value: Column) -> Column:
    """A dotted reference without quotes and brackets, dots close up, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(value, '[]"`', ""), r"\s*\.\s*", ".")))


def same_reference(left: Column, right: Column) -> Column:
    """Whether the shorter dotted reference is the end of the longer."""
    a, b = F.reverse(F.split(normalized_reference(left), "[.]")), F.reverse(F.split(normalized_reference(right), "[.]"))
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def stable_id(namespace: Column, kind: str, value: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("\n", namespace, F.lit(kind), value), 256), 1, 24)
    return F.concat(F.lit(f"{kind}:"), digest)


def node_id(kind: str | Column, *parts: Column) -> Column:
    """kind:part/part with percent-encoded parts."""
    quoted = [F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")) for p in parts]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.concat_ws("/", *quoted))


#: Fixed pattern: runs of letters, of digits, or of neither.
RUNS = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"


def key_shape(value: Column) -> Column:
    """struct(pattern, parts) of a key: digit runs as {digits_i:length}; null without a digit run or a letter.

    parts holds (index, start, length, text) of each digit run. Digits and letters are ASCII.
    """
    runs = F.regexp_extract_all(value, F.lit(RUNS), F.lit(0))
    kind = "array<struct<index:int,start:int,length:int,text:string>>"
    zero = F.struct(F.lit("").alias("pattern"), F.lit(0).alias("at"), F.array().cast(kind).alias("parts"))

    def step(acc: Column, run: Column) -> Column:
        digits, n = run.rlike("^[0-9]"), F.size(acc["parts"]) + 1
        part = F.struct(n.alias("index"), acc["at"].alias("start"), F.length(run).alias("length"), run.alias("text"))
        shown = F.when(digits, F.concat(F.lit("{digits_"), n.cast("string"), F.lit(":"), F.length(run).cast("string"), F.lit("}"))).otherwise(run)
        return F.struct(F.concat(acc["pattern"], shown).alias("pattern"), (acc["at"] + F.length(run)).alias("at"), F.when(digits, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    found = F.aggregate(runs, zero, step)
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.struct(found["pattern"].alias("pattern"), found["parts"].alias("parts")))
