"""One query text for two engines.

``{name}`` stands for a table.  The few functions that differ are written as
``@name(a|b)`` and expanded for Spark SQL or for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_FORMS = {
    # name: (Spark SQL, DuckDB)
    "replace_all": ("regexp_replace({0}, r'{1}', r'{2}')", "regexp_replace({0}, '{1}', '{2}', 'g')"),
    "matches": ("({0} rlike r'{1}')", "regexp_matches({0}, '{1}')"),
    "count_of": ("cast(regexp_count({0}, r'{1}') as bigint)", "len(regexp_extract_all({0}, '{1}'))"),
    "capture": ("regexp_extract({0}, r'{1}', {2})", "regexp_extract({0}, '{1}', {2})"),
    "micros": ("unix_micros(cast({0} as timestamp))", "epoch_us({0})"),
    "field": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "dot": ("aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)", "list_dot_product(cast({0} as double[]), cast({1} as double[]))"),
    "item": ("get({0}, cast({1} as int))", "{0}[cast({1} as int) + 1]"),
    "size": ("cast(size({0}) as bigint)", "len({0})"),
    "chars": ("cast(char_length({0}) as bigint)", "length({0})"),
    "words": ("filter(split({0}, r'\\s+'), x -> x <> '')", "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"),
    "each": ("explode({0})", "unnest({0})"),
    "strings": ("array({0})", "[{0}]"),
    "series": ("explode(sequence(cast({0} as bigint), cast({1} as bigint)))", "unnest(generate_series(cast({0} as bigint), cast({1} as bigint)))"),
    "rank": ("cast(row_number() over ({0}) as bigint)", "row_number() over ({0})"),
    "joined": ("array_join(array_sort(collect_list({0})), ',')", "array_to_string(list_sort(list({0})), ',')"),
    "day": ("cast(to_date({0}) as string)", "cast(cast({0} as date) as varchar)"),
    "hash_unit": ("cast(conv(substring(md5({0}), 1, 8), 16, 10) as bigint) / 4294967296.0D", "cast(('0x' || substring(md5({0}), 1, 8)) as bigint) / 4294967296.0::double"),
    "quantile": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "text": ("cast({0} as string)", "cast({0} as varchar)"),
    "inorder": ("array_join(transform(array_sort(collect_list(struct({0} as o, {1} as v))), x -> x.v), {2})", "string_agg({1}, {2} ORDER BY {0})"),
    "blank_line": ("'\\n\\n'", "E'\\n\\n'"),
    "sha256": ("sha2({0}, 256)", "sha256({0})"),
    "is_json": ("(try_parse_json({0}) is not null)", "json_valid({0})"),
    "count_in": ("cast(size(filter({0}, x -> x = {1})) as bigint)", "len(list_filter({0}, lambda x: x = {1}))"),
    "count_any": ("cast(size(filter({0}, x -> x in ({1}))) as bigint)", "len(list_filter({0}, lambda x: x in ({1})))"),
    "run": ("array_join(slice({0}, cast({1} as int), {2}), ' ')", "array_to_string({0}[cast({1} as int) : cast({1} as int) + {2} - 1], ' ')"),
    "split": ("split({0}, r'{1}')", "regexp_split_to_array({0}, '{1}')"),
}


_REGEX = ("matches", "count_of", "capture", "replace_all", "split")


def _expand(text: str, engine: int) -> str:
    """Expand the last form first, so that inner forms come before outer ones."""
    while found := list(re.finditer(r"@(\w+)\(", text)):
        m = found[-1]
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0) if text[at - 1] != "\\" else 0
            at += 1
        body = text[m.end() : at - 1]
        parts = body.split("|", 1) if m[1] in _REGEX else body.split("|")  # a pattern may hold bars itself
        if m[1] in ("capture", "replace_all"):
            parts = [parts[0], *parts[1].rsplit("|", 1)]
        out = _FORMS[m[1]][engine]
        for i, p in enumerate(parts):
            out = out.replace("{%d}" % i, p)
        text = text[: m.start()] + out + text[at:]
    return text


def _doubles(text: str) -> str:
    """Write decimal literals outside of strings as doubles, which both engines know as 0.5e0."""
    parts = text.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x) for x in parts[::2]]
    return "'".join(parts)


def spark_sql(text: str) -> str:
    return _expand(_doubles(text), 0)


def duckdb_sql(text: str) -> str:
    out = _expand(_doubles(text), 1)
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return re.sub(r"\bstring\b(?=\))", "varchar", out)


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query over the Parquet tables of a folder; only the tables that it names are opened."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    spark_text = spark_sql(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        body = spark_text
        for t in used:
            name = f"{t}_{abs(hash(sf_dir)) % 10**8}"
            frames[t].createOrReplaceTempView(name)
            body = body.replace("{" + t + "}", name)
        return spark.sql(body)

    return run
