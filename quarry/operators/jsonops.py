"""JSON documents held in a string column.

Parsing uses Spark's VARIANT type (``try_parse_json``) so heterogeneous
documents need no common schema; explosion is the ``variant_explode_outer``
table function through a lateral join. Nothing runs in Python.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's (key-name vocabularies).
TIME_KEY_WORDS = ["date", "time", "year", "month", "timestamp"]
STAT_KEY_WORDS = ["price", "value", "amount", "score", "rate"]

_view_ids = itertools.count()


def nesting_depth(js: Column) -> Column:
    """The largest number of objects around any value; lists add nothing and every element
    counts. Strings and empty objects are blanked out, then a running count goes over the braces
    that are left. NULL for invalid JSON, 0 for a document without a non-empty object."""
    text = F.to_json(F.try_parse_json(js))
    braces = text
    for pattern, by in ((r'"(?:[^"\\]|\\.)*"', "s"), (r"\{\s*\}", ""), (r"[^{}]", "")):
        braces = F.regexp_replace(braces, pattern, by)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(F.split(braces, ""), start, step, lambda acc: acc["top"]).cast("bigint")


def _type_name(schema: Column) -> Column:
    return (F.when(schema.startswith("OBJECT"), "dict").when(schema.startswith("ARRAY"), "list")
             .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
             .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
             .when(schema == "BOOLEAN", "bool").when(schema == "STRING", "str")
             .when(schema == "VOID", "NoneType").otherwise(F.lower(schema)))


def _any_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def json_profile(docs: DataFrame, js: str = "js") -> DataFrame:
    """Per document type, records, keys, item type, depth,
    complexity, suggested analysis and validity."""
    v = F.try_parse_json(F.col(js))
    b = docs.select("*", v.alias("_v"))
    top = _type_name(F.schema_of_variant("_v"))
    first = F.variant_get("_v", "$[0]", "variant")
    item = _type_name(F.schema_of_variant(first))
    is_list = top == "list"
    list_keys = F.when(item == "dict", F.json_object_keys(F.to_json(first)))
    dict_keys = F.json_object_keys(F.col(js))
    keys = F.when(is_list, list_keys).when(top == "dict", dict_keys)
    as_map = F.from_json(F.col(js), "map<string,string>")
    longest = F.array_max(F.transform(F.map_values(as_map), lambda x: F.coalesce(F.json_array_length(x), F.lit(0))))
    records = (F.when(is_list, F.json_array_length(F.col(js)))
                .when(top == "dict", F.greatest(F.lit(1), F.coalesce(longest, F.lit(1))))
                .when(F.col("_v").isNotNull(), F.lit(1)))
    depth = nesting_depth(F.col(js))
    key_text = F.lower(F.array_join(keys, " "))
    n_keys = F.size(keys)
    complexity = (F.when(is_list & (item == "dict") & (n_keys > 10), "complex")
                   .when(is_list & (item == "dict") & (depth > 2), "nested")
                   .when((top == "dict") & (depth > 1), "nested").otherwise("simple"))
    suggested = (F.when(is_list & (item == "dict") & _any_word(key_text, TIME_KEY_WORDS), "timeseries")
                  .when(is_list & (item == "dict") & _any_word(key_text, STAT_KEY_WORDS), "statistical")
                  .when(is_list & (item == "dict"), "json")
                  .when((top == "dict") & (depth > 1), "json").otherwise("general"))
    valid = F.col("_v").isNotNull()
    return b.select(*[c for c in docs.columns if c != js], valid.alias("valid"),
                    F.when(valid, top).alias("data_type"), records.cast("bigint").alias("records"),
                    F.when(is_list, item).alias("item_type"), keys.alias("keys"),
                    F.when(valid, depth).alias("depth"), F.when(valid, complexity).alias("complexity"),
                    F.when(valid, suggested).alias("suggested_analysis"))


def key_inventory(docs: DataFrame, js: str = "js") -> DataFrame:
    """K3: how many documents carry each top-level key (all records)."""
    keys = docs.select(F.explode(F.json_object_keys(F.col(js))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """K1: nested struct columns become dotted top-level columns (schema walk,
    no data pass)."""
    cols: list[Column] = []

    def walk(prefix: list[str], dt: T.DataType):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(prefix + [f.name], f.dataType)
        else:
            path = ".".join(f"`{p}`" for p in prefix)
            cols.append(F.col(path).alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*cols)


def explode_records(docs: DataFrame, id_col: str, js: str = "js") -> DataFrame:
    """Every document shape to a long (id, row, key, value) table.

    list of objects -> row per element, key per field; list of scalars ->
    key 'value'; object of lists -> row per list position (shorter lists
    simply have no cell there, i.e. NULL padding); object -> row 0;
    scalar -> row 0, key 'value'. Values are JSON text.
    """
    spark = docs.sparkSession
    name = f"_quarry_json_{next(_view_ids)}"
    docs.select(F.col(id_col).alias("_id"), F.try_parse_json(F.col(js)).alias("_v")).createOrReplaceTempView(name)
    out = spark.sql(f"""
        SELECT _id, a.pos AS a_pos, a.key AS a_key, a.value AS a_val,
               schema_of_variant(_v) AS top, schema_of_variant(a.value) AS inner_t
        FROM {name}, LATERAL variant_explode_outer(_v) a
        WHERE _v IS NOT NULL""")
    out.createOrReplaceTempView(name + "_a")
    rows = spark.sql(f"""
        SELECT _id, CASE WHEN top LIKE 'ARRAY%' THEN a_pos ELSE coalesce(b.pos, 0) END AS row_idx,
               CASE WHEN top LIKE 'ARRAY%' THEN coalesce(b.key, 'value') ELSE a_key END AS key,
               to_json(CASE WHEN top LIKE 'ARRAY%' AND inner_t LIKE 'OBJECT%' THEN b.value
                            WHEN top LIKE 'OBJECT%' AND inner_t LIKE 'ARRAY%' THEN b.value
                            ELSE a_val END) AS value
        FROM {name}_a, LATERAL variant_explode_outer(
             CASE WHEN (top LIKE 'ARRAY%' AND inner_t LIKE 'OBJECT%') OR (top LIKE 'OBJECT%' AND inner_t LIKE 'ARRAY%')
                  THEN a_val END) b
        WHERE a_val IS NOT NULL OR top NOT LIKE 'ARRAY%'""")
    scalars = spark.sql(f"""SELECT _id, 0 AS row_idx, 'value' AS key, to_json(_v) AS value FROM {name}
                            WHERE _v IS NOT NULL AND schema_of_variant(_v) NOT LIKE 'ARRAY%'
                              AND schema_of_variant(_v) NOT LIKE 'OBJECT%'""")
    return rows.unionByName(scalars).withColumnRenamed("_id", id_col).select(
        id_col, F.col("row_idx").cast("bigint").alias("row_idx"), "key", "value")


def field_quality(docs: DataFrame, js: str, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """K5: per JSON path: documents where it is present, and where it
    converts to the expected type (``try_variant_get``)."""
    v = F.try_parse_json(F.col(js))
    aggs = []
    for p, t in paths:
        aggs.append(F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"),
                             F.count_if(F.try_variant_get(v, p, "variant").isNotNull()).alias("present"),
                             F.count_if(F.try_variant_get(v, p, t).isNotNull()).alias("typed")))
    return docs.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))
