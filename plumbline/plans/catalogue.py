"""The registered queries of the profiling operators, and the SQL that gives the same rows.

Tables without defects get a view that puts some in: the same SELECT runs in both engines.
Doubles are rounded to 6 places on both sides, lists are joined to texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted, shared_folder, stored, with_row_index
from plumbline.functions.text import NULL_TOKENS
from plumbline.operators import categorical, clustering, duplicates, frequency, inference, missing, numeric, outliers, sampling, sketches
from plumbline.sources.catalog import Catalog
from plumbline.sources.readers import read_dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parts with missing, misspelled and invalid cells.
DIRTY = """
SELECT p_partkey AS row_no, p_size AS size, p_retailprice AS price,
  CASE p_partkey % 7 WHEN 0 THEN lower(p_type) WHEN 1 THEN ' ' || p_type WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Unknown' ELSE p_type END AS kind,
  CASE p_partkey % 11 WHEN 0 THEN 'USA' WHEN 1 THEN 'usa' WHEN 2 THEN 'france' WHEN 3 THEN 'Moon' WHEN 4 THEN 'Test' WHEN 5 THEN 'UK'
    WHEN 6 THEN 'Atlantis' WHEN 7 THEN 'germany ' WHEN 8 THEN 'New Zealand' WHEN 9 THEN NULL ELSE 'U' END AS country,
  CASE p_partkey % 5 WHEN 0 THEN 'a.b-c@mail.example.com' WHEN 1 THEN 'x@y' WHEN 2 THEN 'no mail' WHEN 3 THEN NULL ELSE 'u_1@example.org' END AS email,
  CASE p_partkey % 4 WHEN 0 THEN '+1 555 010 2233' WHEN 1 THEN '12345' WHEN 2 THEN '555-0102-334' ELSE 'call me maybe 1' END AS phone,
  CASE p_partkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'f' WHEN 2 THEN 'x' WHEN 3 THEN 'Non-Binary' WHEN 4 THEN 'n/a' ELSE 'female' END AS gender,
  CASE p_partkey % 8 WHEN 0 THEN '7' WHEN 1 THEN '12.5' WHEN 2 THEN '-1' WHEN 3 THEN 'none' WHEN 4 THEN '101' WHEN 5 THEN NULL WHEN 6 THEN '7d' ELSE '10' END AS rating,
  CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE 'AB' END AS category,
  CASE WHEN p_partkey % 10 = 0 THEN '2022-13-01' WHEN p_partkey % 25 = 1 THEN NULL ELSE '2021-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15' END AS ship_date,
  CASE WHEN p_partkey % 10 = 3 THEN '03.2021' ELSE '1' || CAST(p_partkey % 9 AS STRING) || '.0' || CAST(1 + p_partkey % 9 AS STRING) || '.2021' END AS birth,
  CASE WHEN p_partkey % 9 = 0 THEN 'n.a.' ELSE CAST(p_size AS STRING) END AS amount
FROM {part}"""
DIRTY_COLUMNS = ["kind", "country", "email", "phone", "gender", "rating", "category", "ship_date", "birth", "amount"]
DIRTY_SQL = "dirty AS (" + DIRTY.replace("{part}", "part").replace("AS STRING", "AS VARCHAR") + ")"
CELLS_SQL = DIRTY_SQL + ", cells AS (" + " UNION ALL ".join(f"SELECT row_no, '{c}' AS \"column\", {c} AS value FROM dirty" for c in DIRTY_COLUMNS) + ")"
FREQ_SQL = CELLS_SQL + ', freq AS (SELECT "column", value, count(*) AS cnt FROM cells GROUP BY 1, 2)'
TOKENS_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS if t.isprintable())
MISSING_SQL = f"(value IS NULL OR lower(value) IN ({TOKENS_SQL}) OR trim(value) = '')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY, part=read(spark, sf_dir, "part"))


def dirty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select(*DIRTY_COLUMNS)


def freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequencies(dirty_texts(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").drop("text").join(read(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED_SQL = "labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(quoted(c), digits).alias(c) if t == "double" else quoted(c) for c, t in df.dtypes])


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def query(name: str, sql: str | None = None):
    """Registers a function as a query, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# ---- missing values

_LABELLED_CELLS = LABELLED_SQL + ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, count(*) AS n FROM labelled" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")) + ")"


@query("missing_basic", f'WITH {_LABELLED_CELLS} SELECT "column", missing_count::BIGINT AS missing_count, round(missing_count::DOUBLE / n * 100, 6) AS missing_pct FROM m WHERE missing_count > 0')
def _(spark, sf):
    return rounded(missing.missing_basic(labelled(spark, sf)))


@query("missing_basic_totals", f"WITH {_LABELLED_CELLS} SELECT sum(missing_count)::BIGINT AS total_missing, sum(n)::BIGINT AS total_cells, round(sum(missing_count)::DOUBLE / sum(n) * 100, 6) AS missing_pct FROM m")
def _(spark, sf):
    return rounded(missing.missing_basic_totals(labelled(spark, sf)))


_REPORT = """count(*) FILTER (WHERE value IS NULL OR value IN ('nan', 'NaN', 'NA', ''))"""


@query("missing_tokens", f'WITH {CELLS_SQL} SELECT "column", {_REPORT}::BIGINT AS missing_count, round({_REPORT}::DOUBLE / count(*) * 100, 2) AS missing_pct FROM cells GROUP BY 1 HAVING {_REPORT} > 0')
def _(spark, sf):
    return missing.missing_report(dirty_texts(spark, sf))


@query("missing_full", f'WITH {CELLS_SQL} SELECT "column", count(*) FILTER (WHERE {MISSING_SQL})::BIGINT AS missing_count, round(count(*) FILTER (WHERE {MISSING_SQL})::DOUBLE / count(*) * 100, 2) AS missing_pct FROM cells GROUP BY 1')
def _(spark, sf):
    return missing.missing_full(dirty_texts(spark, sf))


@query("missing_full_totals", f"WITH {CELLS_SQL} SELECT count(*) FILTER (WHERE {MISSING_SQL})::BIGINT AS total_missing, count(*)::BIGINT AS total_cells, round(count(*) FILTER (WHERE {MISSING_SQL})::DOUBLE / count(*) * 100, 2) AS missing_pct FROM cells")
def _(spark, sf):
    return missing.missing_full_totals(dirty_texts(spark, sf))


@query("missing_used_tokens", f"WITH {FREQ_SQL} SELECT CASE WHEN trim(value) = '' THEN 'empty string' ELSE lower(value) END AS token, sum(cnt)::BIGINT AS cells FROM freq WHERE lower(value) IN ({TOKENS_SQL}) OR trim(value) = '' GROUP BY 1")
def _(spark, sf):
    return missing.missing_tokens_used(freq(spark, sf))


@query("missing_examples", f"""WITH {CELLS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_no) - 1 AS at_row FROM cells), bad AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_no) AS k FROM placed WHERE {MISSING_SQL})
SELECT at_row AS row_index, "column", value AS original_value, CASE WHEN value IS NULL THEN 'None' WHEN trim(value) = '' THEN 'Empty string' ELSE 'Null indicator: ' || value END AS detected_as FROM bad WHERE k <= 5""")
def _(spark, sf):
    return missing.missing_examples(with_row_index(dirty(spark, sf).select("row_no", *DIRTY_COLUMNS), "row_no").drop("row_no"))


@query("missing_sentinels", f'WITH {FREQ_SQL} SELECT "column", value FROM freq WHERE value IN (\'N/A\', \'\', \'Unknown\', \'n/a\', \'none\')')
def _(spark, sf):
    return missing.sentinel_examples(freq(spark, sf))


@query("missing_matrix", f'WITH {LABELLED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM labelled) ' + " UNION ALL ".join(f"SELECT row_index, '{c}' AS \"column\", {c} IS NULL AS is_null FROM r" for c in ("doc_id", "quality", "toxic")))
def _(spark, sf):
    return missing.null_matrix(with_row_index(labelled(spark, sf).select("doc_id", "quality", "toxic"), "doc_id"))


# ---- duplicates


def _dup_sql(groups: str) -> str:
    return f"WITH g AS ({groups}) SELECT sum(n)::BIGINT AS total_rows, (sum(n) - count(*))::BIGINT AS duplicate_count, round((sum(n) - count(*))::DOUBLE / sum(n) * 100, 2) AS duplicate_pct FROM g"


@query("dup_exact", _dup_sql("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2"))
def _(spark, sf):
    return duplicates.exact_duplicates(read(spark, sf, "part").select("p_brand", "p_type"))


@query("dup_texts", _dup_sql("SELECT text, count(*) AS n FROM documents GROUP BY 1"))
def _(spark, sf):
    return duplicates.exact_duplicates(read(spark, sf, "documents").select("text"))


def _norm_sql(c: str) -> str:
    base = f"lower(CASE WHEN {c} IS NULL OR lower({c}) IN ('nan', 'null', 'none', 'na', 'n/a', '') THEN 'NULL' ELSE {c} END)"
    return f"""regexp_replace(regexp_replace(regexp_replace({base}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[,.''"\\-_()\\[\\]{{}}]', '', 'g')"""


@query("dup_normalized", f"WITH {DIRTY_SQL}, " + _dup_sql(f"SELECT {_norm_sql('kind')} AS a, {_norm_sql('country')} AS b, {_norm_sql('category')} AS c, count(*) AS n FROM dirty GROUP BY 1, 2, 3").removeprefix("WITH "))
def _(spark, sf):
    return duplicates.normalised_duplicates(dirty(spark, sf).select("kind", "country", "category"))


@query("dup_excl_id", _dup_sql("SELECT p_brand, p_size, count(*) AS n FROM (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9 #]', '', 'g')) AS p_brand, p_size FROM part) GROUP BY 1, 2"))
def _(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return duplicates.normalised_duplicates(df, duplicates.duplicate_search_columns(df))


@query("dup_flag", """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders),
f AS (SELECT row_index, min(row_index) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS original_index FROM r) SELECT *, row_index <> original_index AS is_duplicate FROM f""")
def _(spark, sf):
    rows = with_row_index(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return duplicates.duplicate_flags(rows, ["o_orderstatus", "o_orderpriority"])


@query("dup_groups_first", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS copies, min(o_orderkey) AS first_row FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return duplicates.duplicate_groups(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("dup_examples", """WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
f AS (SELECT *, min(i) OVER (PARTITION BY p_brand) AS o FROM r) SELECT o AS original_index, i AS duplicate_index, 'exact' AS type, 1.0::DOUBLE AS similarity, p_brand AS brand FROM f WHERE i <> o ORDER BY i LIMIT 5""")
def _(spark, sf):
    rows = with_row_index(read(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").drop("p_partkey")
    found = duplicates.duplicate_examples(rows, duplicates.duplicate_flags(rows, ["p_brand"]))
    return found.select("original_index", "duplicate_index", "type", "similarity", F.get_json_object("duplicate_row", "$.p_brand").alias("brand"))


def _lcs_sql(x: str, y: str) -> str:
    """Length of the longest common subsequence of two texts of at most 120 characters, by the bits of a number."""
    ones = f"((1::HUGEINT << length({x})) - 1)"
    masks = f"list_transform(string_split({y}, ''), lambda c: list_sum(list_transform(range(length({x})), lambda i: CASE WHEN substr({x}, (i + 1)::INT, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)"
    last = f"list_reduce(list_prepend({ones}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {ones})"
    return f"(length({x}) - bit_count({last}))"


def _near_sql(texts: str, threshold: float) -> str:
    """Pairs of the rows (id, s) of the table ``texts`` by indel similarity; the edit distance is never over the indel distance."""
    far = f"({1 - threshold} * (length(a.s) + length(b.s)) + 1e-9)"
    return f"""SELECT a, b, 2 * lcs::DOUBLE / (length(x) + length(y)) AS similarity FROM (SELECT *, {_lcs_sql("x", "y")} AS lcs FROM (
SELECT a.id AS a, b.id AS b, a.s AS x, b.s AS y FROM {texts} a JOIN {texts} b ON a.id < b.id AND a.s <> b.s AND levenshtein(a.s, b.s) <= {far})) WHERE 2 * lcs::DOUBLE / (length(x) + length(y)) >= {threshold} - 1e-12"""


_PROFILE = "SELECT '{0}' AS profile, sum(n)::BIGINT AS total_rows, (sum(n) - count(*) + {2})::BIGINT AS duplicate_count, round((sum(n) - count(*) + {2})::DOUBLE / sum(n) * 100, 2) AS duplicate_pct, ({2})::BIGINT AS near_duplicate_count FROM (SELECT {1}, count(*) AS n FROM t GROUP BY ALL)"
_LABELS = "SELECT p_partkey AS row_no, p_name AS label, upper(p_type) || ' ' AS grade, p_brand AS code FROM {part}"
_RECORD = "'{''label'': ''' || a || ''', ''grade'': ''' || b || '''}'"
_LABELS_SQL = f"""t AS ({_LABELS.replace("{part}", "part")}), records AS (SELECT min(row_no) AS id, {_RECORD} AS s FROM (SELECT row_no, {_norm_sql("label")} AS a, {_norm_sql("grade")} AS b FROM t) GROUP BY a, b), near AS ({_near_sql("records", 0.9)})"""
_PROFILES_SQL = f"WITH {_LABELS_SQL}, p AS (" + " UNION ALL ".join([
    _PROFILE.format("standard", "row_no, label, grade, code", "0"), _PROFILE.format("normalized", f"row_no, {_norm_sql('label')} AS a, {_norm_sql('grade')} AS b, {_norm_sql('code')} AS c", "0"),
    _PROFILE.format("smart", f"{_norm_sql('label')} AS a, {_norm_sql('grade')} AS b", "(SELECT count(*) FROM near)"),
]) + ")"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_LABELS, part=read(spark, sf, "part"))


@query("dup_profiles", _PROFILES_SQL + " SELECT * FROM p")
def _(spark, sf):
    return duplicates.duplicate_profiles(_labels(spark, sf))


def _label_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = with_row_index(_labels(spark, sf), "row_no")
    return rows, duplicates.near_rows(rows, ["label", "grade"])


@query("dup_near_pairs", f"WITH {_LABELS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM near")
def _(spark, sf):
    return rounded(_label_pairs(spark, sf)[1])


@query("dup_near_examples", f"WITH {_LABELS_SQL} SELECT a AS original_index, b AS duplicate_index, 'near' AS type, round(similarity, 6) AS similarity, (SELECT label FROM t WHERE row_no = a) AS original_label, (SELECT label FROM t WHERE row_no = b) AS duplicate_label FROM near ORDER BY a, b LIMIT 5")
def _(spark, sf):
    found = duplicates.near_examples(*_label_pairs(spark, sf))
    label = lambda c: F.get_json_object(c, "$.label")
    return rounded(found.select("original_index", "duplicate_index", "type", "similarity", label("original_row").alias("original_label"), label("duplicate_row").alias("duplicate_label")))


@query("dup_additional", _PROFILES_SQL + " SELECT (max(duplicate_count) FILTER (WHERE profile = 'smart') - max(duplicate_count) FILTER (WHERE profile = 'standard'))::BIGINT AS additional_duplicates_found FROM p")
def _(spark, sf):
    return duplicates.additional_duplicates(QUERIES["dup_profiles"](spark, sf))


@query("dup_split", """WITH g AS (SELECT count(*) AS n FROM part GROUP BY p_brand), s AS (SELECT round((sum(n) - count(*))::DOUBLE / sum(n) * 100, 1) AS pct FROM g) SELECT 'Duplicates' AS label, pct FROM s UNION ALL SELECT 'Unique', 100 - pct FROM s""")
def _(spark, sf):
    return rounded(duplicates.duplicate_split(duplicates.exact_duplicates(read(spark, sf, "part").select("p_brand"))))


@query("near_dup_lev", """WITH t AS (SELECT min(p_partkey) AS id, p_name AS s FROM part GROUP BY p_name)
SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.s, b.s)::DOUBLE / greatest(length(a.s), length(b.s)), 6) AS similarity FROM t a JOIN t b ON a.id < b.id WHERE 1 - levenshtein(a.s, b.s)::DOUBLE / greatest(length(a.s), length(b.s)) >= 0.6 - 1e-12""")
def _(spark, sf):
    types = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("row_index")).withColumnRenamed("p_name", "record")
    return rounded(duplicates.near_duplicates(types, 0.6, metric="levenshtein"))


@query("near_dup_indel", f"WITH t AS (SELECT min(p_partkey) AS id, p_name AS s FROM part GROUP BY p_name) SELECT a, b, round(similarity, 6) AS similarity FROM ({_near_sql('t', 0.6)})")
def _(spark, sf):
    types = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("row_index")).withColumnRenamed("p_name", "record")
    return rounded(duplicates.near_duplicates(types, 0.6))


# ---- types and ids


@query("id_columns", """SELECT 'p_partkey' AS "column", 'content' AS reason UNION ALL SELECT 'p_name', 'content' FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 100) HAVING count(DISTINCT p_name) > 90
UNION ALL SELECT 'p_retailprice', 'content' FROM (SELECT p_retailprice FROM part ORDER BY p_partkey LIMIT 100) HAVING count(DISTINCT p_retailprice) > 90""")
def _(spark, sf):
    return inference.id_columns(read(spark, sf, "part"), order="p_partkey")


@query("dtypes", """SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(ordinal, "column", type)""")
def _(spark, sf):
    return inference.data_types(read(spark, sf, "customer"))


_NUMBER_SQL = r"regexp_matches(value, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')"


@query("infer_numeric", f"""WITH {FREQ_SQL}, c AS (SELECT "column", sum(cnt) AS non_null, coalesce(sum(cnt) FILTER (WHERE {_NUMBER_SQL}), 0) AS numbers, coalesce(bool_and(try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE))) FILTER (WHERE {_NUMBER_SQL}), false) AS whole,
coalesce(sum(cnt) FILTER (WHERE coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d.%m.%Y')) IS NOT NULL), 0) AS dates FROM freq WHERE value IS NOT NULL GROUP BY 1)
SELECT "column", non_null::BIGINT AS non_null, numbers::BIGINT AS numbers, CASE WHEN dates > 0.5 * non_null THEN 'datetime' WHEN numbers > 0.8 * non_null AND whole THEN 'integer' WHEN numbers > 0.8 * non_null THEN 'numeric' ELSE 'unknown' END AS inferred_type FROM c""")
def _(spark, sf):
    return inference.text_types(freq(spark, sf)).select("column", "non_null", "numbers", "inferred_type")


@query("infer_datetime", f"""WITH {FREQ_SQL} SELECT "column", sum(cnt)::BIGINT AS non_null, sum(cnt) FILTER (WHERE coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d.%m.%Y')) IS NOT NULL)::BIGINT AS dates, CASE WHEN "column" = 'birth' THEN 'dd.MM.yyyy' END AS date_format, 'datetime' AS inferred_type FROM freq WHERE value IS NOT NULL AND "column" IN ('ship_date', 'birth') GROUP BY 1""")
def _(spark, sf):
    return inference.text_types(freq(spark, sf)).filter("inferred_type = 'datetime'").select("column", "non_null", "dates", "date_format", "inferred_type")


@query("invalid_dates", f"""WITH {FREQ_SQL} SELECT "column", sum(cnt)::BIGINT AS cells, string_agg(value, '|' ORDER BY value) AS "values" FROM freq WHERE value IS NOT NULL AND "column" IN ('ship_date', 'birth') AND coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d.%m.%Y')) IS NULL GROUP BY 1""")
def _(spark, sf):
    f = freq(spark, sf)
    return inference.invalid_dates(f, inference.text_types(f)).select("column", "cells", joined("values"))


@query("type_examples", f"""WITH {FREQ_SQL}, r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS k FROM freq WHERE value IS NOT NULL AND "column" IN ('ship_date', 'birth', 'amount'))
SELECT "column", CASE WHEN "column" = 'amount' THEN 'integer' ELSE 'datetime' END AS inferred_type, string_agg(value, '|' ORDER BY value) AS examples FROM r WHERE k <= 5 GROUP BY 1""")
def _(spark, sf):
    f = freq(spark, sf)
    return inference.type_examples(f, inference.text_types(f)).select("column", "inferred_type", joined("examples"))


@query("int_like_floats", """SELECT 'l_quantity' AS "column", count(*)::BIGINT AS non_null FROM lineitem HAVING bool_and(l_quantity = floor(l_quantity)) UNION ALL SELECT 'l_extendedprice', count(*) FROM lineitem HAVING bool_and(l_extendedprice = floor(l_extendedprice)) UNION ALL SELECT 'l_discount', count(*) FROM lineitem HAVING bool_and(l_discount = floor(l_discount)) UNION ALL SELECT 'l_tax', count(*) FROM lineitem HAVING bool_and(l_tax = floor(l_tax))""")
def _(spark, sf):
    return inference.integer_like_floats(read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


# ---- categories

_TOP = 'SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value NULLS LAST) AS rank FROM freq'


@query("cat_detect", f"""WITH {FREQ_SQL}, numbers AS (SELECT 'size' AS "column", count(DISTINCT size) AS u, count(*) AS n, 15 AS most, 0.1 AS share FROM dirty UNION ALL SELECT 'price', count(DISTINCT price), count(*), 15, 0.1 FROM dirty),
c AS (SELECT "column", count(value) AS u, sum(cnt) AS n, 50 AS most, 0.2 AS share FROM freq GROUP BY 1 UNION ALL SELECT * FROM numbers) SELECT "column", u::BIGINT AS n_unique, n::BIGINT AS total FROM c WHERE u > 0 AND u <= least(most, share * n)""")
def _(spark, sf):
    return categorical.categorical_columns(dirty(spark, sf), ids=["row_no"])


@query("value_counts_topk", f'WITH {FREQ_SQL} SELECT "column", value, cnt::BIGINT AS cnt, rank::INTEGER AS rank FROM ({_TOP}) WHERE rank <= 20')
def _(spark, sf):
    return frequency.top_values(freq(spark, sf), 20)


@query("cat_other_bucket", f"""WITH {FREQ_SQL} SELECT "column", CASE WHEN rank <= 6 THEN coalesce(value, 'Missing') ELSE 'Other' END AS label, sum(cnt)::BIGINT AS cnt FROM ({_TOP}) WHERE rank <= 30 GROUP BY 1, 2""")
def _(spark, sf):
    return frequency.top_with_other(freq(spark, sf))


@query("case_inconsistency", f"""WITH {FREQ_SQL} SELECT "column", lower(value) AS base_value, string_agg(value, '|' ORDER BY value) AS variations, sum(cnt)::BIGINT AS total_occurrences FROM freq WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return categorical.case_groups(freq(spark, sf)).select("column", "base_value", joined("variations"), "total_occurrences")


def _standard_sql(match: str) -> str:
    from plumbline.operators.rules import STANDARD_SETS

    parts = []
    for k, s in enumerate(STANDARD_SETS):
        test = " OR ".join(f"contains(lower(value), '{w}')" if match == "substring" else f"lower(value) = '{w}'" for w in s)
        parts.append(f"""SELECT "column", {k} AS k, '{"|".join(sorted(s))}' AS options, '{" / ".join(sorted(s))}' AS base, value, cnt FROM freq WHERE value IS NOT NULL AND ({test})""")
    return f"""{FREQ_SQL}, found AS ({" UNION ALL ".join(parts)}), standard AS (SELECT *, row_number() OVER (PARTITION BY "column", k ORDER BY value) AS place, count(*) OVER (PARTITION BY "column", k) AS several FROM found)"""


_STANDARD = """ SELECT "column", options AS standard_options, string_agg(value, '|' ORDER BY value) FILTER (WHERE place <= 100) AS found_variations, count(*)::BIGINT AS n_variations, sum(cnt)::BIGINT AS total_occurrences FROM standard WHERE several > 1 GROUP BY "column", k, options"""


@query("standardization", f"WITH {_standard_sql('substring')}{_STANDARD}")
def _(spark, sf):
    return categorical.standard_groups(freq(spark, sf)).select("column", joined("standard_options"), joined("found_variations"), "n_variations", "total_occurrences")


@query("standardization_exact", f"WITH {_standard_sql('exact')}{_STANDARD}")
def _(spark, sf):
    return categorical.standard_groups(freq(spark, sf), "exact").select("column", joined("standard_options"), joined("found_variations"), "n_variations", "total_occurrences")


_CONSISTENCY = """SELECT "column", coalesce(sum(cnt) FILTER (WHERE value <> lower(value)), 0)::BIGINT AS case_count, coalesce(sum(cnt) FILTER (WHERE value <> trim(value)), 0)::BIGINT AS space_count, count(*) FILTER (WHERE rare)::BIGINT AS rare_count,
coalesce(string_agg(coalesce(value, 'Missing'), '|' ORDER BY coalesce(value, 'Missing')) FILTER (WHERE rare AND k <= 10), '') AS rare_values FROM (SELECT *, row_number() OVER (PARTITION BY "column", rare ORDER BY cnt, value NULLS LAST) AS k FROM marked) GROUP BY 1"""


@query("consistency", f"""WITH {FREQ_SQL}, marked AS (SELECT *, cnt < greatest(1, 0.01 * sum(cnt) OVER (PARTITION BY "column")) AS rare FROM freq WHERE value IS NOT NULL), s AS ({_CONSISTENCY}) SELECT * FROM s WHERE case_count > 0 OR space_count > 0 OR rare_count > 0""")
def _(spark, sf):
    return categorical.consistency(freq(spark, sf)).select("column", "case_count", "space_count", "rare_count", joined("rare_values"))


_VARIATIONS = """WITH {0}, v AS (SELECT "column", {1} AS base_value, value FROM freq WHERE value IS NOT NULL AND value <> {1}), k AS (SELECT *, row_number() OVER (PARTITION BY "column", base_value ORDER BY value) AS j, dense_rank() OVER (PARTITION BY "column" ORDER BY base_value) AS r FROM v)
SELECT "column", base_value, string_agg(value, '|' ORDER BY value) AS variations FROM k WHERE j <= 5 AND r <= 5 GROUP BY 1, 2"""


@query("case_examples", _VARIATIONS.format(FREQ_SQL, "lower(value)"))
def _(spark, sf):
    return categorical.variation_examples(freq(spark, sf), "case").select("column", "base_value", joined("variations"))


@query("whitespace_inconsistency", _VARIATIONS.format(FREQ_SQL, "trim(value)"))
def _(spark, sf):
    return categorical.variation_examples(freq(spark, sf), "space").select("column", "base_value", joined("variations"))


@query("consistency_upload", f"""WITH {DIRTY_SQL}, t AS (SELECT kind AS value, count(*) AS cnt FROM dirty WHERE kind IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY cnt = 1 ORDER BY value) AS k, value <> lower(trim(value)) AS odd, row_number() OVER (PARTITION BY value <> lower(trim(value)) ORDER BY value) AS j FROM t)
SELECT 'kind' AS "column", coalesce(string_agg(value, '|' ORDER BY value) FILTER (WHERE odd AND j <= 100), '') AS inconsistent_format, count(*) FILTER (WHERE odd)::BIGINT AS inconsistent_count, coalesce(string_agg(value, '|' ORDER BY value) FILTER (WHERE cnt = 1 AND k <= 10), '') AS rare_values FROM r""")
def _(spark, sf):
    kinds = frequency.frequencies(dirty(spark, sf).select("kind"))
    return categorical.upload_consistency(kinds).select("column", joined("inconsistent_format"), "inconsistent_count", joined("rare_values"))


_RULES = """SELECT "column", value, cnt, 'country' AS rule, 'value' AS reason FROM freq WHERE "column" = 'country' AND lower(value) NOT IN ('usa', 'united states', 'us', 'canada', 'france', 'germany', 'uk', 'united kingdom', 'spain', 'italy', 'japan', 'china', 'india', 'brazil', 'australia', 'morocco')
UNION ALL SELECT "column", value, cnt, 'country', 'pattern' FROM freq WHERE "column" = 'country' AND regexp_matches(lower(value), 'invalid|unknown|test|n/a')
UNION ALL SELECT "column", value, cnt, 'rating', 'range' FROM freq WHERE "column" = 'rating' AND """ + _NUMBER_SQL + """ AND NOT try_cast(value AS DOUBLE) BETWEEN 1 AND 10
UNION ALL SELECT "column", value, cnt, 'rating', 'pattern' FROM freq WHERE "column" = 'rating' AND regexp_matches(lower(value), 'invalid|none|unknown')
UNION ALL SELECT "column", value, cnt, 'category', 'valid_pattern' FROM freq WHERE "column" = 'category' AND NOT regexp_matches(value, '^[A-Z]$')"""


@query("category_pattern", f'WITH {FREQ_SQL}, v AS ({_RULES}) SELECT "column", value, cnt::BIGINT AS cnt, rule, reason FROM v')
def _(spark, sf):
    return categorical.rule_violations(freq(spark, sf))


_REPORT_SQL = f"""WITH {FREQ_SQL}, marked AS (SELECT *, cnt < 0.01 * sum(cnt) OVER (PARTITION BY "column") AS rare FROM freq), s AS ({_CONSISTENCY}), v AS ({_RULES}),
b AS (SELECT "column", string_agg(value, '|' ORDER BY value) AS invalid_values FROM (SELECT DISTINCT "column", value FROM v) GROUP BY 1)"""


@query("consistency_report", _REPORT_SQL + """ SELECT coalesce(s."column", b."column") AS "column", coalesce(case_count, 0) AS case_count, coalesce(space_count, 0) AS space_count, coalesce(rare_count, 0) AS rare_count, coalesce(rare_values, '') AS rare_values, coalesce(invalid_values, '') AS invalid_values FROM (SELECT * FROM s WHERE case_count > 0 OR space_count > 0 OR rare_count > 0) s FULL JOIN b ON s."column" = b."column" """)
def _(spark, sf):
    return categorical.report_consistency(freq(spark, sf)).select("column", "case_count", "space_count", "rare_count", joined("rare_values"), joined("invalid_values"))


@query("value_flags", f"""WITH {FREQ_SQL}, v AS ({_RULES}), t AS (SELECT *, sum(cnt) OVER (PARTITION BY "column") AS total FROM freq), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank FROM t WHERE value IS NOT NULL)
SELECT r."column", r.value, r.cnt::BIGINT AS cnt, r.value <> lower(r.value) OR r.value <> trim(r.value) OR r.cnt < 0.01 * total OR EXISTS (SELECT 1 FROM v WHERE v."column" = r."column" AND v.value = r.value) AS has_issue FROM r WHERE rank <= 15""")
def _(spark, sf):
    return categorical.value_flags(freq(spark, sf))


_DOMAINS = {
    "country": "CASE WHEN lower(value) IN ('moon', 'test') OR length(trim(value)) < 2 THEN 'obvious' WHEN value = 'Atlantis' THEN 'unknown' END",
    "email": r"CASE WHEN NOT regexp_matches(value, '^[\w.\-]+@([\w\-]+\.)+[A-Za-z]{2,}$') THEN 'pattern' END",
    "phone": "CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) < 7 OR length(regexp_replace(value, '[^0-9]', '', 'g')) < 0.7 * length(value) THEN 'digits' END",
    "gender": "CASE WHEN lower(value) NOT IN ('male', 'female', 'm', 'f', 'other', 'non-binary', 'prefer not to say') THEN 'value' END",
    "rating": f"CASE WHEN NOT {_NUMBER_SQL} THEN 'not a number' WHEN NOT try_cast(value AS DOUBLE) BETWEEN 0 AND 100 THEN 'range' END",
}
_INVALID = "invalid AS (SELECT * FROM (" + " UNION ALL ".join(f"""SELECT "column", value, cnt::BIGINT AS cnt, '{name}' AS domain, {reasons} AS reason FROM freq WHERE value IS NOT NULL AND "column" = '{name}'""" for name, reasons in _DOMAINS.items()) + ") WHERE reason IS NOT NULL)"


def _domain(name: str):
    @query(f"domain_{name}", f"WITH {FREQ_SQL}, {_INVALID} SELECT * FROM invalid WHERE domain = '{name}'")
    def _(spark, sf):
        return categorical.invalid_values(freq(spark, sf)).filter(F.col("domain") == name)


for _name in _DOMAINS:
    _domain(_name)


@query("issue_table", f"""WITH {_standard_sql("substring")}, {_INVALID}, cased AS (SELECT *, count(*) OVER (PARTITION BY "column", lower(value)) AS same FROM freq WHERE value IS NOT NULL)
SELECT "column", 'case' AS issue_type, lower(value) AS base_value, value AS variation, cnt::BIGINT AS cnt, 'use ' || lower(value) AS recommendation FROM cased WHERE same > 1
UNION ALL SELECT "column", 'standardization', base, value, cnt, 'use one spelling' FROM standard WHERE several > 1
UNION ALL SELECT "column", 'invalid', '', value, cnt, 'check or remove' FROM invalid""")
def _(spark, sf):
    return categorical.issue_table(freq(spark, sf))


@query("value_validity", f"""WITH {FREQ_SQL}, {_INVALID}, t AS (SELECT *, sum(cnt) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value NULLS LAST) AS rank FROM freq)
SELECT "column", coalesce(value, 'Missing') AS value, cnt::BIGINT AS cnt, round(cnt::DOUBLE / total * 100, 6) AS pct, NOT EXISTS (SELECT 1 FROM invalid i WHERE i."column" = t."column" AND i.value = t.value) AS is_valid FROM t WHERE rank <= 30""")
def _(spark, sf):
    f = freq(spark, sf)
    return rounded(categorical.value_rows(f, categorical.invalid_values(f)))


# ---- numbers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in LINE) + ")"
_DESCRIBE = """count(v)::BIGINT AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max"""


@query("describe", f'WITH {_LINE_CELLS} SELECT "column", {_DESCRIBE} FROM cells GROUP BY 1')
def _(spark, sf):
    return rounded(numeric.describe(read(spark, sf, "lineitem"), LINE))


@query("quantiles", """SELECT 'c_acctbal' AS "column", p AS probability, round(quantile_cont(c_acctbal, p), 6) AS value FROM customer, (VALUES (0.1::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(p) GROUP BY p""".replace("quantile_cont(c_acctbal, p)", "CASE p WHEN 0.1 THEN quantile_cont(c_acctbal, 0.1) WHEN 0.9 THEN quantile_cont(c_acctbal, 0.9) ELSE quantile_cont(c_acctbal, 0.99) END"))
def _(spark, sf):
    return rounded(numeric.quantiles(read(spark, sf, "customer"), ["c_acctbal"], [0.1, 0.9, 0.99]))


@query("quick_statistics", f'WITH {_LINE_CELLS} SELECT "column", round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM cells GROUP BY 1')
def _(spark, sf):
    return rounded(numeric.quick_statistics(read(spark, sf, "lineitem"), LINE))


_MOMENTS = """m AS (SELECT "column", count(v)::DOUBLE AS n, avg(v) AS mu FROM cells GROUP BY 1), s AS (SELECT "column", any_value(n) AS n, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM cells JOIN m USING ("column") GROUP BY 1),
g AS (SELECT "column", n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM s)"""
_K2 = """a1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2 FROM g),
a2 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) * ln(y / sqrt(2 / (w2 - 1)) + sqrt(pow(y / sqrt(2 / (w2 - 1)), 2) + 1)) AS z1, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM a1),
a3 AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM a2), a4 AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM a3),
k AS (SELECT "column", z1 * z1 + pow((1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS normality FROM a4)"""


@query("distribution_ext", f'WITH {_LINE_CELLS}, {_MOMENTS}, d AS (SELECT "column", {_DESCRIBE}, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM cells GROUP BY 1) SELECT d.*, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis FROM d JOIN g USING ("column")')
def _(spark, sf):
    return rounded(numeric.distribution(read(spark, sf, "lineitem"), LINE).drop("normality"))


@query("normality", """WITH cells AS (SELECT 'c_acctbal' AS "column", c_acctbal AS v FROM customer UNION ALL SELECT 'value', value FROM events), """.replace(" UNION ALL SELECT 'value', value FROM events", "") + f'{_MOMENTS}, {_K2} SELECT "column", round(normality, 3) AS normality FROM k')
def _(spark, sf):
    return rounded(numeric.distribution(read(spark, sf, "customer"), ["c_acctbal"]).select("column", "normality"), 3)


@query("entropy", """WITH t AS (SELECT event_type AS value, count(*) AS cnt FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, value) AS k FROM t), p AS (SELECT *, cnt::DOUBLE / sum(cnt) OVER () AS p FROM r WHERE k <= 20)
SELECT 'event_type' AS "column", (SELECT count(*) FROM t)::BIGINT AS unique_values, max(value) FILTER (WHERE k = 1) AS most_common, max(cnt)::BIGINT AS most_common_count, round(max(cnt)::DOUBLE / (SELECT count(*) FROM events) * 100, 2) AS most_common_pct, round(-sum(p * ln(p)), 6) AS entropy FROM p""")
def _(spark, sf):
    return rounded(numeric.categorical_distribution(frequency.frequencies(read(spark, sf, "events").select("event_type"))))


@query("histogram", """WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer), t AS (SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, lo, (hi - lo) / 30 AS w, n FROM customer, b)
SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*)::BIGINT AS cnt, round(count(*) / (n * w), 6) AS density FROM t GROUP BY bin, lo, w, n""")
def _(spark, sf):
    return rounded(numeric.histogram(read(spark, sf, "customer"), "c_acctbal"))


@query("kde", """WITH b AS (SELECT count(*) AS n, min(s_acctbal) AS lo, max(s_acctbal) AS hi, stddev_samp(s_acctbal) * pow(count(*), -0.2) AS h FROM supplier), g AS (SELECT lo + i * ((hi - lo) / 999) AS x, n, h FROM b, range(0, 1000) t(i))
SELECT round(x, 6) AS x, round(sum(exp(-pow((x - s_acctbal) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 9) AS density FROM g, supplier GROUP BY x, n, h""")
def _(spark, sf):
    out = numeric.density(read(spark, sf, "supplier"), "s_acctbal")
    return out.select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS correlation FROM {{0}}" for a, b in _PAIRS)
_CLIPPED = "q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in LINE) + " FROM lineitem), w AS (SELECT " + ", ".join(f"greatest({c}_a - 3 * ({c}_b - {c}_a), least({c}_b + 3 * ({c}_b - {c}_a), {c})) AS {c}" for c in LINE) + " FROM lineitem, q)"


@query("corr_raw", f"WITH c AS ({_CORR.format('lineitem')}) SELECT column1, column2, round(correlation, 6) AS correlation FROM c")
def _(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "lineitem"), LINE))


@query("corr_winsor", f"WITH {_CLIPPED}, c AS ({_CORR.format('w')}) SELECT column1, column2, round(correlation, 6) AS correlation FROM c")
def _(spark, sf):
    return rounded(numeric.correlations(numeric.winsorised(read(spark, sf, "lineitem"), LINE), LINE))


@query("corr_diff", f"WITH {_CLIPPED}, c AS ({_CORR.format('w')}), o AS ({_CORR.format('lineitem')}) SELECT column1, column2, round(c.correlation, 6) AS corr_filtered, round(o.correlation, 6) AS corr_original, round(abs(c.correlation - o.correlation), 6) AS abs_diff, abs(c.correlation - o.correlation) > 0.2 AS noted FROM c JOIN o USING (column1, column2)")
def _(spark, sf):
    return rounded(numeric.correlation_comparison(read(spark, sf, "lineitem"), LINE))


@query("corr_topk", f"WITH c AS ({_CORR.format('lineitem')}) SELECT column1, column2, round(correlation, 6) AS correlation, round(abs(correlation), 6) AS abs_correlation FROM c WHERE abs(correlation) < 1 ORDER BY abs(correlation) DESC LIMIT 5")
def _(spark, sf):
    return rounded(numeric.strongest_correlations(numeric.correlations(read(spark, sf, "lineitem"), LINE)))


@query("ols_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def _(spark, sf):
    return rounded(numeric.trend(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("structure", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(f"SELECT {k} AS ordinal, '{c}' AS name, '{t}' AS dtype, count({c})::BIGINT AS non_null_count, round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS null_pct FROM labelled" for k, (c, t) in enumerate([("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")])))
def _(spark, sf):
    return numeric.structure(labelled(spark, sf))


@query("structure_size", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(f"SELECT {k} AS ordinal, '{c}' AS name, coalesce(sum({size}), 0)::BIGINT AS bytes FROM labelled" for k, (c, size) in enumerate([(c, {"lang": "octet_length(encode(lang))", "source": "octet_length(encode(source))"}.get(c, f"CASE WHEN {c} IS NOT NULL THEN {w} END")) for c, w in (("doc_id", 8), ("lang", 0), ("source", 0), ("n_chars", 8), ("quality", 4), ("toxic", 4))])))
def _(spark, sf):
    return numeric.structure_size(labelled(spark, sf))


@query("dataset_summary", f"""WITH {LABELLED_SQL}, t AS (SELECT lang, source, quality FROM labelled), s AS (SELECT count(*)::DOUBLE AS n, (count(*) - count(quality))::DOUBLE AS m, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::DOUBLE AS d FROM t)
SELECT 'Total Rows' AS metric, n AS value FROM s UNION ALL SELECT 'Total Columns', 3 UNION ALL SELECT 'Numeric Columns', 1 UNION ALL SELECT 'Categorical Columns', 2 UNION ALL SELECT 'Missing Values', m FROM s UNION ALL SELECT 'Missing %', round(m / (3 * n) * 100, 2) FROM s UNION ALL SELECT 'Duplicate Rows', d FROM s UNION ALL SELECT 'Duplicate %', round(d / n * 100, 2) FROM s""")
def _(spark, sf):
    return numeric.dataset_summary(labelled(spark, sf).select("lang", "source", "quality"))


@query("categorical_summary", f'WITH {FREQ_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS k FROM freq WHERE value IS NOT NULL) SELECT f."column", count(f.value)::BIGINT AS unique_count, any_value(r.value) AS top_value, any_value(r.cnt)::BIGINT AS top_count, coalesce(sum(f.cnt) FILTER (WHERE f.value IS NULL), 0)::BIGINT AS null_count FROM freq f JOIN r ON r."column" = f."column" AND r.k = 1 GROUP BY 1')
def _(spark, sf):
    return numeric.categorical_summary(dirty_texts(spark, sf))


# ---- outliers

_EVENTS_Q = "q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS mu, stddev_pop(value) AS sd, count(value) AS n FROM events)"


def _examples(df: DataFrame, name: str) -> DataFrame:
    """Numbers of the list ``name`` with four places, as one text."""
    return rounded(df.withColumn(name, F.array_join(F.transform(name, lambda x: x.cast("decimal(20,4)").cast("string")), "|")))


def _iqr_sql(factor: int | float) -> str:
    return f"""WITH {_EVENTS_Q}, o AS (SELECT value FROM events, q WHERE value < a - {factor} * (b - a) OR value > b + {factor} * (b - a)), x AS (SELECT DISTINCT value FROM o ORDER BY value LIMIT 5)
SELECT 'value' AS "column", round(a - {factor} * (b - a), 6) AS lower, round(b + {factor} * (b - a), 6) AS upper, (SELECT count(*) FROM o)::BIGINT AS outlier_count, round((SELECT count(*) FROM o)::DOUBLE / n * 100, 2) AS outlier_pct, (SELECT round(min(value), 6) FROM o) AS least, (SELECT round(max(value), 6) FROM o) AS most, (SELECT string_agg(value::DECIMAL(20, 4)::VARCHAR, '|' ORDER BY value) FROM x) AS examples FROM q"""


@query("outlier_iqr3", _iqr_sql(3))
def _(spark, sf):
    return _examples(outliers.iqr_outliers(read(spark, sf, "events"), ["value"], 3.0, of_all_rows=True), "examples")


@query("outlier_iqr15", _iqr_sql(1.5))
def _(spark, sf):
    return _examples(outliers.iqr_outliers(read(spark, sf, "events"), ["value"], 1.5), "examples")


@query("outlier_zscore", f"""WITH {_EVENTS_Q} SELECT 'value' AS "column", any_value(n)::BIGINT AS n, count(*) FILTER (WHERE abs((value - mu) / sd) > 3)::BIGINT AS outlier_count, round(count(*) FILTER (WHERE abs((value - mu) / sd) > 3)::DOUBLE / any_value(n) * 100, 2) AS outlier_pct FROM events, q""")
def _(spark, sf):
    return outliers.zscore_outliers(read(spark, sf, "events"), ["value"])


@query("outlier_union", f"""WITH {_EVENTS_Q}, f AS (SELECT value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS i, abs((value - mu) / sd) > 3 AS z FROM events, q)
SELECT 'value' AS "column", count(*)::BIGINT AS n, count(*) FILTER (WHERE i)::BIGINT AS iqr_count, count(*) FILTER (WHERE z)::BIGINT AS zscore_count, 0::BIGINT AS forest_count, count(*) FILTER (WHERE i OR z)::BIGINT AS outlier_count, round(count(*) FILTER (WHERE i OR z)::DOUBLE / count(*) * 100, 2) AS outlier_pct,
(SELECT string_agg(value::DECIMAL(20, 4)::VARCHAR, '|' ORDER BY value) FROM (SELECT DISTINCT value FROM f WHERE i OR z ORDER BY value LIMIT 10)) AS "values" FROM f""")
def _(spark, sf):
    return _examples(outliers.combined_outliers(read(spark, sf, "events"), ["value"]), "values")


@query("outlier_union_forest")
def _(spark, sf):
    return outliers.combined_outliers(read(spark, sf, "events"), ["value"], isolation=True).drop("values")


@query("outlier_winsor5", f"WITH {_EVENTS_Q} SELECT event_id, round(greatest(a - 5 * (b - a), least(b + 5 * (b - a), value)), 6) AS value FROM events, q")
def _(spark, sf):
    return rounded(numeric.winsorised(read(spark, sf, "events").select("event_id", "value"), ["value"], 5.0))


@query("outlier_iforest")
def _(spark, sf):
    return rounded(outliers.isolation_outliers(read(spark, sf, "events"), "value"))


@query("dbscan", """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer),
near AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5), links AS (SELECT a, b FROM near JOIN core c ON c.id = a JOIN core d ON d.id = b),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b), roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
border AS (SELECT a AS id, root FROM (SELECT n.a, r.root, row_number() OVER (PARTITION BY n.a ORDER BY n.d2, r.root) AS k FROM near n JOIN roots r ON r.id = n.b WHERE n.a NOT IN (SELECT id FROM core)) WHERE k = 1),
placed AS (SELECT *, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS label FROM (SELECT * FROM roots UNION ALL SELECT * FROM border)) SELECT p.id AS c_custkey, coalesce(label, -1)::INTEGER AS label FROM p LEFT JOIN placed ON placed.id = p.id""")
def _(spark, sf):
    return clustering.dbscan(read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("balance"), F.col("c_nationkey").cast("double").alias("nation")), ["balance", "nation"], id_col="c_custkey", eps=1.0, min_samples=5)


@query("reconstruction_error", """WITH s AS (SELECT avg(p_size) AS m1, stddev_samp(p_size) AS s1, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2, sign(corr(p_size, p_retailprice)) AS way FROM part)
SELECT p_partkey, round(pow((p_size - m1) / s1 - way * (p_retailprice - m2) / s2, 2) / 4, 6) AS reconstruction_error, round(abs((p_size - m1) / s1 + way * (p_retailprice - m2) / s2) / sqrt(2), 6) AS latent FROM part, s""")
def _(spark, sf):
    part, features = read(spark, sf, "part"), ["p_size", "p_retailprice"]
    errors = clustering.Reconstruction.fit(part, features).errors(part, "p_partkey")
    return rounded(errors.select("p_partkey", "reconstruction_error", F.abs("latent0").alias("latent")))  # a component's sign is free


@query("outlier_pipeline")
def _(spark, sf):
    found, _ = clustering.outlier_pipeline(read(spark, sf, "part"), id_col="p_partkey", features=["p_size", "p_retailprice"], eps=0.5, min_samples=5)
    return rounded(found)


@query("autoencoder_error")
def _(spark, sf):
    text, words = F.coalesce("text", F.lit("")), F.split(F.coalesce("text", F.lit("")), r"[\s]+")
    kinds = {"chars": F.length(text), "words": F.size(words), "different": F.size(F.array_distinct(words)), "lines": F.size(F.split(text, "\n")), "digits": F.length(text) - F.length(F.translate(text, "0123456789", "")), "capitals": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))}
    shape = stored(read(spark, sf, "documents").select("doc_id", *[F.log1p(v.cast("double")).alias(c) for c, v in kinds.items()]))
    network, linear = clustering.Autoencoder.fit(shape, list(kinds), 2), clustering.Reconstruction.fit(shape, list(kinds), 2)
    both = network.errors(shape, "doc_id").select("doc_id", "reconstruction_error").join(linear.errors(shape, "doc_id").select("doc_id", F.col("reconstruction_error").alias("components_error")), "doc_id")
    return rounded(both)


# ---- sources


def _written(spark: SparkSession, df: DataFrame, kind: str, **options: str) -> str:
    path = f"{shared_folder(spark)}/in-{uuid.uuid4().hex}.{kind}"
    df.write.options(**options).format({"tsv": "csv"}.get(kind, kind)).save(path)
    return path


_ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderkey % 2 = 0 AS even FROM orders"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority", "o_orderkey % 2 = 0 AS even")


@query("read_csv", _ORDERS_SQL)
def _(spark, sf):
    return read_dataset(spark, _written(spark, _orders(spark, sf), "csv", header="true", nullValue="N/A"))


@query("read_tsv", _ORDERS_SQL)
def _(spark, sf):
    return read_dataset(spark, _written(spark, _orders(spark, sf), "tsv", header="true", sep="\t", nullValue="NULL"))


@query("read_csv_lines", """SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '"so", ' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN ', x' || chr(10) || chr(10) ELSE '' END AS note, o_totalprice FROM orders""")
def _(spark, sf):
    """Cells with line breaks, quotes and commas, in files that are read in splits."""
    note = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('\n"so", '), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, ", x\n\n").otherwise(""))
    rows = read(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    return read_dataset(spark, _written(spark, rows, "csv", header="true", escape='"', quoteAll="true", ignoreTrailingWhiteSpace="false"))


@query("read_json", _ORDERS_SQL)
def _(spark, sf):
    return read_dataset(spark, _written(spark, _orders(spark, sf), "json"))


@query("read_parquet", _ORDERS_SQL.replace("o_totalprice,", "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,"))
def _(spark, sf):
    rows = _orders(spark, sf).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, float("nan")).otherwise(F.col("o_totalprice")))
    return read_dataset(spark, _written(spark, rows, "parquet"))


@query("ingest_profile", """WITH t AS (SELECT n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS region FROM nation UNION ALL SELECT 'FRANCE', 3)
SELECT 'csv' AS file_type, (count(*) - count(region))::BIGINT AS total_missing, (count(*) - count(DISTINCT (n_name, region)))::BIGINT AS duplicates, round(avg(region), 6) AS mean_region, count(DISTINCT n_name) FILTER (WHERE n_name <> lower(trim(n_name)))::BIGINT AS inconsistent FROM t""")
def _(spark, sf):
    rows = read(spark, sf, "nation").selectExpr("n_name", "CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS region").union(spark.sql("SELECT 'FRANCE', 3"))
    catalog = _catalog(spark)
    row = catalog.ingest(_written(spark, rows, "csv", header="true"), user_id=1)
    kept = catalog.datasets_of(1).filter(F.col("id") == row["id"])
    number = lambda c, path, kind: F.get_json_object(c, path).cast(kind)
    return rounded(kept.select(
        "file_type", number("missing_values", "$.total_missing", "long").alias("total_missing"), "duplicates", number("summary_stats", "$.region.mean", "double").alias("mean_region"),
        number("categorical_issues", "$.n_name.inconsistent_count", "long").alias("inconsistent"),
    ))


# ---- bundles


@query("bundle_types", SQL["type_examples"])
def _(spark, sf):
    return inference.analyze_types(dirty_texts(spark, sf))["type_issues"].select("column", "inferred_type", joined("examples"))


@query("bundle_categorical", f"""WITH {_standard_sql("substring")}, {_INVALID}, sums AS (SELECT "column", count(value) AS u, sum(cnt) AS n, sum(cnt) FILTER (WHERE value IS NULL) AS missing FROM freq GROUP BY 1),
cased AS (SELECT "column", count(*) OVER (PARTITION BY "column", lower(value)) AS same FROM freq WHERE value IS NOT NULL)
SELECT "column", u::BIGINT AS unique_values, coalesce(missing, 0)::BIGINT AS missing_count, "column" IN (SELECT "column" FROM cased WHERE same > 1) OR "column" IN (SELECT "column" FROM standard WHERE several > 1) OR "column" IN (SELECT "column" FROM invalid) AS has_quality_issues
FROM sums WHERE u > 0 AND u <= least(50, 0.2 * n)""")
def _(spark, sf):
    return categorical.analyze_categorical(dirty_texts(spark, sf))["columns"]


# ---- sampling, catalog and derived


@query("sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def _(spark, sf):
    return sampling.sample_rows(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")


@query("catalog_lookup", "SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS filename, o_custkey AS user_id FROM orders WHERE o_custkey = 7")
def _(spark, sf):
    catalog = _catalog(spark)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.table("datasets").schema.fields}
    given = {"id": F.col("o_orderkey").cast("string").alias("id"), "filename": F.col("o_orderpriority").alias("filename"), "user_id": F.col("o_custkey").alias("user_id")}
    catalog.append("datasets", read(spark, sf, "orders").select(*({**none, **given}).values()))
    return catalog.datasets_of(7).select("id", "filename", "user_id")


@query("catalog_users", """WITH named AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'shared ' || c_nationkey WHEN c_custkey % 11 <> 0 THEN c_name END AS email FROM customer),
one AS (SELECT min(c_custkey) AS id, email FROM named WHERE c_custkey % 2 = 0 AND email IS NOT NULL GROUP BY email),
two AS (SELECT min(c_custkey) AS id, email FROM named WHERE email IS NOT NULL AND email NOT IN (SELECT email FROM one) GROUP BY email)
SELECT id, email, CASE WHEN id % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS company, id % 3 = 0 AS is_active FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN customer ON c_custkey = id WHERE id % 5 <> 0""")
def _(spark, sf):
    catalog, customers = _catalog(spark), read(spark, sf, "customer")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.table("users").schema.fields}
    # some e-mails are shared, within a batch and across batches, and some users have none
    email = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("shared "), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 11 != 0, F.col("c_name"))
    given = {"id": F.col("c_custkey").alias("id"), "email": email.alias("email"), "company": F.col("c_mktsegment").alias("company"), "is_active": F.lit(False).alias("is_active")}
    users = customers.select(*({**none, **given}).values())
    catalog.insert_unique("users", users.filter("id % 2 = 0"), "email")
    catalog.insert_unique("users", users, "email")
    catalog.update("users", F.col("id") % 3 == 0, {"company": "moved", "is_active": True})
    catalog.delete("users", F.col("id") % 5 == 0)
    return catalog.table("users").select("id", "email", "company", "is_active")


@query("quality_light", f"""WITH {LABELLED_SQL}, s AS (SELECT source, (count(*) - count(quality))::DOUBLE / count(*) * 100 AS missing_pct, (count(*) - count(DISTINCT n_chars))::DOUBLE / count(*) AS dup FROM labelled GROUP BY 1)
SELECT source, CASE WHEN missing_pct + dup * 100 < 10 THEN 'good' WHEN missing_pct + dup * 100 < 30 THEN 'warning' ELSE 'poor' END AS light FROM s""")
def _(spark, sf):
    sums = labelled(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("q"), F.count_distinct("n_chars").alias("u"))
    return sums.select("source", numeric.quality_light((F.col("n") - F.col("q")) / F.col("n") * 100, (F.col("n") - F.col("u")) / F.col("n")).alias("light"))


@query("catalog_extend", """WITH cells AS (SELECT 'o_totalprice' AS "column", CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders)
SELECT "column", count(*)::BIGINT AS rows, (count(*) - count(v))::BIGINT AS missing_count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max, true AS quartiles_within, true AS distinct_within FROM cells GROUP BY 1""")
def _(spark, sf):
    """A dataset of a third of the orders, to which two more files are added; estimates are held against all rows."""
    catalog = _catalog(spark)
    rows = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_custkey")
    part = lambda k: _written(spark, rows.filter(F.pmod("o_orderkey", F.lit(3)) == k).drop("o_orderkey"), "parquet")
    dataset = catalog.ingest(part(0), "parquet", user_id=1)["id"]
    for k in (1, 2):
        catalog.extend(dataset, part(k), "parquet")
    told = catalog.measures_of(dataset).filter("column IS NOT NULL")
    cells = outliers.cells(rows, ["o_totalprice", "o_custkey"]).filter("value IS NOT NULL").join(F.broadcast(told.select("column", "q25", "q50", "q75")), "column")  # a row for each column
    below = [F.avg((F.col("value") < F.col(q)).cast("int")).alias(f"lt_{q}") for q in ("q25", "q50", "q75")] + [F.avg((F.col("value") <= F.col(q)).cast("int")).alias(f"le_{q}") for q in ("q25", "q50", "q75")]
    exact = cells.groupBy("column").agg(F.count_distinct("value").alias("n"), *below)
    ranked = F.lit(True)
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        ranked = ranked & (F.col(f"lt_{q}") <= p + sketches.RANK_ERROR) & (F.col(f"le_{q}") >= p - sketches.RANK_ERROR)
    near = F.abs(F.col("distinct") - F.col("n")) <= sketches.DISTINCT_ERROR * F.col("n") + 1
    out = told.join(exact, "column")
    return out.select("column", "rows", "missing_count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", ranked.alias("quartiles_within"), near.alias("distinct_within"))
