"""The same results as plain SQL over the source tables, written independently.

Each text is a chain of common table expressions in textbook form: windows, self-joins
and one aggregation per metric, where the Spark operators use combined forms.
"""

from __future__ import annotations

from tallymark.contracts import VARIABLE_DEFINITIONS

RAW_COLUMNS = (
    "Year", "Industry_aggregation_NZSIOC", "Industry_code_NZSIOC", "Industry_name_NZSIOC", "Units",
    "Variable_code", "Variable_name", "Variable_category", "Value", "Industry_code_ANZSIC06",
)
BRONZE_COLUMNS = [(name, "string") for name in RAW_COLUMNS] + [
    ("ingestion_id", "string"), ("source_file", "string"), ("source_url", "string"), ("source_sha256", "string"),
    ("dataset_year", "int"), ("dataset_version", "string"), ("ingestion_timestamp", "timestamp"),
    ("row_count", "bigint"), ("schema_version", "string"), ("source_row_number", "bigint"),
]
KEY = "Year, Industry_aggregation_NZSIOC, Industry_code_NZSIOC, Variable_code"
IDENTITY = "year, industry_aggregation_nzsioc, industry_code_nzsioc"

CELLS = """
placed AS (
    SELECT year(o_orderdate) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
           o_orderstatus = 'F' AS filled, c_custkey, c_name, n_name, r_name
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), levels AS (
    SELECT 'Level 1' AS level, r_name AS code, r_name AS name, 0 AS k, year, price, filled FROM placed
    UNION ALL SELECT 'Level 3', n_name, n_name, 0, year, price, filled FROM placed
    UNION ALL SELECT 'Level 4', 'C' || c_custkey, c_name, c_custkey, year, price, filled FROM placed
), cells AS (
    SELECT level, code, name, k, year, count(*) AS n,
           CAST(round(sum(price), 0) AS BIGINT) AS income,
           CAST(round(sum(CASE WHEN filled THEN price ELSE -price END), 0) AS BIGINT) AS surplus
    FROM levels GROUP BY level, code, name, k, year
), variables AS (
    SELECT level, code, name, k, year, n, 'H01' AS v, 'Total income' AS vname,
           'Financial performance' AS vcat, 'Dollars (millions)' AS units, income AS number FROM cells
    UNION ALL SELECT level, code, name, k, year, n, 'H23', 'Surplus before income tax',
           'Financial performance', 'Dollars (millions)', surplus FROM cells
    UNION ALL SELECT level, code, name, k, year, n, 'H40', 'Return on total assets',
           'Financial ratios', 'Percentage',
           CAST(round(CAST(surplus AS DOUBLE) * 100 / nullif(CAST(income AS DOUBLE), 0), 0) AS BIGINT)
           FROM cells
), released AS (
    SELECT *, 'R1' AS release, 2025 AS dataset_year, '2025-financial-year-provisional' AS dataset_version
    FROM variables
    UNION ALL
    SELECT level, code, name, k, year, n, v, vname, vcat, units,
           number + CASE WHEN (year + k) % 3 = 0 THEN 1 ELSE 0 END, 'R2', 2026,
           '2026-financial-year-provisional'
    FROM variables WHERE year >= 2000 AND k % 7 <> 3
), bronze AS (
    SELECT CAST(year AS VARCHAR) AS Year, level AS Industry_aggregation_NZSIOC,
           code AS Industry_code_NZSIOC, name AS Industry_name_NZSIOC, units AS Units,
           v AS Variable_code, vname AS Variable_name, vcat AS Variable_category,
           CASE WHEN k > 0 AND k % 107 = 0 AND v = 'H01' AND year % 2 = 0 THEN '0'
                WHEN k > 0 AND k % 101 = 0 THEN 'bad'
                WHEN k > 0 AND k % 103 = 0 THEN ' '
                WHEN k > 0 AND n = 1 AND k % 5 = 0 AND v = 'H23' THEN 'C'
                WHEN k > 0 AND k % 17 = 0 AND v = 'H40' THEN 'S'
                ELSE format('{:,}', number) END AS Value,
           'ANZSIC ' || code AS Industry_code_ANZSIC06,
           upper(sha256(release)) AS ingestion_id, release, dataset_year, dataset_version,
           'releases/' || release || '.csv' AS source_file,
           count(*) OVER (PARTITION BY release) AS row_count,
           row_number() OVER (PARTITION BY release ORDER BY level, k, code, year, v) AS source_row_number
    FROM released
)"""

def _quoted(fields) -> str:
    """One line of a file with all fields in quotes."""
    return " || ',' || ".join(f"""'"' || replace({f}, '"', '""') || '"'""" for f in fields)


# The same number rule in the oracle's regular-expression dialect.
NUMERIC = r"regexp_matches(Value, '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?$')"

SILVER = rf"""
ranked AS (
    SELECT *, max(dataset_year) OVER (PARTITION BY {KEY}) AS top_year,
           count(*) OVER (PARTITION BY ingestion_id, {KEY}) AS same_key,
           count(*) OVER (PARTITION BY ingestion_id, source_row_number) AS same_number,
           count(*) OVER (PARTITION BY ingestion_id) AS stored
    FROM bronze
), current_rows AS (
    SELECT * FROM ranked WHERE dataset_year = top_year
), typed AS (
    SELECT *,
           CASE WHEN trim(Value, ' ') = '' THEN 'UNAVAILABLE' WHEN Value = 'C' THEN 'CONFIDENTIAL'
                WHEN Value = 'S' THEN 'SUPPRESSED' WHEN {NUMERIC} THEN 'PUBLISHED'
                ELSE 'INVALID' END AS value_status
    FROM current_rows
), silver AS (
    SELECT ingestion_id || ':' || source_row_number AS record_id,
           CAST(Year AS INTEGER) AS year, Year AS year_raw,
           Industry_aggregation_NZSIOC AS industry_aggregation_nzsioc,
           Industry_code_NZSIOC AS industry_code_nzsioc,
           Industry_name_NZSIOC AS industry_name_nzsioc,
           Industry_code_ANZSIC06 AS industry_code_anzsic06,
           Variable_code AS variable_code, Variable_name AS variable_name,
           Variable_category AS variable_category, Units AS units, Value AS value_raw,
           CASE WHEN value_status = 'PUBLISHED'
                THEN CAST(replace(Value, ',', '') AS DECIMAL(38,18)) END AS value_numeric,
           value_status,
           concat_ws(',', CASE WHEN value_status = 'UNAVAILABLE' THEN 'VALUE_UNAVAILABLE' END,
                     CASE WHEN value_status = 'INVALID' THEN 'VALUE_INVALID' END,
                     CASE WHEN same_key > 1 THEN 'OBSERVATION_DUPLICATE' END,
                     CASE WHEN same_number > 1 THEN 'SOURCE_ROW_NUMBER_DUPLICATE' END,
                     CASE WHEN stored <> row_count THEN 'SOURCE_ROW_COUNT_MISMATCH' END) AS failed,
           ingestion_id, dataset_year, dataset_version, row_count AS source_row_count,
           source_row_number, stored
    FROM typed
), artifacts AS (
    SELECT DISTINCT ingestion_id FROM bronze
), silver_print AS (
    SELECT upper(sha256(string_agg(ingestion_id || ':' || ingestion_id, chr(10)
                                   ORDER BY ingestion_id))) AS sfp FROM artifacts
), gold_print AS (
    SELECT sfp, upper(sha256(concat_ws(chr(10), 'aes-gold-metrics-v1', 'aes-gold-rules-v3', sfp))) AS gfp
    FROM silver_print
)"""


# A release with flaws on some rows of every kind, and each rule as its own condition.
FLAWED = rf"""
numbered AS (SELECT *, source_row_number % 97 AS m, 'x' AS sha FROM bronze WHERE release = 'R1'),
flawed AS (
    SELECT CASE m WHEN 1 THEN '' WHEN 2 THEN '20x5' ELSE Year END AS y,
           CASE m WHEN 3 THEN '' WHEN 4 THEN 'Level 2' ELSE Industry_aggregation_NZSIOC END AS lvl,
           CASE m WHEN 5 THEN '' WHEN 15 THEN 'TWICE' ELSE Industry_code_NZSIOC END AS code,
           CASE m WHEN 6 THEN ' ' ELSE Industry_name_NZSIOC END AS name,
           CASE m WHEN 7 THEN '' ELSE Industry_code_ANZSIC06 END AS anzsic,
           CASE m WHEN 8 THEN '' ELSE Variable_code END AS v,
           CASE m WHEN 9 THEN '' WHEN 12 THEN 'Other income' ELSE Variable_name END AS vname,
           CASE m WHEN 10 THEN '' ELSE Variable_category END AS vcat,
           CASE m WHEN 11 THEN '' ELSE Units END AS un,
           CASE m WHEN 13 THEN ' ' WHEN 14 THEN 'n/a' ELSE Value END AS Value,
           CASE m WHEN 18 THEN -1 ELSE source_row_number END AS number,
           CASE m WHEN 19 THEN row_count + 1 ELSE row_count END AS stated,
           m = 16 AS no_file, m = 17 AS other_sha, ingestion_id
    FROM numbered
), facts AS (
    SELECT *, CASE WHEN trim(Value, ' ') = '' THEN 'UNAVAILABLE' WHEN Value = 'C' THEN 'CONFIDENTIAL'
                   WHEN Value = 'S' THEN 'SUPPRESSED' WHEN {NUMERIC} THEN 'PUBLISHED' ELSE 'INVALID' END AS status,
           count(*) OVER (PARTITION BY y, lvl, code, v) AS same_key,
           count(*) OVER (PARTITION BY number) AS same_number, count(*) OVER () AS stored
    FROM flawed
), verdicts AS (
    SELECT *, list_filter([
        CASE WHEN y = '' THEN 'YEAR_REQUIRED' END,
        CASE WHEN y = '20x5' THEN 'YEAR_INVALID_FORMAT' END,
        CASE WHEN lvl = '' THEN 'INDUSTRY_AGGREGATION_REQUIRED' END,
        CASE WHEN lvl = 'Level 2' THEN 'INDUSTRY_AGGREGATION_UNEXPECTED' END,
        CASE WHEN code = '' THEN 'INDUSTRY_CODE_REQUIRED' END,
        CASE WHEN trim(name) = '' THEN 'INDUSTRY_NAME_REQUIRED' END,
        CASE WHEN anzsic = '' THEN 'ANZSIC_MAPPING_REQUIRED' END,
        CASE WHEN v = '' THEN 'VARIABLE_CODE_REQUIRED' END,
        CASE WHEN vname = '' THEN 'VARIABLE_NAME_REQUIRED' END,
        CASE WHEN vcat = '' THEN 'VARIABLE_CATEGORY_REQUIRED' END,
        CASE WHEN un = '' THEN 'UNITS_REQUIRED' END,
        CASE WHEN vname = 'Other income' THEN 'VARIABLE_DEFINITION_UNEXPECTED' END,
        CASE WHEN status = 'UNAVAILABLE' THEN 'VALUE_UNAVAILABLE' END,
        CASE WHEN status = 'INVALID' THEN 'VALUE_INVALID' END,
        CASE WHEN same_key > 1 THEN 'OBSERVATION_DUPLICATE' END,
        CASE WHEN no_file THEN 'LINEAGE_REQUIRED' END,
        CASE WHEN other_sha THEN 'LINEAGE_ID_MISMATCH' END,
        CASE WHEN number NOT BETWEEN 1 AND stated THEN 'SOURCE_ROW_NUMBER_INVALID' END,
        CASE WHEN same_number > 1 THEN 'SOURCE_ROW_NUMBER_DUPLICATE' END,
        CASE WHEN stored <> stated THEN 'SOURCE_ROW_COUNT_MISMATCH' END], lambda x: x IS NOT NULL) AS failed
    FROM facts)"""


# That release as Silver rows, for the same Gold and quality texts as above.
DIRTY = """
dirty AS (
    SELECT ingestion_id || ':' || number AS record_id, TRY_CAST(y AS INTEGER) AS year, y AS year_raw,
           lvl AS industry_aggregation_nzsioc, code AS industry_code_nzsioc, name AS industry_name_nzsioc,
           anzsic AS industry_code_anzsic06, v AS variable_code, vname AS variable_name, vcat AS variable_category,
           un AS units, Value AS value_raw, status AS value_status,
           CASE WHEN status = 'PUBLISHED' THEN CAST(replace(Value, ',', '') AS DECIMAL(38,18)) END AS value_numeric,
           array_to_string(failed, ',') AS failed, ingestion_id, number, stated, stored, same_number, no_file, other_sha,
           number % 97 AS m
    FROM verdicts
)"""


def _of_dirty(text: str) -> str:
    return text.replace("FROM silver", "FROM dirty")


def _direct(metric: str, unit: str, code: str, name: str, category: str, units: str) -> str:
    return f"""
    SELECT s.year, s.industry_aggregation_nzsioc, s.industry_code_nzsioc,
           s.industry_name_nzsioc, '{metric}' AS metric_id, '{name}' AS metric_name,
           '{unit}' AS metric_unit,
           CASE WHEN s.definitions <> 1 THEN 'INVALID_VALUE'
                WHEN m.n IS NULL THEN 'UNAVAILABLE'
                WHEN m.n > 1 THEN 'INVALID_DUPLICATE'
                WHEN m.described <> 1 THEN 'INVALID_VALUE'
                WHEN m.status IN ('CONFIDENTIAL', 'SUPPRESSED', 'UNAVAILABLE') THEN m.status
                WHEN m.status = 'PUBLISHED' AND m.valid AND m.number IS NOT NULL THEN 'PUBLISHED'
                ELSE 'INVALID_VALUE' END AS metric_status,
           m.number AS number, coalesce(m.records, []) AS records
    FROM scaffold s LEFT JOIN (
        SELECT {IDENTITY}, count(*) AS n,
               sum(CASE WHEN variable_name = '{name}' AND variable_category = '{category}'
                         AND units = '{units}' THEN 1 ELSE 0 END) AS described,
               min(value_status) AS status, bool_and(failed = '') AS valid,
               min(value_numeric) AS number, list_sort(list(DISTINCT record_id)) AS records
        FROM silver WHERE variable_code = '{code}' GROUP BY {IDENTITY}) m
    USING ({IDENTITY})"""


def _change(metric: str, source: str, name: str, unit: str) -> str:
    both = "c.metric_status = 'PUBLISHED' AND coalesce(p.metric_status, '') = 'PUBLISHED'"
    if metric == "M4":
        status = f"""CASE WHEN NOT ({both}) THEN 'UNAVAILABLE_INPUT'
                WHEN p.number <= 0 THEN 'NOT_MEANINGFUL_BASE' ELSE 'PUBLISHED' END"""
        value = """(CAST(c.number AS DOUBLE) - CAST(p.number AS DOUBLE)) * 100
                / nullif(CAST(p.number AS DOUBLE), 0)"""
    else:
        status = f"CASE WHEN NOT ({both}) THEN 'UNAVAILABLE_INPUT' ELSE 'PUBLISHED' END"
        value = "CAST(c.number - p.number AS DOUBLE)"
    return f"""
    SELECT c.year, c.industry_aggregation_nzsioc, c.industry_code_nzsioc, c.industry_name_nzsioc,
           '{metric}' AS metric_id, '{name}' AS metric_name, '{unit}' AS metric_unit,
           {status} AS metric_status, {value} AS raw_value,
           c.metric_status AS current_input_status,
           coalesce(p.metric_status, 'UNAVAILABLE') AS prior_input_status,
           list_concat(c.records, coalesce(p.records, [])) AS records
    FROM direct c LEFT JOIN direct p
      ON p.metric_id = c.metric_id AND p.year = c.year - 1
     AND p.industry_aggregation_nzsioc = c.industry_aggregation_nzsioc
     AND p.industry_code_nzsioc = c.industry_code_nzsioc
    WHERE c.metric_id = '{source}'"""


GOLD = f"""
scaffold AS (
    SELECT {IDENTITY}, min(industry_name_nzsioc) AS industry_name_nzsioc,
           count(DISTINCT industry_name_nzsioc || '~' || industry_code_anzsic06) AS definitions
    FROM silver GROUP BY {IDENTITY}
), direct AS (
{_direct("M1", "NZD millions", "H01", "Total income", "Financial performance", "Dollars (millions)")}
    UNION ALL
{_direct("M2", "NZD millions", "H23", "Surplus before income tax", "Financial performance", "Dollars (millions)")}
    UNION ALL
{_direct("M3", "Percent", "H40", "Return on total assets", "Financial ratios", "Percentage")}
), changes AS (
{_change("M4", "M1", "Total income year-over-year growth", "Percent change")}
    UNION ALL
{_change("M5", "M2", "Surplus before income tax year-over-year change", "NZD millions change")}
    UNION ALL
{_change("M6", "M3", "Return on total assets year-over-year change", "Percentage points")}
), metrics AS (
    SELECT year, industry_aggregation_nzsioc, industry_code_nzsioc, industry_name_nzsioc,
           metric_id, metric_name, metric_unit, metric_status,
           CASE WHEN metric_status = 'PUBLISHED' THEN CAST(number AS DOUBLE) END AS exact,
           metric_status AS current_input_status, CAST(NULL AS VARCHAR) AS prior_input_status,
           records FROM direct
    UNION ALL
    SELECT year, industry_aggregation_nzsioc, industry_code_nzsioc, industry_name_nzsioc,
           metric_id, metric_name, metric_unit, metric_status,
           CASE WHEN metric_status = 'PUBLISHED' THEN raw_value END,
           current_input_status, prior_input_status, records FROM changes
), gold AS (
    SELECT m.*, round(exact, 6) AS metric_value, array_to_string(records, ',') AS record_ids,
           sha256(concat_ws('|', gfp, CAST(year AS VARCHAR), industry_aggregation_nzsioc,
                            industry_code_nzsioc, metric_id)) AS metric_record_id, sfp, gfp
    FROM metrics m, gold_print
)"""


def _ranked(kind: str) -> str:
    keep = {"top_increases": "exact > 0", "top_decreases": "exact < 0"}.get(kind, "true")
    order = {"top_increases": "exact DESC", "top_decreases": "exact ASC"}.get(kind, "abs(exact) DESC")
    return f"""
    SELECT '{kind}' AS ranking_type, year, industry_aggregation_nzsioc, metric_id, metric_name,
           metric_unit, metric_status, industry_code_nzsioc, industry_name_nzsioc, metric_value,
           abs(metric_value) AS absolute_metric_value, metric_record_id,
           CAST(row_number() OVER (PARTITION BY year, metric_id, industry_aggregation_nzsioc
               ORDER BY {order}, industry_code_nzsioc, industry_name_nzsioc, metric_record_id)
               AS INTEGER) AS rank_position
    FROM gold WHERE metric_id IN ('M4', 'M5', 'M6') AND metric_status = 'PUBLISHED' AND {keep}"""


def _chain(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


RAW = _chain(CELLS)
TO_SILVER = _chain(CELLS, SILVER)
TO_GOLD = _chain(CELLS, SILVER, GOLD)

PAIRS = f"""
incoming AS (SELECT * FROM bronze WHERE release = 'R2'),
stored AS (SELECT * FROM bronze WHERE release = 'R1'),
pairs AS (
    SELECT n.Value AS new_value, o.Value AS old_value, n.release AS new_release,
           o.release AS old_release, n.Value IS DISTINCT FROM o.Value AS value_changed,
           (n.Industry_name_NZSIOC, n.Units, n.Variable_name, n.Variable_category,
            n.Industry_code_ANZSIC06) IS DISTINCT FROM
           (o.Industry_name_NZSIOC, o.Units, o.Variable_name, o.Variable_category,
            o.Industry_code_ANZSIC06) AS metadata_changed
    FROM incoming n FULL OUTER JOIN stored o USING ({KEY})
)"""


def _class(value: str) -> str:
    numeric = NUMERIC.replace("Value", value)
    return (
        f"CASE WHEN {value} = 'C' THEN 'CONFIDENTIAL' WHEN {value} = 'S' THEN 'SUPPRESSED' "
        f"WHEN {numeric} THEN 'PUBLISHED' ELSE 'OTHER' END"
    )


def _count(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


GOLD_COLUMNS = """metric_record_id, year, industry_aggregation_nzsioc, industry_code_nzsioc,
    industry_name_nzsioc, metric_id, metric_name, metric_unit, metric_status, metric_value,
    current_input_status, prior_input_status, record_ids"""
SERVED = """year, industry_code_nzsioc AS industry_code, industry_name_nzsioc AS industry_name,
    industry_aggregation_nzsioc AS aggregation_level, metric_id, metric_name, metric_value,
    metric_status, metric_unit, current_input_status, prior_input_status"""
RANKED = """ranking_type, rank_position, year, industry_aggregation_nzsioc, metric_id, metric_name,
    metric_unit, metric_status, industry_code_nzsioc, industry_name_nzsioc, metric_value,
    absolute_metric_value, metric_record_id"""

QUALITY = [
    # rule id, severity, condition counted over silver (null: schema check)
    ("DQ_SCHEMA_REQUIRED_COLUMNS", "BLOCKING", None),
    ("DQ_SCHEMA_UNEXPECTED_COLUMNS", "BLOCKING", None),
    ("DQ_SCHEMA_COLUMN_TYPES", "BLOCKING", None),
    ("DQ_COMPLETENESS_REQUIRED_DIMENSIONS", "BLOCKING",
     "year IS NULL OR trim(industry_code_nzsioc) = '' OR trim(industry_name_nzsioc) = ''"),
    ("DQ_VALIDITY_YEAR", "BLOCKING", "NOT regexp_matches(year_raw, '^[0-9]{4}$')"),
    ("DQ_VALIDITY_AGGREGATION_LEVEL", "BLOCKING",
     "industry_aggregation_nzsioc NOT IN ('Level 1', 'Level 3', 'Level 4')"),
    ("DQ_VALIDITY_VARIABLE_DEFINITION", "BLOCKING",
     """(variable_code, variable_name, variable_category, units) NOT IN (
         ('H01', 'Total income', 'Financial performance', 'Dollars (millions)'),
         ('H23', 'Surplus before income tax', 'Financial performance', 'Dollars (millions)'),
         ('H40', 'Return on total assets', 'Financial ratios', 'Percentage'))"""),
    ("DQ_VALIDITY_VALUE_STATE", "BLOCKING",
     "(value_status = 'PUBLISHED') <> (value_numeric IS NOT NULL)"),
    ("DQ_UNIQUENESS_RECORD_ID", "BLOCKING", "same_record > 1"),
    ("DQ_UNIQUENESS_OBSERVATION_GRAIN", "BLOCKING", "same_grain > 1"),
    ("DQ_CONTRACT_VALIDATION_OUTCOME", "BLOCKING", "false"),
    ("DQ_CONTRACT_INVALID_ROWS", "BLOCKING", "failed <> ''"),
    ("DQ_CONTRACT_LINEAGE", "BLOCKING",
     "same_number > 1 OR stored <> source_row_count OR source_row_number > source_row_count"),
    ("DQ_INFO_CONFIDENTIAL_ROWS", "INFORMATIONAL", "value_status = 'CONFIDENTIAL'"),
    ("DQ_INFO_SUPPRESSED_ROWS", "INFORMATIONAL", "value_status = 'SUPPRESSED'"),
    ("DQ_INFO_NEGATIVE_PUBLISHED_ROWS", "INFORMATIONAL",
     "value_status = 'PUBLISHED' AND value_numeric < 0"),
]

QUALITY_CHECKS = f"""
described AS (
    SELECT *, count(*) OVER (PARTITION BY record_id) AS same_record,
           count(*) OVER (PARTITION BY ingestion_id, {IDENTITY}, variable_code) AS same_grain,
           count(*) OVER (PARTITION BY ingestion_id, source_row_number) AS same_number
    FROM silver
), counted AS (
    {" UNION ALL ".join(
        f"SELECT {i} AS check_number, '{rule}' AS rule_id, '{severity}' AS severity, "
        + ("CAST(NULL AS BIGINT) AS affected_rows" if condition is None
           else f"(SELECT {_count(condition)} FROM described) AS affected_rows")
        for i, (rule, severity, condition) in enumerate(QUALITY, start=1))}
), checks AS (
    SELECT *, CASE WHEN affected_rows IS NULL OR affected_rows = 0 OR severity = 'INFORMATIONAL'
              THEN 'PASS' ELSE 'FAIL' END AS status FROM counted
)"""


_DIMENSIONS = ("industry_aggregation_nzsioc", "industry_code_nzsioc", "industry_name_nzsioc", "industry_code_anzsic06",
               "variable_code", "variable_name", "variable_category", "units")
#: The checks with what they count where rows are flawed, and some values and outcomes altered.
DIRTY_CONDITIONS = {
    "DQ_COMPLETENESS_REQUIRED_DIMENSIONS": "year IS NULL OR " + " OR ".join(f"trim({d}) = ''" for d in _DIMENSIONS),
    "DQ_VALIDITY_VALUE_STATE": "value_status = 'PUBLISHED' AND m = 20",
    "DQ_CONTRACT_VALIDATION_OUTCOME": "m = 21",
    "DQ_CONTRACT_LINEAGE": "no_file OR other_sha OR number NOT BETWEEN 1 AND stated OR stored <> stated OR same_number > 1",
    "DQ_INFO_NEGATIVE_PUBLISHED_ROWS": "value_status = 'PUBLISHED' AND value_numeric < 0 AND m <> 20",
}


def _dirty_checks() -> str:
    counts = " UNION ALL ".join(
        f"SELECT {i} AS check_number, '{rule}' AS rule_id, '{severity}' AS severity, "
        + ("CAST(NULL AS BIGINT) AS affected_rows" if condition is None
           else f"(SELECT {_count(DIRTY_CONDITIONS.get(rule, condition))} FROM described) AS affected_rows")
        for i, (rule, severity, condition) in enumerate(QUALITY, start=1))
    return f"""
        , described AS (
            SELECT *, count(*) OVER (PARTITION BY record_id) AS same_record,
                   count(*) OVER (PARTITION BY ingestion_id, {IDENTITY}, variable_code) AS same_grain FROM dirty),
        counted AS ({counts})
        SELECT CAST(check_number AS INTEGER) AS check_number, rule_id, severity, affected_rows,
               CASE WHEN affected_rows IS NULL OR affected_rows = 0 OR severity = 'INFORMATIONAL'
                    THEN 'PASS' ELSE 'FAIL' END AS status FROM counted"""


def oracle_sql() -> dict[str, str]:
    rank = {kind: TO_GOLD + f", board AS ({_ranked(kind)}) SELECT {RANKED} FROM board "
            "WHERE rank_position <= 5"
            for kind in ("top_increases", "top_decreases", "largest_movements")}
    bounded = (
        TO_GOLD + f", board AS ({_ranked('top_increases')}) SELECT {RANKED} FROM board "
        "WHERE rank_position <= 10 AND year = 2000 AND metric_id = 'M4' "
        "AND industry_aggregation_nzsioc = 'Level 4'"
    )
    one_plan = f"""SELECT CAST(layer_order AS INTEGER) AS layer_order, layer, action,
        current_identities, expected_identity, 'PROCESS_REQUIRED' AS pipeline_status,
        'ALREADY_PROCESSED' AS artifact_status FROM (
        SELECT 1 AS layer_order, 'Bronze' AS layer, 'CURRENT' AS action,
            (SELECT string_agg(ingestion_id, ',' ORDER BY ingestion_id) FROM artifacts) AS current_identities,
            upper(sha256('R2')) AS expected_identity
        UNION ALL SELECT 2, 'Silver', 'REQUIRED',
            upper(sha256(upper(sha256('R1')) || ':' || upper(sha256('R1')))), sfp FROM gold_print
        UNION ALL SELECT 3, 'Gold', 'REQUIRED', upper(sha256(concat_ws(chr(10),
            'aes-gold-metrics-v1', 'aes-gold-rules-v3',
            upper(sha256(upper(sha256('R1')) || ':' || upper(sha256('R1'))))))), gfp FROM gold_print)"""
    silver_rows = TO_SILVER + """
        SELECT record_id, year, industry_aggregation_nzsioc, industry_code_nzsioc,
               industry_name_nzsioc, industry_code_anzsic06, variable_code, variable_name,
               variable_category, units, value_raw, CAST(value_numeric AS DOUBLE) AS value_numeric,
               value_status, failed = '' AS is_valid, failed AS validation_rule_ids, ingestion_id,
               CAST(dataset_year AS INTEGER) AS dataset_year, source_row_count, source_row_number,
               sfp AS silver_input_fingerprint
        FROM silver, silver_print"""
    lineage = f"""
        , records AS (SELECT {IDENTITY}, record_id, ingestion_id,
            CASE variable_code WHEN 'H01' THEN 1 WHEN 'H23' THEN 2 ELSE 3 END AS number
            FROM silver WHERE variable_code IN ('H01', 'H23', 'H40')),
        roles AS (
            SELECT *, 'M' || number AS metric_id, 'current' AS role FROM records
            UNION ALL SELECT *, 'M' || (number + 3), 'current' FROM records
            UNION ALL SELECT * REPLACE (year + 1 AS year), 'M' || (number + 3), 'prior' FROM records)
        SELECT metric_record_id, metric_id, role, record_id, ingestion_id
        FROM roles JOIN (SELECT metric_record_id, metric_id, {IDENTITY} FROM gold)
        USING (metric_id, {IDENTITY})"""
    # A record without a year still has an id.
    of_dirty = _of_dirty(GOLD).replace("CAST(year AS VARCHAR)", "coalesce(CAST(year AS VARCHAR), '<null>')")
    definitions = ", ".join(
        "({}, {})".format(i, ", ".join(f"'{text}'" for text in definition)) for i, definition in enumerate(VARIABLE_DEFINITIONS)
    )
    audits = {
        "audit_silver": TO_SILVER + f"""
            SELECT 'published_with_null_numeric' AS check_name,
                   {_count("value_status = 'PUBLISHED' AND value_numeric IS NULL")} AS rows FROM silver
            UNION ALL SELECT 'protected_with_numeric',
                   {_count("value_status IN ('CONFIDENTIAL', 'SUPPRESSED') AND value_numeric IS NOT NULL")} FROM silver
            UNION ALL SELECT 'negative_published_values',
                   {_count("value_status = 'PUBLISHED' AND value_numeric < 0")} FROM silver
            UNION ALL SELECT 'confidential_raw_mismatches',
                   {_count("value_raw = 'C' AND value_status <> 'CONFIDENTIAL'")} FROM silver
            UNION ALL SELECT 'suppressed_raw_mismatches',
                   {_count("value_raw = 'S' AND value_status <> 'SUPPRESSED'")} FROM silver""",
        "audit_gold": TO_GOLD + f"""
            SELECT 'protected_numeric_leaks' AS check_name,
                   {_count("metric_status IN ('CONFIDENTIAL', 'SUPPRESSED') AND metric_value IS NOT NULL")} AS rows FROM gold
            UNION ALL SELECT 'unavailable_numeric_leaks',
                   {_count("metric_status <> 'PUBLISHED' AND metric_value IS NOT NULL")} FROM gold
            UNION ALL SELECT 'missing_lineage_rows', {_count("sfp IS NULL OR gfp IS NULL")} FROM gold
            UNION ALL SELECT 'repeated_grain_rows', CAST(count(*) - count(DISTINCT metric_record_id) AS BIGINT)
                   FROM gold""",
        "audit_rankings": TO_GOLD + f""", board AS (
            {" UNION ALL ".join(_ranked(kind) for kind in ("top_increases", "top_decreases", "largest_movements"))}
            ), top AS (SELECT * FROM board WHERE rank_position <= 3), spans AS (
                SELECT ranking_type, year, metric_id, industry_aggregation_nzsioc,
                       max(rank_position) <> count(*) OR min(rank_position) <> 1 AS broken
                FROM top GROUP BY 1, 2, 3, 4)
            SELECT 'missing_unit_or_value' AS check_name,
                   {_count("metric_unit IS NULL OR metric_value IS NULL")} AS rows FROM top
            UNION ALL SELECT 'wrong_magnitude', {_count("abs(metric_value) <> absolute_metric_value")} FROM top
            UNION ALL SELECT 'wrong_sign', {_count("(ranking_type = 'top_increases' AND metric_value < 0) OR (ranking_type = 'top_decreases' AND metric_value > 0)")} FROM top
            UNION ALL SELECT 'partitions_without_dense_positions', {_count("broken")} FROM spans
            UNION ALL SELECT 'unpublished_ranked', {_count("metric_status <> 'PUBLISHED'")} FROM top""",
        "lineage_audit": TO_SILVER + """
            SELECT 'lineage_or_raw_value_mismatches' AS check_name, count(*) AS rows
            FROM silver s LEFT JOIN bronze b
              ON s.ingestion_id = b.ingestion_id AND s.source_row_number = b.source_row_number
            WHERE b.Value IS NULL OR b.Value <> s.value_raw""",
    }
    return {
        "raw_observations": RAW + """
            SELECT Year, Industry_aggregation_NZSIOC, Industry_code_NZSIOC, Industry_name_NZSIOC,
                   Units, Variable_code, Variable_name, Variable_category, Value,
                   Industry_code_ANZSIC06, ingestion_id, source_file,
                   CAST(dataset_year AS INTEGER) AS dataset_year,
                   dataset_version, row_count, source_row_number FROM bronze""",
        "bronze_profile": RAW + f"""
            SELECT ingestion_id, count(*) AS rows, {_count("Value = 'C'")} AS confidential_markers,
                   {_count("Value = 'S'")} AS suppressed_markers, CAST(1 AS BIGINT) AS metadata_records,
                   max(row_count) AS stated_rows FROM bronze GROUP BY ingestion_id""",
        "current_view": TO_SILVER + f"""
            SELECT {KEY}, Value, ingestion_id, CAST(dataset_year AS INTEGER) AS dataset_year,
                   source_row_number FROM current_rows""",
        "release_ambiguity": RAW + f"""
            SELECT {KEY}, count(DISTINCT ingestion_id) AS release_count FROM bronze
            GROUP BY {KEY} HAVING count(DISTINCT ingestion_id) > 1""",
        "value_typing": TO_SILVER + """
            SELECT record_id, value_raw, value_status, CAST(value_numeric AS DOUBLE) AS value_numeric
            FROM silver""",
        "row_validation": TO_SILVER + """
            SELECT record_id, record_status, failed AS validation_rule_ids FROM (
                SELECT record_id, failed,
                       CASE WHEN failed = '' THEN 'VALID' ELSE 'INVALID' END AS record_status
                FROM silver)""",
        "validation_distribution": TO_SILVER + """
            SELECT rule_id, count(*) AS rows FROM (
                SELECT unnest(string_split(failed, ',')) AS rule_id FROM silver WHERE failed <> '')
            GROUP BY rule_id""",
        "flawed_distribution": _chain(CELLS, FLAWED) + """
            SELECT rule_id, count(*) AS rows FROM (SELECT unnest(failed) AS rule_id FROM verdicts) GROUP BY rule_id""",
        "flawed_rows": _chain(CELLS, FLAWED) + """
            SELECT ingestion_id || ':' || number AS record_id, TRY_CAST(y AS INTEGER) AS year, status AS value_status,
                   CASE WHEN status = 'PUBLISHED' THEN CAST(replace(Value, ',', '') AS DOUBLE) END AS value_numeric,
                   CASE WHEN len(failed) = 0 THEN 'VALID' ELSE 'INVALID' END AS record_status,
                   array_to_string(failed, ',') AS validation_rule_ids, CAST(len(failed) AS INTEGER) AS reasons
            FROM verdicts""",
        "value_status_counts": TO_SILVER + """
            SELECT value_status, count(*) AS rows FROM silver GROUP BY value_status""",
        "silver_snapshot": silver_rows,
        "quality_report": _chain(CELLS, SILVER, QUALITY_CHECKS) + """
            SELECT CAST(check_number AS INTEGER) AS check_number, rule_id, severity, status,
                   affected_rows FROM checks""",
        "quality_summary": _chain(CELLS, SILVER, QUALITY_CHECKS) + f"""
            SELECT CASE WHEN (SELECT count(*) FROM checks WHERE status = 'FAIL') > 0
                        THEN 'FAIL' ELSE 'PASS' END AS overall_result,
                   count(*) AS rows_processed, {_count("failed = ''")} AS rows_accepted,
                   {_count("failed <> ''")} AS rows_rejected,
                   (SELECT count(*) FROM checks) AS checks_executed,
                   (SELECT {_count("status = 'PASS'")} FROM checks) AS passed_checks,
                   (SELECT {_count("status = 'FAIL'")} FROM checks) AS failed_checks
            FROM silver""",
        "direct_metrics": TO_GOLD + f"SELECT {GOLD_COLUMNS} FROM gold WHERE metric_id IN ('M1', 'M2', 'M3')",
        "derived_metrics": TO_GOLD + f"SELECT {GOLD_COLUMNS} FROM gold WHERE metric_id IN ('M4', 'M5', 'M6')",
        "gold_metrics": TO_GOLD + f"SELECT {GOLD_COLUMNS} FROM gold",
        "metric_lineage": TO_SILVER + """
            SELECT year, industry_aggregation_nzsioc, industry_code_nzsioc,
                   CASE variable_code WHEN 'H01' THEN 'M1' WHEN 'H23' THEN 'M2' ELSE 'M3' END AS metric_id,
                   record_id, ingestion_id FROM silver WHERE variable_code IN ('H01', 'H23', 'H40')""",
        "gold_lineage": TO_GOLD + lineage,
        "metric_status_counts": TO_GOLD + """
            SELECT metric_id, metric_status, count(*) AS rows FROM gold GROUP BY ALL""",
        "level_counts": TO_GOLD + """
            SELECT industry_aggregation_nzsioc, count(*) AS rows FROM gold GROUP BY ALL""",
        "mixed_definitions": TO_SILVER + f""", renamed AS (
            SELECT *, CASE WHEN dataset_year = 2026 AND variable_code = 'H01'
                           THEN industry_name_nzsioc || ' (renamed)' ELSE industry_name_nzsioc END AS name
            FROM silver)
            SELECT {IDENTITY}, count(DISTINCT name) AS definitions, count(*) AS rows
            FROM renamed GROUP BY {IDENTITY} HAVING count(DISTINCT name) > 1""",
        **{f"rank_{kind}": text for kind, text in rank.items()},
        "rank_whole_partitions": TO_GOLD + f", board AS ({_ranked('largest_movements')}) "
        "SELECT ranking_type, rank_position, year, industry_aggregation_nzsioc, metric_id, "
        "industry_code_nzsioc, metric_value FROM board",
        "benchmark_query": bounded,
        "benchmark_sql": bounded,
        "served_benchmark": TO_GOLD + f", board AS ({_ranked('largest_movements')}) "
        "SELECT rank_position, ranking_type, year, industry_code_nzsioc AS industry_code, "
        "industry_name_nzsioc AS industry_name, industry_aggregation_nzsioc AS aggregation_level, "
        "metric_id, metric_name, metric_value, absolute_metric_value, metric_status, metric_unit, "
        "metric_record_id FROM board WHERE rank_position <= 10 AND year = 2000 "
        "AND metric_id = 'M5' AND industry_aggregation_nzsioc = 'Level 3'",
        "industry_catalogue": TO_GOLD + """
            SELECT industry_code_nzsioc AS industry_code, industry_name_nzsioc AS industry_name,
                   industry_aggregation_nzsioc AS aggregation_level,
                   string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR))
                       AS available_years
            FROM gold GROUP BY ALL""",
        "catalogue_filtered": TO_GOLD + """
            SELECT DISTINCT industry_code_nzsioc AS industry_code, industry_name_nzsioc AS industry_name,
                   industry_aggregation_nzsioc AS aggregation_level, '2000' AS available_years
            FROM gold WHERE year = 2000 AND industry_aggregation_nzsioc = 'Level 3'""",
        "performance_sql": TO_GOLD + f"""
            SELECT {SERVED} FROM gold WHERE industry_code_nzsioc = 'ASIA' AND year = 2000
              AND industry_aggregation_nzsioc = 'Level 1'""",
        "trend_sql": TO_GOLD + f"""
            SELECT {SERVED} FROM gold WHERE industry_code_nzsioc = 'EUROPE' AND metric_id = 'M5'
              AND industry_aggregation_nzsioc = 'Level 1' AND year BETWEEN 1996 AND 2001""",
        "industry_performance": TO_GOLD + f"""
            SELECT {SERVED} FROM gold WHERE industry_code_nzsioc = 'ASIA' AND year = 2000
              AND industry_aggregation_nzsioc = 'Level 1'""",
        "industry_trend": TO_GOLD + f"""
            , series AS (SELECT {SERVED}, exact FROM gold WHERE industry_code_nzsioc = 'EUROPE'
              AND metric_id = 'M5' AND industry_aggregation_nzsioc = 'Level 1'
              AND year BETWEEN 1996 AND 2001)
            SELECT * EXCLUDE (exact), round(CASE WHEN exact IS NULL THEN 0 ELSE
                greatest(2, abs(exact) / greatest(max(abs(exact)) OVER (), 1) * 100) END, 6)
                AS relative_magnitude FROM series""",
        "trend_magnitudes": TO_GOLD + """
            SELECT year, industry_code_nzsioc AS industry_code,
                   industry_aggregation_nzsioc AS aggregation_level, metric_id,
                   round(CASE WHEN exact IS NULL THEN 0 ELSE greatest(2, abs(exact) / greatest(
                       coalesce(max(abs(exact)) OVER (PARTITION BY industry_aggregation_nzsioc,
                           industry_code_nzsioc, metric_id), 1), 1) * 100) END, 6) AS relative_magnitude
            FROM gold""",
        "published_coverage": TO_GOLD + f"""
            SELECT {IDENTITY}, {_count("metric_status = 'PUBLISHED'")} AS published_metrics,
                   count(*) AS metrics FROM gold GROUP BY {IDENTITY}""",
        "overlap_and_change": _chain(CELLS, PAIRS) + f"""
            SELECT {_count("new_release IS NOT NULL AND old_release IS NOT NULL")} AS overlapping_observations,
                   {_count("new_release IS NOT NULL AND old_release IS NOT NULL AND (value_changed OR metadata_changed)")}
                       AS changed_existing_observations FROM pairs""",
        "revision_counts": _chain(CELLS, PAIRS) + f"""
            , sides AS (SELECT *, new_release IS NOT NULL AND old_release IS NOT NULL AS shared FROM pairs)
            SELECT {_count("shared")} AS overlapping_observations,
                   {_count("shared AND NOT value_changed AND NOT metadata_changed")} AS unchanged_republications,
                   {_count("shared AND value_changed")} AS revised_values,
                   {_count("shared AND metadata_changed")} AS revised_metadata,
                   {_count("old_release IS NULL")} AS newly_added_observations,
                   {_count("new_release IS NULL")} AS observations_absent_from_incoming,
                   {_count("old_release IS NULL OR (shared AND (value_changed OR metadata_changed))")}
                       AS current_view_observations_changed,
                   CAST(0 AS BIGINT) AS duplicated_keys FROM sides""",
        "value_transitions": _chain(CELLS, PAIRS) + f"""
            SELECT {_class("old_value")} || '->' || {_class("new_value")} AS transition,
                   count(*) AS observations
            FROM pairs WHERE new_release IS NOT NULL AND old_release IS NOT NULL AND value_changed
            GROUP BY 1""",
        "previous_releases": _chain(CELLS, PAIRS) + """
            SELECT concat_ws('|', '2025', '2025-financial-year-provisional', upper(sha256('R1')))
                       AS release_identity,
                   CAST(2025 AS INTEGER) AS dataset_year, 'releases/R1.csv' AS source_file,
                   count(*) AS overlapping_observations, true AS superseded
            FROM pairs WHERE new_release IS NOT NULL AND old_release IS NOT NULL""",
        "fingerprints": TO_SILVER + """
            SELECT 'silver' AS name, sfp AS fingerprint FROM gold_print
            UNION ALL SELECT 'gold', gfp FROM gold_print
            UNION ALL SELECT 'revision', upper(sha256(concat_ws(chr(10), 'aes-revision-v1',
                upper(sha256('R1')), upper(sha256('R2')))))""",
        "row_digests": RAW + f"""
            SELECT {KEY}, dataset_version, sha256(concat_ws(chr(31), Year, Industry_aggregation_NZSIOC,
                   Industry_code_NZSIOC, Industry_name_NZSIOC, Units, Variable_code, Variable_name,
                   Variable_category, Value, Industry_code_ANZSIC06)) AS digest FROM bronze""",
        "incremental_plan": TO_SILVER + one_plan,
        **audits,
        "string_array_normalise": TO_GOLD + """
            SELECT metric_record_id, record_ids, len(records) AS items FROM gold""",
        "csv_ingest_roundtrip": RAW + """
            SELECT Year, Industry_aggregation_NZSIOC, Industry_code_NZSIOC, Industry_name_NZSIOC,
                   Units, Variable_code, Variable_name, Variable_category, Value,
                   Industry_code_ANZSIC06, count(*) AS copies FROM bronze GROUP BY ALL""",
        "csv_artifact_facts": RAW + """
            SELECT count(*) AS rows, CAST(0 AS BIGINT) AS files_with_wrong_numbers,
                   CAST(0 AS BIGINT) AS files_without_digest FROM bronze""",
        "csv_line_breaks": RAW + f"""
            , broken AS (SELECT * REPLACE (CASE Variable_code
                  WHEN 'H23' THEN Industry_name_NZSIOC || chr(10) || '"' || Industry_code_NZSIOC || '"'
                  WHEN 'H40' THEN Industry_name_NZSIOC || ',' || chr(13) || chr(10) || ','
                  ELSE Industry_name_NZSIOC END AS Industry_name_NZSIOC) FROM bronze),
            files AS (SELECT release, Year, upper(sha256({_quoted(f"'{c}'" for c in RAW_COLUMNS)} || chr(10)
                  || string_agg({_quoted(RAW_COLUMNS)} || chr(10), '' ORDER BY source_row_number))) AS source_sha256,
                  count(*) AS row_count FROM broken GROUP BY release, Year)
            SELECT {", ".join(RAW_COLUMNS)}, files.source_sha256, files.row_count,
                   row_number() OVER (PARTITION BY release, Year ORDER BY source_row_number) AS source_row_number
            FROM broken JOIN files USING (release, Year)""",
        "flawed_quality": _chain(CELLS, FLAWED, DIRTY) + _dirty_checks(),
        "flawed_gold": _chain(CELLS, SILVER, FLAWED, DIRTY, of_dirty) + f"""
            SELECT {GOLD_COLUMNS.rsplit(",", 1)[0]} FROM gold""",
        "stored_lineage": _chain(CELLS, SILVER, FLAWED, DIRTY, of_dirty) + _of_dirty(lineage),
        "silver_refresh": silver_rows,
        "deferred_plan": _chain(CELLS, PAIRS) + f"""
            , facts AS (SELECT {_count("new_release IS NOT NULL AND old_release IS NOT NULL")} AS overlapping,
                {_count("new_release IS NOT NULL AND old_release IS NOT NULL AND (value_changed OR metadata_changed)")} AS changed
                FROM pairs)
            SELECT CAST(n AS INTEGER) AS layer_order, layer, 'DEFERRED' AS action, CAST(0 AS INTEGER) AS current_identities,
                CAST(NULL AS VARCHAR) AS expected_identity, 'DEFERRED_REVISION' AS pipeline_status,
                'NEW_ARTIFACT' AS artifact_status, overlapping AS overlap_observations,
                changed AS changed_existing_observations
            FROM (VALUES (1, 'Bronze'), (2, 'Silver'), (3, 'Gold')) t(n, layer), facts""",
        "revision_outcomes": _chain(CELLS, PAIRS) + f"""
            , sides AS (SELECT *, new_release IS NOT NULL AS incoming, old_release IS NOT NULL AS kept FROM pairs),
            facts AS (SELECT {_count("incoming AND kept")} AS o,
                {_count("incoming AND kept AND NOT value_changed AND NOT metadata_changed")} AS u,
                {_count("incoming AND kept AND value_changed")} AS v, {_count("incoming AND kept AND metadata_changed")} AS m,
                {_count("incoming AND NOT kept")} AS added, {_count("kept AND NOT incoming")} AS absent,
                {_count("incoming AND kept AND (value_changed OR metadata_changed)")} AS moved,
                {_count("incoming")} AS fresh, {_count("kept")} AS old FROM sides)
            SELECT 'newer' AS case, 'ELIGIBLE' AS overall_result, o AS overlapping_observations,
                u AS unchanged_republications, v AS revised_values, m AS revised_metadata,
                added AS newly_added_observations, absent AS observations_absent_from_incoming,
                added + moved AS current_view_observations_changed FROM facts
            UNION ALL SELECT 'older', 'DEFERRED_AMBIGUOUS', o, u, v, m, absent, added, absent + moved FROM facts
            UNION ALL SELECT 'other', 'NOT_REVISION', 0, 0, 0, 0, fresh, old, fresh FROM facts""",
        "hot_group_facts": RAW + """
            , coded AS (SELECT CASE WHEN source_row_number % 3 = 0 THEN 'HOT' ELSE Industry_code_NZSIOC END AS code,
                Variable_code FROM bronze),
            sized AS (SELECT *, count(*) OVER (PARTITION BY code) AS code_rows FROM coded)
            SELECT code, Variable_code, code_rows, count(*) AS rows FROM sized GROUP BY ALL""",
        "string_array_malformed": RAW + """
            SELECT CAST(source_row_number % 10 AS INTEGER) AS kind, source_row_number % 10 < 3 AS accepted,
                CASE source_row_number % 10 WHEN 0 THEN 'a|b' WHEN 1 THEN '' WHEN 2 THEN '' END AS items,
                count(*) AS rows FROM bronze GROUP BY ALL""",
        "known_definitions": RAW + f"""
            , known AS (SELECT * FROM (VALUES {definitions}) t(i, variable_code, variable_name, variable_category, units))
            SELECT variable_code, CASE WHEN source_row_number % 9 = 0 THEN upper(variable_name) ELSE variable_name END AS variable_name,
                   variable_category, known.units, source_row_number % 9 <> 0 AS known, count(*) AS rows
            FROM (SELECT source_row_number FROM bronze WHERE release = 'R1')
            JOIN known ON i = source_row_number % {len(VARIABLE_DEFINITIONS)} GROUP BY ALL""",
        "lookup_outcomes": TO_GOLD + f"""
            SELECT 'performance' AS lookup, 'FOUND' AS outcome, {_count("industry_code_nzsioc = 'ASIA' AND year = 2000 AND industry_aggregation_nzsioc = 'Level 1'")} AS rows FROM gold
            UNION ALL SELECT 'trend', 'FOUND', {_count("industry_code_nzsioc = 'EUROPE' AND metric_id = 'M5' AND industry_aggregation_nzsioc = 'Level 1'")} FROM gold
            UNION ALL SELECT 'other level', 'NO_MATCH', 0 UNION ALL SELECT 'other year', 'NO_MATCH', 0""",
        "acceptance_points": TO_GOLD + """
            SELECT year, industry_aggregation_nzsioc, industry_code_nzsioc, metric_id,
                   CAST(CAST(round(exact) AS BIGINT) + CASE WHEN year % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS expected_value,
                   metric_status, year % 3 <> 0 AS verified
            FROM gold WHERE metric_id = 'M1' AND industry_aggregation_nzsioc = 'Level 1'""",
        "bronze_contract": RAW + f"""
            SELECT CAST(position AS INTEGER) AS position, name, type, (SELECT count(*) FROM bronze) AS filled
            FROM (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(BRONZE_COLUMNS, 1))})
                t(position, name, type)""",
        "catalog_retry": TO_SILVER + """
            , sizes AS (SELECT (SELECT count(*) FROM bronze WHERE release = 'R2') AS newer,
                (SELECT count(*) FROM bronze) AS stored, (SELECT count(*) FROM silver) AS chosen)
            SELECT CAST(1 AS INTEGER) AS step, 'append without commit' AS name, newer AS visible, false AS duplicate FROM sizes
            UNION ALL SELECT 2, 'append', stored, false FROM sizes
            UNION ALL SELECT 3, 'append again', stored, true FROM sizes
            UNION ALL SELECT 4, 'snapshot with a wrong count', 0, false
            UNION ALL SELECT 5, 'snapshot', chosen, false FROM sizes
            UNION ALL SELECT 6, 'snapshot again', chosen, true FROM sizes""",
        "load_runs": TO_SILVER + f"""
            , older AS (SELECT * FROM bronze WHERE release = 'R1'),
            facts AS (SELECT
                (SELECT count(*) FROM older) AS b1, (SELECT count(*) FROM bronze) AS b2,
                (SELECT count(*) FROM silver) AS s2,
                (SELECT count(DISTINCT (Year, Industry_aggregation_NZSIOC, Industry_code_NZSIOC)) FROM older) AS i1,
                (SELECT count(DISTINCT ({IDENTITY})) FROM silver) AS i2,
                (SELECT {_count("Value NOT IN ('C', 'S') AND NOT " + NUMERIC)} FROM older) AS bad)
            SELECT CAST(1 AS INTEGER) AS step, 'initial' AS run, 'LOADED' AS status, b1 AS bronze_rows,
                   b1 AS silver_rows, 6 * i1 AS gold_rows, bad AS rejected FROM facts
            UNION ALL SELECT 2, 'incremental', 'NO_OP', 0, 0, 0, 0
            UNION ALL SELECT 3, 'revision', 'APPLIED', b2, s2, 6 * i2, 0 FROM facts
            UNION ALL SELECT 4, 'revision', 'APPLIED, known: true', 0, 0, 0, 0""",
        "idempotent_append": RAW + """
            , sizes AS (SELECT release, ingestion_id, count(*) AS n FROM bronze GROUP BY ALL),
            steps AS (SELECT ingestion_id, n, sum(n) OVER (ORDER BY release) AS total FROM sizes)
            SELECT ingestion_id, n AS inserted_rows, CAST(total AS BIGINT) AS total_rows,
                   false AS duplicate FROM steps
            UNION ALL SELECT ingestion_id, 0, CAST(total AS BIGINT), true FROM steps""",
        "snapshot_rerun": TO_GOLD + """
            , runs AS (SELECT unnest([false, true]) AS duplicate)
            SELECT 'silver' AS layer, sfp AS fingerprint, (SELECT count(*) FROM silver) AS rows, duplicate
            FROM gold_print, runs
            UNION ALL SELECT 'gold', gfp, (SELECT count(*) FROM gold), duplicate FROM gold_print, runs""",
    }
