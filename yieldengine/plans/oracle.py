"""ANSI SQL for the same results, run by DuckDB over the same tables when the queries are checked."""

from __future__ import annotations

import re

from yieldengine.operators.planning import CRITICAL_CAUSE, HIGH_YIELD_CAUSES, LOW_YIELD_CAUSES
from yieldengine.schema import FEATURE_COLUMNS


def r(x: str, digits: int) -> str:
    """Half-even rounding by scaling, as in the queries."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale} + 0.0::DOUBLE)"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0), 150.0)"


def bucket(key: str, seed: int, buckets: int) -> str:
    return f"CAST(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT % {buckets} AS INTEGER)"


SPLIT_KEY = "h.MANUFACTURINGORDER || '|' || h.Output_Material"

# Shared table expressions: name -> (names it needs, SQL).
CTES: dict[str, tuple[list[str], str]] = {
    "movement": ([], """
        SELECT CAST(l_orderkey AS VARCHAR) AS MANUFACTURINGORDER, l_linestatus AS kind, p_brand AS MATERIAL,
               p_type AS MATERIALSPECIE, l_returnflag AS TALLYGRADE, n_name AS PLANT,
               CAST(p_size AS DOUBLE) AS MATERIALTHICKNESS, l_quantity AS TALLYLENGTH,
               CAST(l_linenumber AS DOUBLE) AS TALLYWIDTH, l_quantity AS vol, l_discount AS loss,
               l_linenumber = 7 AS IS_DELETED, l_shipdate AS POSTINGDATE,
               CAST(year(l_shipdate) AS VARCHAR) AS SOURCE_YEAR, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey"""),
    "raw261": (["movement"], "SELECT *, vol AS BFIN FROM movement WHERE kind = 'F'"),
    "raw101": (["movement"], "SELECT *, vol AS BFOUT FROM movement WHERE kind = 'O'"),
    "c261": (["raw261"], "SELECT * FROM raw261 WHERE NOT IS_DELETED"),
    "c101": (["raw101"], "SELECT * FROM raw101 WHERE NOT IS_DELETED"),
    "full261": (["movement"], "SELECT *, vol AS BFIN FROM movement WHERE NOT IS_DELETED"),
    "full101": (["movement"], """
        SELECT * EXCLUDE (MATERIAL), 'Product#' || (CAST(MANUFACTURINGORDER AS BIGINT) % 6) AS MATERIAL,
               vol * (1.0::DOUBLE - round(loss * 100.0::DOUBLE) / 64.0::DOUBLE) AS BFOUT
        FROM movement WHERE NOT IS_DELETED"""),
}


def _inputs(source: str) -> str:
    return f"""
        SELECT MANUFACTURINGORDER, sum(BFIN) AS Total_Input_BF,
               first(MATERIAL ORDER BY ln, pk, sk) AS Input_Material,
               first(MATERIALSPECIE ORDER BY ln, pk, sk) AS Input_Specie,
               first(TALLYGRADE ORDER BY ln, pk, sk) AS Input_Grade,
               first(PLANT ORDER BY ln, pk, sk) AS Input_Plant,
               avg(MATERIALTHICKNESS) AS Input_Thickness, avg(TALLYLENGTH) AS Input_Length,
               avg(TALLYWIDTH) AS Input_Width
        FROM {source} GROUP BY 1"""


def _outputs(source: str) -> str:
    return f"""
        SELECT a.*, g.TALLYGRADE AS Output_Grade FROM (
            SELECT MANUFACTURINGORDER, MATERIAL AS Output_Material, sum(BFOUT) AS Total_Output_BF,
                   first(MATERIALSPECIE ORDER BY ln, pk, sk) AS Output_Specie,
                   avg(MATERIALTHICKNESS) AS Output_Thickness, avg(TALLYLENGTH) AS Output_Length,
                   avg(TALLYWIDTH) AS Output_Width
            FROM {source} GROUP BY 1, 2) a
        JOIN (
            SELECT *, row_number() OVER (PARTITION BY MANUFACTURINGORDER, MATERIAL ORDER BY bf DESC, TALLYGRADE) AS rn
            FROM (SELECT MANUFACTURINGORDER, MATERIAL, TALLYGRADE, sum(BFOUT) AS bf FROM {source} GROUP BY 1, 2, 3)) g
        ON g.MANUFACTURINGORDER = a.MANUFACTURINGORDER AND g.MATERIAL = a.Output_Material AND g.rn = 1"""


def _history(inputs: str, outputs: str) -> str:
    return f"""
        SELECT *, CASE WHEN Total_Input_BF > 0 THEN (Total_Output_BF / Total_Input_BF) * 100.0::DOUBLE ELSE 0 END
                  AS Yield_Percentage
        FROM {inputs} JOIN {outputs} USING (MANUFACTURINGORDER)"""




def _trim(source: str, column: str) -> str:
    bound = f"(SELECT quantile_cont({column}, {{}}) FROM {source})"
    return f"SELECT * FROM {source} WHERE {column} BETWEEN {bound.format(0.01)} AND {bound.format(0.99)}"


_MEANS = "SELECT Input_Material, Input_Plant, avg(Yield_Percentage) AS m FROM full_history GROUP BY 1, 2"
_SPREAD = """
    SELECT Input_Material, avg(Yield_Percentage) AS mean, stddev_samp(Yield_Percentage) AS std, count(*) AS n,
           min(Yield_Percentage) AS min, max(Yield_Percentage) AS max
    FROM {0} WHERE Input_Material IS NOT NULL GROUP BY 1"""

CTES |= {
    "inputs": (["c261"], _inputs("c261")),
    "outputs": (["c101"], _outputs("c101")),
    "history": (["inputs", "outputs"], _history("inputs", "outputs")),
    "trim_yield": (["history"], _trim("history", "Yield_Percentage")),
    "trim_in": (["trim_yield"], _trim("trim_yield", "Total_Input_BF")),
    "trim_out": (["trim_in"], _trim("trim_in", "Total_Output_BF")),
    "full_inputs": (["full261"], _inputs("full261")),
    "full_outputs": (["full101"], _outputs("full101")),
    "full_history": (["full_inputs", "full_outputs"], _history("full_inputs", "full_outputs")),
    "full_trim_yield": (["full_history"], _trim("full_history", "Yield_Percentage")),
    "full_trim_in": (["full_trim_yield"], _trim("full_trim_yield", "Total_Input_BF")),
    "full_trim_out": (["full_trim_in"], _trim("full_trim_in", "Total_Output_BF")),
    "means": (["full_history"], _MEANS),
    "overall": (["full_history"], "SELECT avg(Yield_Percentage) AS m FROM full_history"),
    "stats": (["full_history"], _SPREAD.format("full_history")),
    "pairs": (["raw261"], "SELECT DISTINCT MATERIAL, PLANT FROM raw261"),
    "kd_requests": (["pairs"], """
        SELECT MATERIAL || '|' || PLANT AS request_id, MATERIAL AS material, PLANT AS plant FROM pairs
        UNION ALL SELECT DISTINCT MATERIAL || '|*', MATERIAL, NULL FROM pairs"""),
    "line_requests": (["movement"], """
        SELECT PLANT || '|' || MATERIAL AS request_id, line_no, PLANT AS Input_Plant,
               CASE line_no WHEN 1 THEN MATERIAL ELSE following END AS Input_Material, 5000.0::DOUBLE AS Total_Input_BF
        FROM (SELECT PLANT, MATERIAL, coalesce(lead(MATERIAL) OVER (PARTITION BY PLANT ORDER BY MATERIAL),
                     min(MATERIAL) OVER (PARTITION BY PLANT)) AS following
              FROM (SELECT DISTINCT PLANT, MATERIAL FROM movement)),
             (VALUES (1::INTEGER), (2::INTEGER)) lines(line_no)
        UNION ALL
        SELECT PLANT || '|new', 1, PLANT, 'New-' || PLANT, 8000.0::DOUBLE FROM (SELECT DISTINCT PLANT FROM movement)"""),
    "material_requests": (["movement"], """
        SELECT DISTINCT MATERIAL || '|' || PLANT AS request_id, MATERIAL AS Input_Material, PLANT AS Input_Plant,
               10000.0::DOUBLE AS Total_Input_BF, 5000.0::DOUBLE AS required_output_bf, 5.0::DOUBLE AS safety_margin_pct
        FROM movement"""),
    "scored_lines": (["line_requests", "means", "overall"], f"""
        SELECT q.*, {r('predicted', 2)} AS predicted_yield_pct,
               {r('Total_Input_BF * predicted / 100.0::DOUBLE', 2)} AS predicted_output_bf
        FROM (SELECT l.*, {clip('coalesce(means.m, overall.m)')} AS predicted
              FROM line_requests l LEFT JOIN means USING (Input_Material, Input_Plant) CROSS JOIN overall) q"""),
    "scored_materials": (["material_requests", "means", "overall"], f"""
        SELECT q.*, {r('predicted', 2)} AS predicted_yield_pct,
               {r('Total_Input_BF * predicted / 100.0::DOUBLE', 2)} AS predicted_output_bf
        FROM (SELECT l.*, {clip('coalesce(means.m, overall.m)')} AS predicted
              FROM material_requests l LEFT JOIN means USING (Input_Material, Input_Plant) CROSS JOIN overall) q"""),
    "confident": (["scored_materials", "stats"], f"""
        SELECT q.* EXCLUDE (predicted, predicted_output_bf, margin),
               {r('greatest(0.0, predicted - margin)', 2)} AS lower_bound_pct,
               {r('least(150.0, predicted + margin)', 2)} AS upper_bound_pct,
               0.9::DOUBLE AS confidence_level, 'mean' AS model_used
        FROM (SELECT m.*, 1.645::DOUBLE * coalesce(CASE WHEN s.n >= 3 THEN s.std END, 3.8::DOUBLE) AS margin
              FROM scored_materials m LEFT JOIN stats s USING (Input_Material)) q"""),
    "kd": (["kd_requests", "history"], f"""
        SELECT request_id, Output_Material, Output_Grade, BF_Output, Order_Count, Avg_Yield, Yield_Std,
               {r('BF_Output / sum(BF_Output) OVER (PARTITION BY request_id) * 100.0::DOUBLE', 2)} AS Percentage
        FROM (SELECT q.request_id, h.Output_Material, h.Output_Grade, {r('sum(h.Total_Output_BF)', 2)} AS BF_Output,
                     count(*) AS Order_Count, {r('avg(h.Yield_Percentage)', 2)} AS Avg_Yield,
                     {r('coalesce(stddev_samp(h.Yield_Percentage), 0)', 2)} AS Yield_Std
              FROM kd_requests q JOIN history h
                   ON h.Input_Material = q.material AND (q.plant IS NULL OR h.Input_Plant = q.plant)
              GROUP BY 1, 2, 3)"""),
    "kd_alloc": (["kd_requests", "kd"], f"""
        SELECT q.request_id, q.material, kd.* EXCLUDE (request_id),
               CASE WHEN kd.Output_Material IS NULL THEN 0.0 ELSE 900.0 END::DOUBLE AS wastage_bf,
               CASE WHEN kd.Output_Material IS NULL THEN 0.0 ELSE 9100.0 END::DOUBLE AS available_bf,
               coalesce({r('9100.0::DOUBLE * (Percentage / 100.0::DOUBLE)', 2)}, 0.0::DOUBLE) AS Expected_Output_BF,
               coalesce({r('sum(9100.0::DOUBLE * (Percentage / 100.0::DOUBLE)) OVER (PARTITION BY q.request_id)', 2)},
                        0.0::DOUBLE) AS total_expected_bf
        FROM kd_requests q LEFT JOIN kd ON kd.request_id = q.request_id"""),
    "kd_totals": (["kd_requests", "raw261", "raw101"], f"""
        SELECT request_id, material, total_hist_input_bf, total_hist_output_bf,
               {r('CASE WHEN total_hist_input_bf > 0 THEN total_hist_output_bf / total_hist_input_bf ELSE 0 END * 100.0::DOUBLE', 2)}
               AS historical_yield_pct
        FROM (SELECT q.request_id, q.material, coalesce(i.bf, 0) AS total_hist_input_bf,
                     coalesce(o.bf, 0) AS total_hist_output_bf
              FROM kd_requests q
              LEFT JOIN (SELECT request_id, sum(BFIN) bf FROM kd_requests k JOIN raw261 m
                         ON m.MATERIAL = k.material AND (k.plant IS NULL OR m.PLANT = k.plant) GROUP BY 1) i
                   USING (request_id)
              LEFT JOIN (SELECT request_id, sum(BFOUT) bf
                         FROM (SELECT DISTINCT request_id, MANUFACTURINGORDER FROM kd_requests k JOIN raw261 m
                               ON m.MATERIAL = k.material AND (k.plant IS NULL OR m.PLANT = k.plant))
                         JOIN raw101 USING (MANUFACTURINGORDER) GROUP BY 1) o USING (request_id))"""),
    "pair_orders": (["raw261"], "SELECT DISTINCT MATERIAL AS ks, PLANT AS plant, MANUFACTURINGORDER FROM raw261"),
    "pair_in": (["raw261"], """
        SELECT MATERIAL AS ks, PLANT AS plant, sum(BFIN) AS bfin, count(DISTINCT MANUFACTURINGORDER) AS orders,
               avg(MATERIALTHICKNESS) AS Input_Thickness, avg(TALLYLENGTH) AS Input_Length,
               avg(TALLYWIDTH) AS Input_Width
        FROM raw261 GROUP BY 1, 2"""),
    "pair_kd": (["pair_orders", "raw101"], """
        SELECT p.ks, p.plant, o.MATERIAL AS kd, sum(BFOUT) AS bf, count(DISTINCT o.MANUFACTURINGORDER) AS orders
        FROM pair_orders p JOIN raw101 o ON o.MANUFACTURINGORDER = p.MANUFACTURINGORDER GROUP BY 1, 2, 3"""),
    "forward": (["pair_in", "pair_kd", "means", "overall"], f"""
        SELECT i.ks || '|' || i.plant AS request_id, i.ks AS ks_material, i.plant, 10000.0::DOUBLE AS input_bf,
               CASE WHEN t.bf IS NULL THEN 'no output history' WHEN k.kd IS NULL THEN 'no output above threshold'
                    ELSE 'ok' END AS status,
               i.orders AS total_orders, coalesce(t.n, 0) AS kd_materials_count, i.bfin, t.bf AS bfout,
               CASE WHEN i.bfin > 0 THEN t.bf / i.bfin ELSE 0 END * 100.0::DOUBLE AS hist_yield,
               {r(clip('coalesce(means.m, overall.m)'), 2)} AS ml,
               k.kd, k.bf AS kd_bf, k.orders AS kd_orders,
               {r('k.bf / t.kept * 100.0::DOUBLE', 2)} AS share
        FROM pair_in i
        LEFT JOIN (SELECT ks, plant, sum(bf) AS bf, sum(bf) FILTER (orders > 5) AS kept,
                          count(*) FILTER (orders > 5) AS n FROM pair_kd GROUP BY 1, 2) t
             ON t.ks = i.ks AND t.plant = i.plant
        LEFT JOIN (SELECT * FROM pair_kd WHERE orders > 5) k ON k.ks = i.ks AND k.plant = i.plant
        LEFT JOIN means ON means.Input_Material = i.ks AND means.Input_Plant = i.plant CROSS JOIN overall"""),
    "request_rows": (["line_requests", "full_history"], """
        WITH wanted AS (SELECT DISTINCT request_id, Input_Material FROM line_requests),
             hits AS (SELECT DISTINCT request_id FROM wanted JOIN full_history USING (Input_Material))
        SELECT w.request_id, h.* FROM wanted w JOIN full_history h USING (Input_Material)
        UNION ALL
        SELECT w.request_id, h.* FROM (SELECT DISTINCT request_id FROM wanted) w CROSS JOIN full_history h
        WHERE w.request_id NOT IN (SELECT request_id FROM hits)"""),
    "line_rows": (["scored_lines", "full_history"], """
        SELECT l.request_id, l.line_no, h.Output_Material, h.Yield_Percentage AS y
        FROM scored_lines l JOIN full_history h ON h.Input_Material = l.Input_Material
        UNION ALL
        SELECT l.request_id, l.line_no, h.Output_Material, h.Yield_Percentage
        FROM scored_lines l CROSS JOIN full_history h
        WHERE l.Input_Material NOT IN (SELECT Input_Material FROM full_history)"""),
    "line_blend": (["line_rows"], """
        SELECT g.*, l.Total_Input_BF AS bf, l.predicted AS model,
               least(n / 100.0::DOUBLE, 0.7::DOUBLE) * hist
               + (1.0::DOUBLE - least(n / 100.0::DOUBLE, 0.7::DOUBLE)) * l.predicted AS final
        FROM (SELECT request_id, line_no, Output_Material, count(*) AS n, avg(y) AS hist, stddev_samp(y) AS sd
              FROM line_rows GROUP BY 1, 2, 3) g
        JOIN scored_lines l USING (request_id, line_no)"""),
    "candidates": (["request_rows", "scored_lines"], """
        SELECT c.*, a.*, least(n / 100.0::DOUBLE, 0.7::DOUBLE) AS w FROM (
            SELECT request_id AS rid, Output_Material, count(*) AS n, avg(Yield_Percentage) AS hist,
                   stddev_samp(Yield_Percentage) AS std, sum(Total_Input_BF) AS sum_in, sum(Total_Output_BF) AS sum_out
            FROM request_rows GROUP BY 1, 2) c
        JOIN (SELECT request_id, sum(Total_Input_BF) AS Input_BF, avg(predicted_yield_pct) AS model, count(*) AS lines,
                     string_agg(Input_Material, ', ' ORDER BY line_no) AS Input_Material
              FROM scored_lines GROUP BY 1) a ON a.request_id = c.rid"""),
    "enhanced_raw": (["candidates"], f"""
        SELECT *, CASE WHEN confidence >= 80 THEN 'HIGH' WHEN confidence >= 60 THEN 'MEDIUM'
                       WHEN confidence >= 40 THEN 'LOW' ELSE 'VERY LOW' END AS level,
               {r('expected', 2)} AS y, {r('low', 2)} AS y_min, {r('high', 2)} AS y_max
        FROM (SELECT *, greatest(0.0, expected - margin) AS low, least(150.0, expected + margin) AS high,
                     CASE WHEN n >= 100 THEN 40 WHEN n >= 50 THEN 30 WHEN n >= 20 THEN 20 WHEN n >= 5 THEN 10 ELSE 5 END
                     + CASE WHEN sd <= 5 THEN 35 WHEN sd <= 10 THEN 25 WHEN sd <= 15 THEN 15 WHEN sd <= 20 THEN 10
                            ELSE 5 END + 15 AS confidence
              FROM (SELECT *, w * hist + (1.0::DOUBLE - w) * model AS expected,
                           1.96::DOUBLE * CASE WHEN n > 1 THEN sd / sqrt(n) WHEN sd > 0 THEN sd ELSE 15.0 END AS margin
                    FROM (SELECT *, coalesce(std, 15.0) AS sd FROM candidates)))"""),
    "enhanced": (["enhanced_raw"], f"""
        SELECT request_id, Input_Material, Output_Material, Input_BF, y AS Predicted_Yield_Pct, y_min AS Yield_Min_Pct,
               y_max AS Yield_Max_Pct, {r('high - low', 2)} AS Yield_Range_Width, {r('model', 2)} AS Model_Yield_Pct,
               {r('hist', 2)} AS Historical_Yield_Pct, {r('sd', 2)} AS Yield_Std,
               {r('Input_BF * y / 100.0::DOUBLE', 2)} AS Predicted_Output_BF,
               {r('Input_BF * y_min / 100.0::DOUBLE', 2)} AS Output_Min_BF,
               {r('Input_BF * y_max / 100.0::DOUBLE', 2)} AS Output_Max_BF,
               CAST(confidence AS INTEGER) AS Confidence_Score, level AS Confidence_Level,
               CASE level WHEN 'HIGH' THEN 'LOW' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'LOW' THEN 'HIGH' ELSE 'VERY HIGH' END
               AS Risk_Level, n AS Historical_Orders, {r('sum_out', 2)} AS Historical_Total_Output_BF,
               {r('sum_in', 2)} AS Historical_Total_Input_BF, {r('sum_out / n', 2)} AS Historical_Avg_Output_BF,
               {r('(y / 100.0::DOUBLE) * (confidence / 100.0::DOUBLE)', 4)} AS Recommendation_Score,
               CASE WHEN lines > 1 THEN 'Multi-Input' ELSE 'Single-Input' END AS Model_Type, 0.3::DOUBLE AS Model_R2
        FROM enhanced_raw"""),
    "top": (["enhanced"], f"""
        SELECT request_id, true AS has_recommendation,
               CASE WHEN Confidence_Level = 'HIGH' AND Predicted_Yield_Pct >= 70 THEN 'STRONG'
                    WHEN Confidence_Level IN ('HIGH', 'MEDIUM') AND Predicted_Yield_Pct >= 60 THEN 'MODERATE'
                    ELSE 'WEAK' END AS strength,
               Output_Material AS output_material, Predicted_Yield_Pct AS expected_yield,
               printf('%.1f%% - %.1f%%', {r('Yield_Min_Pct', 1)}, {r('Yield_Max_Pct', 1)}) AS yield_range,
               Predicted_Output_BF AS expected_output_bf,
               format('{{:,}} - {{:,}} BF', CAST(round_even(Output_Min_BF, 0) AS BIGINT),
                      CAST(round_even(Output_Max_BF, 0) AS BIGINT)) AS output_range_bf,
               Confidence_Level AS confidence_level, Confidence_Score AS confidence_score, Risk_Level AS risk_level,
               Historical_Orders AS historical_orders, Recommendation_Score AS recommendation_score,
               Yield_Std AS yield_std, Model_R2 AS model_r2, Historical_Yield_Pct AS historical_yield,
               printf('%d historical orders of %s: %s confidence, expected yield %.1f%%', Historical_Orders,
                      Output_Material, Confidence_Level, {r('Predicted_Yield_Pct', 1)}) AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY Recommendation_Score DESC, Output_Material)
                     AS rn FROM enhanced) WHERE rn = 1"""),
    "summary": (["enhanced"], f"""
        SELECT request_id, max(Input_BF) AS total_input_bf, count(*) AS num_outputs,
               first(Output_Material ORDER BY Predicted_Yield_Pct DESC, Output_Material) AS best_output,
               max(Predicted_Yield_Pct) AS best_yield_pct,
               first(Predicted_Output_BF ORDER BY Predicted_Yield_Pct DESC, Output_Material) AS best_output_bf,
               {r('avg(Predicted_Yield_Pct)', 4)} AS avg_yield_pct,
               bool_or(Model_Type = 'Multi-Input') AS multi_input_advantage, 1 AS models_evaluated,
               0.3::DOUBLE AS best_r2, 3.8::DOUBLE AS lowest_rmse
        FROM enhanced GROUP BY 1"""),
    "split": (["full_history"], f"""
        SELECT h.*, {bucket(SPLIT_KEY, 42, 100)} < 20 AS is_test FROM full_history h"""),
    "tested": (["split"], f"""
        SELECT MANUFACTURINGORDER, Output_Material, Yield_Percentage AS Actual, p AS Predicted,
               Yield_Percentage - p AS Error,
               CASE WHEN Yield_Percentage <> 0 THEN (Yield_Percentage - p) / Yield_Percentage END * 100.0::DOUBLE
               AS Error_Pct
        FROM (SELECT s.*, {r(clip('coalesce(k.m, o.m)'), 2)} AS p
              FROM split s
              LEFT JOIN (SELECT Input_Material, Input_Plant, avg(Yield_Percentage) AS m FROM split WHERE NOT is_test
                         GROUP BY 1, 2) k USING (Input_Material, Input_Plant)
              CROSS JOIN (SELECT avg(Yield_Percentage) AS m FROM split WHERE NOT is_test) o
              WHERE s.is_test)"""),
}


def _closure(names: list[str]) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in found:
            found.append(name)

    for name in names:
        visit(name)
    return found


def sql(needs: list[str], body: str) -> str:
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in _closure(needs))
    return f"WITH {parts}\n{body}" if parts else body


def _quoted(values: list[str]) -> str:
    return "'" + "; ".join(values).replace("'", "''") + "'"


def _profile() -> str:
    columns = {
        "MANUFACTURINGORDER": "string", "MATERIAL": "string", "MATERIALSPECIE": "string", "TALLYGRADE": "string",
        "PLANT": "string", "MATERIALTHICKNESS": "double", "TALLYLENGTH": "double", "TALLYWIDTH": "double",
        "BFIN": "double", "IS_DELETED": "boolean", "POSTINGDATE": "timestamp_ntz", "SOURCE_YEAR": "string",
    }
    values = {"TALLYGRADE": "nullif(TALLYGRADE, 'N')",
              "MATERIALTHICKNESS": "CASE WHEN MATERIALTHICKNESS < 40 THEN 1 END"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({values.get(c, c)}) AS null_count FROM raw261"
        for c, t in columns.items()
    )


def _encoder_rows() -> str:
    columns = ["Input_Material", "Input_Specie", "Input_Grade", "Input_Plant", "Output_Material", "Output_Specie",
               "Output_Grade"]
    union = " UNION ".join(f"SELECT '{c}' AS \"column\", coalesce({c}, 'Unknown') AS value FROM history" for c in columns)
    return f"""SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER)
               AS code FROM ({union})"""


def _encoded() -> str:
    columns = ["Input_Material", "Input_Specie", "Input_Grade", "Input_Plant"]
    fitted = "(SELECT * FROM inputs WHERE Input_Plant <> 'NATION_1' OR Input_Grade <> 'N')"
    joins, fields = "", "i.MANUFACTURINGORDER"
    for c in columns:
        joins += f""" LEFT JOIN (SELECT v, code FROM (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
                      FROM (SELECT DISTINCT {c} AS v FROM {fitted})) WHERE v <> 'Brand#7') e_{c} ON e_{c}.v = i.{c}"""
        fields += f", i.{c}, coalesce(e_{c}.code, 0) AS {c}_Encoded"
    return f"SELECT {fields} FROM inputs i{joins}"


CATEGORIES = ["Input_Material", "Input_Specie", "Input_Grade", "Input_Plant", "Output_Material", "Output_Specie", "Output_Grade"]


def _codes() -> str:
    """Codes of the categories by rank among the values present."""
    return ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Unknown')) - 1 AS INTEGER) AS {c}_Encoded" for c in CATEGORIES
    )


def _thin(source: str) -> str:
    return f"""
        SELECT request_id, output_material, historical_orders, {r('100.0::DOUBLE - expected_yield', 2)} AS production_loss_pct,
               {r('total - expected_output_bf', 2)} AS loss_bf, historical_orders <= 5 AS limited_data,
               CASE WHEN historical_orders <= 5 THEN {r('total * 0.915::DOUBLE', 2)} END AS safer_output_bf
        FROM (SELECT *, CASE WHEN expected_yield > 0 THEN expected_output_bf / (expected_yield / 100.0::DOUBLE) ELSE 0 END AS total
              FROM {source})"""


def _renamed(name: str, mapping: dict[str, str]) -> tuple[list[str], str]:
    """A shared table expression over other tables."""
    needs, text = CTES[name]
    for old, new in mapping.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return [mapping.get(n, n) for n in needs], text


# The varied history and its requests, and what the simulation makes of them.
CTES["varied_history"] = (["full_history"], """
    SELECT MANUFACTURINGORDER, CASE WHEN part % 2 = 0 THEN Input_Material WHEN part = 1 THEN Input_Material || '*'
               ELSE Input_Material || '@' || Input_Plant END AS Input_Material, 'any' AS Input_Plant,
           CASE WHEN part % 2 = 0 THEN 'Main' WHEN part = 1 AND CAST(MANUFACTURINGORDER AS BIGINT) % 6 < 3 THEN 'Half' ELSE Output_Material END
               AS Output_Material, Total_Input_BF, y AS Yield_Percentage, Total_Input_BF * y / 100.0::DOUBLE AS Total_Output_BF
    FROM (SELECT *, greatest(0.0::DOUBLE, 92.0::DOUBLE - 9.0::DOUBLE * ((CAST(substr(Input_Material, 7) AS INTEGER) - 1) // 5)
                 + (Yield_Percentage - 92.0::DOUBLE)
                   * [1.0::DOUBLE, 3.0, 4.5, 6.0, 9.0][CAST(substr(Input_Material, 7) AS INTEGER) % 5 + 1]) AS y, n_nationkey % 4 AS part
          FROM full_history JOIN nation ON n_name = Input_Plant)""")
CTES["varied_lines"] = (["varied_history"], """
    SELECT DISTINCT Input_Material AS request_id, 1::INTEGER AS line_no, 'any' AS Input_Plant, Input_Material, 5000.0::DOUBLE AS Total_Input_BF
    FROM varied_history""")
_VARIED = {"full_history": "varied_history", "line_requests": "varied_lines"} | {
    name: f"varied_{name}" for name in ("means", "overall", "scored_lines", "request_rows", "candidates", "enhanced_raw", "enhanced", "top")
}
CTES |= {_VARIED[name]: _renamed(name, _VARIED) for name in _VARIED if name not in ("full_history", "line_requests")}


RIDGE_ALPHA = 1.0


def _ridge() -> str:
    """Table expressions: the training rows, and per fit (-1: all folds, else without that fold) the ridge weights.

    The normal equations of the features, scaled to unit deviation, are eliminated one column a step.
    """
    d = range(len(FEATURE_COLUMNS))
    y = len(FEATURE_COLUMNS)
    fields = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(FEATURE_COLUMNS))
    names = [f"x{i}" for i in d]
    sums = ", ".join(
        [f"avg({x}) AS m{i}" for i, x in enumerate([*names, "y"])] + [f"stddev_pop({x}) AS s{i}" for i, x in enumerate(names)]
        + [f"covar_pop({a}, {b}) * count(*) AS c_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate([*names, "y"])]
    )
    start = [
        f"c_{i}_{j} / (s{i}{'' if j == y else f' * s{j}'}) + {RIDGE_ALPHA if i == j else 0.0}::DOUBLE AS a_{i}_{j}" for i in d for j in (*d, y)
    ]
    steps = [f"e0 AS (SELECT fit, {', '.join(start)} FROM sums)"]
    for k in d:
        kept = [j for j in (*d, y) if j > k]
        cells = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" for j in kept]
        cells += [f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in d if i != k for j in kept]
        steps.append(f"e{k + 1} AS (SELECT fit, {', '.join(cells)} FROM e{k})")
    weights = ", ".join(f"a_{i}_{y} / s{i} AS w{i}" for i in d)
    intercept = " - ".join([f"m{y}", *(f"a_{i}_{y} / s{i} * m{i}" for i in d)])
    return f"""
        coded AS (SELECT *, {_codes()} FROM full_trim_out),
        training AS (
            SELECT {fields}, Yield_Percentage AS y, {bucket(SPLIT_KEY, 42, 100)} < 20 AS is_test, {bucket(SPLIT_KEY, 43, 5)} AS fold
            FROM coded h),
        fits AS (SELECT CAST(unnest([-1, 0, 1, 2, 3, 4]) AS INTEGER) AS fit),
        sums AS (SELECT fit, {sums} FROM training, fits WHERE NOT is_test AND fold <> fit GROUP BY fit),
        {", ".join(steps)},
        weights AS (SELECT fit, {weights}, {intercept} AS b FROM e{y} JOIN sums USING (fit)),
        scored AS (
            SELECT fit, is_test, fold, y, b + {' + '.join(f'w{i} * x{i}' for i in d)} AS p FROM training, weights)"""


def _r2(rows: str) -> str:
    return f"1 - sum((y - p) * (y - p)) FILTER ({rows}) / (var_pop(y) FILTER ({rows}) * count(*) FILTER ({rows}))"


def _ridge_model() -> str:
    weights = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {r(column, 6)} AS weight FROM weights WHERE fit = -1"
        for name, column in [*((c, f"w{i}") for i, c in enumerate(FEATURE_COLUMNS)), ("(intercept)", "b")]
    )
    return f"SELECT * FROM ({weights})"


def _ridge_scores() -> str:
    held = "WHERE is_test"
    return f"""
        SELECT fit AS fold, {r(_r2("WHERE NOT is_test"), 6)} AS train_r2, {r(_r2(held), 6)} AS held_r2,
               {r(f"avg(abs(y - p)) FILTER ({held})", 6)} AS mae, {r(f"sqrt(avg((y - p) * (y - p)) FILTER ({held}))", 6)} AS rmse,
               {r(f"avg(abs((y - p) / y)) FILTER ({held} AND y > 0) * 100", 6)} AS mape
        FROM scored WHERE fit = -1 GROUP BY fit
        UNION ALL SELECT fit, NULL, {r(_r2("WHERE fold = fit"), 6)}, NULL, NULL, NULL FROM scored WHERE fit >= 0 AND NOT is_test GROUP BY fit"""


def _year_totals(source: str, volume: str, kind: str) -> str:
    return f"""
        SELECT SOURCE_YEAR AS year, MATERIAL, CAST(IS_DELETED AS VARCHAR) AS IS_DELETED, sum({volume}) AS volume,
               count(*) AS rows, count(DISTINCT MANUFACTURINGORDER) AS orders, '{kind}' AS ledger
        FROM {source} WHERE SOURCE_YEAR IN (SELECT SOURCE_YEAR FROM raw261 INTERSECT SELECT SOURCE_YEAR FROM raw101)
        GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    ledger = ("MANUFACTURINGORDER, MATERIAL, MATERIALSPECIE, TALLYGRADE, PLANT, MATERIALTHICKNESS, TALLYLENGTH, "
              "TALLYWIDTH, {}, IS_DELETED, SOURCE_YEAR")
    dims = "MATERIALTHICKNESS * TALLYWIDTH * TALLYLENGTH / 144.0::DOUBLE"
    chosen = "PLANT = 'NATION_1' AND MATERIALSPECIE = 'ECONOMY'"
    summary_cols = "mean, std, min, max"
    found = {
        "clean_strict": sql(["c261"], f"SELECT {ledger.format('BFIN')} FROM c261"),
        "clean_lenient": sql(["c101"], f"""
            SELECT {ledger.format('BFOUT')}, strftime(POSTINGDATE, '%Y-%m-%d') AS POSTINGDATE
            FROM (SELECT DISTINCT {ledger.format('BFOUT')}, POSTINGDATE FROM c101)"""),
        "material_search": sql(["raw261"], "SELECT DISTINCT MATERIAL FROM raw261 WHERE upper(MATERIAL) LIKE '%BRAND#1%'"),
        "filtered_lines": sql(["raw261"], f"""
            SELECT MANUFACTURINGORDER AS order_id, MATERIAL AS material, BFIN AS bf FROM raw261
            WHERE {chosen} AND TALLYGRADE = 'A'"""),
        "null_profile": sql(["raw261"], _profile()),
        "quality_summary": sql(["raw261", "raw101"], " UNION ALL ".join(f"""
            SELECT '{k}' AS ledger, count(*) AS rows, count(DISTINCT MANUFACTURINGORDER) AS orders,
                   count(DISTINCT MATERIAL) AS materials, count(DISTINCT PLANT) AS plants,
                   strftime(min(POSTINGDATE), '%Y-%m-%d') AS first_posting,
                   strftime(max(POSTINGDATE), '%Y-%m-%d') AS last_posting FROM raw{k}""" for k in ("261", "101"))),
        "option_lists": sql(["raw261", "raw101"], " UNION ".join(
            [f"SELECT 'Input_{o}' AS option, CAST({c} AS VARCHAR) AS value FROM raw261" for o, c in
             (("Material", "MATERIAL"), ("Specie", "MATERIALSPECIE"), ("Grade", "TALLYGRADE"), ("Plant", "PLANT"),
              ("Thickness", "MATERIALTHICKNESS"))]
            + [f"SELECT 'Output_{o}', {c} FROM raw101" for o, c in
               (("Material", "MATERIAL"), ("Specie", "MATERIALSPECIE"), ("Grade", "TALLYGRADE"))])),
        "available_years": sql(["raw261", "raw101"], """
            SELECT SOURCE_YEAR AS year FROM raw261 INTERSECT SELECT SOURCE_YEAR FROM raw101"""),
        "bf_from_dimensions": sql(["c261", "c101"], f"""
            SELECT MATERIAL, {r(f'sum({dims})', 4)} AS total_bf, '261 dimensions' AS source FROM c261 GROUP BY 1
            UNION ALL SELECT MATERIAL, {r(f'sum({dims})', 4)}, '101 dimensions' FROM c101 GROUP BY 1
            UNION ALL SELECT MATERIAL, {r('sum(BFOUT)', 4)}, '101 BFIN' FROM c101 GROUP BY 1"""),
        "input_agg": sql(["inputs"], "SELECT * FROM inputs"),
        "output_agg_dominant_grade": sql(["outputs"], "SELECT * FROM outputs"),
        "yield_history": sql(["history"], "SELECT * FROM history"),
        "refreshed_history": sql(["history"], "SELECT * FROM history"),
        "yield_outliers_removed": sql(["trim_out"], """
            SELECT MANUFACTURINGORDER, Input_Material, Output_Material, Total_Input_BF, Total_Output_BF,
                   Yield_Percentage FROM trim_out"""),
        "yield_valid_range": sql(["c261", "c101"], """
            SELECT * FROM (
                SELECT i.*, o.Total_Output_BF, Total_Output_BF / Total_Input_BF * 100.0::DOUBLE AS Yield_Percentage
                FROM (SELECT MANUFACTURINGORDER, sum(BFIN) AS Total_Input_BF, first(PLANT ORDER BY ln, pk, sk) AS Plant,
                             first(MATERIAL ORDER BY ln, pk, sk) AS Input_Material,
                             first(MATERIALTHICKNESS ORDER BY ln, pk, sk) AS Thickness FROM c261 GROUP BY 1) i
                JOIN (SELECT MANUFACTURINGORDER, sum(BFOUT) AS Total_Output_BF FROM c101 GROUP BY 1) o
                     USING (MANUFACTURINGORDER))
            WHERE Yield_Percentage > 0 AND Yield_Percentage <= 100"""),
        "same_material_orders": sql(["history"], """
            SELECT count(*) AS joined_rows, count(*) FILTER (Input_Material = Output_Material) AS same_material_rows
            FROM history"""),
        "yield_statistics": sql(["history"], f"""
            SELECT count(*) AS records, {r('avg(Yield_Percentage)', 4)} AS mean_yield,
                   {r('stddev_samp(Yield_Percentage)', 4)} AS std_yield, {r('min(Yield_Percentage)', 4)} AS min_yield,
                   {r('max(Yield_Percentage)', 4)} AS max_yield FROM history"""),
        "yield_median": sql(["history"], f"""
            SELECT {r('quantile_cont(Yield_Percentage, 0.5)', 6)} AS median_yield FROM history"""),
        "yield_by_material": sql(["history"], f"""
            SELECT Input_Material, Output_Material, {r('avg(Yield_Percentage)', 4)} AS Mean_Yield,
                   {r('stddev_samp(Yield_Percentage)', 4)} AS Std_Yield, {r('min(Yield_Percentage)', 4)} AS Min_Yield,
                   {r('max(Yield_Percentage)', 4)} AS Max_Yield, count(Yield_Percentage) AS Order_Count,
                   sum(Total_Output_BF) AS Total_Output, sum(Total_Input_BF) AS Total_Input
            FROM history GROUP BY 1, 2"""),
        "material_yield_stats": sql(["history"], f"""
            SELECT s.Input_Material, {', '.join(f'{r(c, 4)} AS {c}' for c in summary_cols.split(', '))}, n AS count, n >= 3 AS usable,
                   {r('q25', 4)} AS q25, {r('q75', 4)} AS q75
            FROM ({_SPREAD.format('history')}) s
            JOIN (SELECT Input_Material, quantile_cont(Yield_Percentage, 0.25) AS q25,
                         quantile_cont(Yield_Percentage, 0.75) AS q75 FROM history GROUP BY 1) q USING (Input_Material)"""),
        "median_fill": sql(["inputs"], """
            SELECT MANUFACTURINGORDER, Total_Input_BF, Input_Length,
                   CASE WHEN Input_Thickness <= 40 THEN Input_Thickness ELSE
                        (SELECT quantile_cont(Input_Thickness, 0.5) FROM inputs WHERE Input_Thickness <= 40) END
                   AS Input_Thickness FROM inputs"""),
        "prepared_history": sql(["trim_out"], f"SELECT *, {_codes()} FROM trim_out"),
        "prepared_full_history": sql(["full_history"], f"""
            SELECT MANUFACTURINGORDER, Output_Material, Total_Input_BF, Yield_Percentage, {_codes()} FROM full_history"""),
        "years_found": sql(["raw261", "raw101"], """
            SELECT SOURCE_YEAR AS year FROM raw261 INTERSECT SELECT SOURCE_YEAR FROM raw101"""),
        "year_ledgers": sql(["raw261", "raw101"], _year_totals("raw261", "BFIN", "261") + " UNION ALL "
                            + _year_totals("raw101", "BFOUT", "101")),
        "common_orders": sql(["raw261", "raw101"], """
            SELECT MANUFACTURINGORDER FROM raw101 INTERSECT SELECT MANUFACTURINGORDER FROM raw261"""),
        "bf_per_order": sql(["raw261", "raw101"], """
            SELECT MANUFACTURINGORDER, sum(BFIN) AS BF, '261' AS side FROM raw261 GROUP BY 1
            UNION ALL SELECT MANUFACTURINGORDER, sum(BFOUT), '101' FROM raw101 GROUP BY 1"""),
        "filtered_totals": sql(["raw261", "raw101"], f"""
            SELECT coalesce(sum(BFIN), 0) AS total_bfin, count(*) AS input_rows,
                   (SELECT coalesce(sum(BFOUT), 0) FROM raw101 WHERE {chosen}) AS total_bfout
            FROM raw261 WHERE {chosen}"""),
        "materials_per_order": sql(["raw261", "raw101"], """
            SELECT MANUFACTURINGORDER, CAST((nth - 1) // 1000 AS INTEGER) AS block, string_agg(MATERIAL, ',' ORDER BY nth) AS Materials
            FROM (SELECT *, row_number() OVER (PARTITION BY MANUFACTURINGORDER ORDER BY ln, pk, sk) AS nth FROM raw101)
            WHERE MANUFACTURINGORDER IN (SELECT MANUFACTURINGORDER FROM raw261) GROUP BY 1, 2"""),
        "materials_in_order": sql(["raw101"], """
            SELECT MANUFACTURINGORDER, MATERIAL,
                   row_number() OVER (PARTITION BY MANUFACTURINGORDER ORDER BY ln, pk, sk) AS position FROM raw101"""),
        "input_then_output_materials": sql(["raw261", "raw101"], """
            SELECT f.MANUFACTURINGORDER, concat_ws(',', ks, kd) AS Materials
            FROM (SELECT MANUFACTURINGORDER, first(MATERIAL ORDER BY ln, pk, sk) AS ks FROM raw261 GROUP BY 1) f
            LEFT JOIN (SELECT MANUFACTURINGORDER, string_agg(MATERIAL, ',' ORDER BY ln, pk, sk) AS kd
                       FROM (SELECT *, row_number() OVER (PARTITION BY MANUFACTURINGORDER, MATERIAL ORDER BY ln, pk, sk)
                                    AS nth FROM raw101) WHERE nth = 1 GROUP BY 1) k USING (MANUFACTURINGORDER)"""),
        "order_yield_summary": sql(["raw261", "raw101"], f"""
            SELECT f.MANUFACTURINGORDER, ks AS KS_Material, bfin AS KS_BFIN, coalesce(bfout, 0) AS Total_BFOUT,
                   CASE WHEN bfin > 0 THEN {r('coalesce(bfout, 0) / bfin * 100.0::DOUBLE', 2)} END AS Yield_Percentage
            FROM (SELECT MANUFACTURINGORDER, first(MATERIAL ORDER BY ln, pk, sk) AS ks FROM raw261 GROUP BY 1) f
            JOIN (SELECT MANUFACTURINGORDER, MATERIAL, sum(BFIN) AS bfin FROM raw261 GROUP BY 1, 2) i
                 ON i.MANUFACTURINGORDER = f.MANUFACTURINGORDER AND i.MATERIAL = f.ks
            LEFT JOIN (SELECT MANUFACTURINGORDER, sum(BFOUT) AS bfout FROM raw101 GROUP BY 1) o
                 ON o.MANUFACTURINGORDER = f.MANUFACTURINGORDER"""),
        "order_output_mix": sql(["raw101"], f"""
            SELECT MANUFACTURINGORDER, MATERIAL, bf AS Total_BFOUT,
                   {r('bf / sum(bf) OVER (PARTITION BY MANUFACTURINGORDER) * 100.0::DOUBLE', 2)} AS Input_Percentage
            FROM (SELECT MANUFACTURINGORDER, MATERIAL, sum(BFOUT) AS bf FROM raw101 GROUP BY 1, 2)"""),
        "share_count_vs_bf": sql(["outputs"], f"""
            SELECT Output_Material, n AS Order_Count,
                   {r('n * 100.0::DOUBLE / CAST(sum(n) OVER () AS DOUBLE)', 6)} AS Historical_Pct_count,
                   bf AS Total_BF_Output, {r('bf * 100.0::DOUBLE / sum(bf) OVER ()', 6)} AS Historical_Pct_bf
            FROM (SELECT Output_Material, count(DISTINCT MANUFACTURINGORDER) AS n, sum(Total_Output_BF) AS bf
                  FROM outputs GROUP BY 1)"""),
        "share_by_count": sql(["outputs"], f"""
            SELECT Output_Material, n AS Order_Count,
                   {r('n * 100.0::DOUBLE / CAST(sum(n) OVER () AS DOUBLE)', 6)} AS Historical_Pct
            FROM (SELECT Output_Material, count(DISTINCT MANUFACTURINGORDER) AS n FROM outputs GROUP BY 1)"""),
        "expected_volume_by_material": sql(["c261", "c101"], f"""
            SELECT MATERIAL AS Output_Material, bf AS Total_BF_Output, {r('pct', 4)} AS Historical_Pct,
                   {r('total', 4)} AS expected_output, {r('total * (pct / 100.0::DOUBLE)', 4)} AS expected_material_bf
            FROM (SELECT MATERIAL, bf, bf * 100.0::DOUBLE / sum(bf) OVER () AS pct,
                         90000.0::DOUBLE * ((SELECT sum(BFOUT) FROM c101) / (SELECT sum(BFIN) FROM c261)) AS total
                  FROM (SELECT MATERIAL, sum(BFOUT) AS bf FROM c101 GROUP BY 1))"""),
        "kd_distribution": sql(["kd"], "SELECT * FROM kd"),
        "kd_distribution_by_grade": sql(["raw261", "history"], f"""
            SELECT *, {r('BF_Output / sum(BF_Output) OVER (PARTITION BY request_id) * 100.0::DOUBLE', 2)} AS Percentage
            FROM (SELECT q.MATERIAL || '|' || q.TALLYGRADE AS request_id, h.Output_Material, h.Output_Grade,
                         {r('sum(h.Total_Output_BF)', 2)} AS BF_Output, count(*) AS Order_Count,
                         {r('avg(h.Yield_Percentage)', 2)} AS Avg_Yield,
                         {r('coalesce(stddev_samp(h.Yield_Percentage), 0)', 2)} AS Yield_Std
                  FROM (SELECT DISTINCT MATERIAL, TALLYGRADE FROM raw261) q JOIN history h
                       ON h.Input_Material = q.MATERIAL AND h.Input_Grade = q.TALLYGRADE
                          AND (q.TALLYGRADE <> 'R' OR h.Input_Specie = 'ECONOMY')
                  GROUP BY 1, 2, 3)"""),
        "kd_wastage_allocation": sql(["kd_alloc"], """
            SELECT request_id, Output_Material, Output_Grade, Percentage, wastage_bf, available_bf, Expected_Output_BF,
                   total_expected_bf FROM kd_alloc"""),
        "kd_lookup_totals": sql(["kd_totals"], "SELECT * FROM kd_totals"),
        "kd_totals_from_history": sql(["kd_requests", "history"], f"""
            SELECT request_id, material, i AS total_hist_input_bf, o AS total_hist_output_bf,
                   {r('CASE WHEN i > 0 THEN o / i ELSE 0 END * 100.0::DOUBLE', 2)} AS historical_yield_pct
            FROM (SELECT q.request_id, q.material, coalesce(sum(i), 0) AS i, coalesce(sum(o), 0) AS o
                  FROM kd_requests q
                  LEFT JOIN (SELECT MANUFACTURINGORDER, Input_Material, Input_Plant, max(Total_Input_BF) AS i,
                                    sum(Total_Output_BF) AS o FROM history GROUP BY 1, 2, 3) h
                       ON h.Input_Material = q.material AND (q.plant IS NULL OR h.Input_Plant = q.plant)
                  GROUP BY 1, 2)"""),
        "kd_lookup": sql(["kd_alloc", "kd_totals"], """
            SELECT a.request_id, Output_Material, Output_Grade, BF_Output, Expected_Output_BF, total_hist_input_bf,
                   total_hist_output_bf, historical_yield_pct
            FROM kd_alloc a JOIN kd_totals t ON t.request_id = a.request_id"""),
        "production_order": sql(["kd_alloc"], f"""
            SELECT request_id, Output_Material, Output_Grade, Percentage, Expected_Output_BF AS Planned_Output_BF,
                   {r('sum(Expected_Output_BF) OVER (PARTITION BY request_id)', 2)} AS selected_bf,
                   {r('sum(Percentage) OVER (PARTITION BY request_id)', 2)} AS selected_pct
            FROM (SELECT k.* FROM kd_alloc k JOIN kd_requests q ON q.request_id = k.request_id
                  LEFT JOIN nation ON n_name = q.plant
                  WHERE Output_Material IS NOT NULL AND (n_regionkey = 0 OR (coalesce(n_regionkey, -1) <> 1
                        AND CAST(right(Output_Material, 1) AS INTEGER) % 2 = 0)))"""),
        "material_forward": sql(["forward"], f"""
            SELECT request_id, ks_material, plant, input_bf, status, total_orders, kd_materials_count,
                   CASE WHEN status = 'ok' THEN {r('bfin', 2)} END AS total_hist_input_bf,
                   CASE WHEN status = 'ok' THEN {r('bfout', 2)} END AS total_hist_output_bf,
                   CASE WHEN status = 'ok' THEN {r('hist_yield', 2)} END AS historical_yield_pct,
                   CASE WHEN status = 'ok' THEN {r('10000.0::DOUBLE * (hist_yield / 100.0::DOUBLE)', 2)} END
                   AS predicted_output_bf, kd AS KD_Material, {r('kd_bf', 2)} AS Historical_BF_Output,
                   kd_orders AS Order_Count, share AS Contribution_Pct,
                   {r('10000.0::DOUBLE * (hist_yield / 100.0::DOUBLE) * share / 100.0::DOUBLE', 2)} AS Expected_BF_Output
            FROM forward"""),
        "forward_totals": sql(["forward"], f"""
            SELECT request_id, {r('sum(share)', 2)} AS total_pct, {r('sum(e)', 2)} AS total_bf, count(*) AS materials
            FROM (SELECT *, {r('10000.0::DOUBLE * (hist_yield / 100.0::DOUBLE) * share / 100.0::DOUBLE', 2)} AS e
                  FROM forward WHERE status = 'ok') GROUP BY 1"""),
        "typical_features": sql(["raw261", "pair_in"], """
            SELECT i.ks AS ks_material, i.plant, Input_Thickness, Input_Length, Input_Width, Input_Specie, Input_Grade
            FROM pair_in i
            JOIN (SELECT MATERIAL, PLANT, first(MATERIALSPECIE ORDER BY n DESC, MATERIALSPECIE) AS Input_Specie
                  FROM (SELECT MATERIAL, PLANT, MATERIALSPECIE, count(*) AS n FROM raw261 GROUP BY 1, 2, 3)
                  GROUP BY 1, 2) s ON s.MATERIAL = i.ks AND s.PLANT = i.plant
            JOIN (SELECT MATERIAL, PLANT, first(TALLYGRADE ORDER BY n DESC, TALLYGRADE) AS Input_Grade
                  FROM (SELECT MATERIAL, PLANT, TALLYGRADE, count(*) AS n FROM raw261 GROUP BY 1, 2, 3)
                  GROUP BY 1, 2) g ON g.MATERIAL = i.ks AND g.PLANT = i.plant"""),
        "advanced_forward": sql(["forward"], f"""
            SELECT request_id, ks_material, plant, input_bf, status, total_orders, kd_materials_count,
                   'MEDIUM' AS ml_confidence, 'ML Model + Statistical Distribution' AS prediction_method,
                   CASE WHEN status = 'ok' THEN {r('bfin', 2)} END AS total_hist_input_bf,
                   CASE WHEN status = 'ok' THEN {r('bfout', 2)} END AS total_hist_output_bf,
                   CASE WHEN status = 'ok' THEN {r('hist_yield', 2)} END AS historical_yield_pct,
                   CASE WHEN status = 'ok' THEN {r('10000.0::DOUBLE * (ml / 100.0::DOUBLE)', 2)} END
                   AS predicted_output_bf, kd AS KD_Material, {r('kd_bf', 2)} AS Historical_BF_Output,
                   kd_orders AS Order_Count, share AS Contribution_Pct,
                   {r('10000.0::DOUBLE * (ml / 100.0::DOUBLE) * share / 100.0::DOUBLE', 2)} AS Expected_BF_Output,
                   CASE WHEN status = 'ok' THEN {r('ml', 2)} END AS ml_yield_pct,
                   CASE WHEN status = 'ok' THEN {r(r('ml', 2) + ' - ' + r('hist_yield', 2), 2)} END AS yield_difference
            FROM forward"""),
        "encoders": sql(["history"], _encoder_rows()),
        "encoder_classes": sql(["history"], f"""
            SELECT "column", string_agg(value, ',' ORDER BY code) AS classes FROM ({_encoder_rows()}) GROUP BY 1"""),
        "encode_lookup": sql(["inputs"], _encoded()),
        "simulate_lines": sql(["line_blend"], f"""
            SELECT request_id, Output_Material, {r('avg(' + r('final', 2) + ')', 4)} AS Predicted_Yield_Pct,
                   {r('avg(' + r('model', 2) + ')', 4)} AS Model_Yield_Pct,
                   {r('avg(' + r('hist', 2) + ')', 4)} AS Historical_Yield_Pct,
                   {r('avg(' + r('coalesce(sd, 0)', 2) + ')', 4)} AS Yield_Std,
                   CAST(sum(n) AS BIGINT) AS Historical_Orders, sum(bf) AS Input_BF,
                   {r('sum(' + r('bf * final / 100.0::DOUBLE', 2) + ')', 4)} AS Predicted_Output_BF,
                   CASE WHEN request_id IN (SELECT request_id FROM scored_lines GROUP BY 1 HAVING count(*) > 1)
                        THEN 'Multi-Input' ELSE 'Single-Input' END AS Model_Type
            FROM line_blend GROUP BY 1, 2"""),
        "simulate_outputs": sql(["candidates"], f"""
            SELECT request_id, Input_Material, Output_Material, {r('final', 2)} AS Predicted_Yield_Pct,
                   {r('model', 2)} AS Model_Yield_Pct, {r('hist', 2)} AS Historical_Yield_Pct,
                   {r('coalesce(std, 0)', 2)} AS Yield_Std, n AS Historical_Orders, Input_BF,
                   {r('Input_BF * final / 100.0::DOUBLE', 2)} AS Predicted_Output_BF,
                   {r('sum_out', 2)} AS Historical_Total_Output_BF, {r('sum_in', 2)} AS Historical_Total_Input_BF,
                   {r('sum_out / n', 2)} AS Historical_Avg_Output_BF,
                   CASE WHEN lines > 1 THEN 'Multi-Input' ELSE 'Single-Input' END AS Model_Type
            FROM (SELECT *, w * hist + (1.0::DOUBLE - w) * model AS final FROM candidates)"""),
        "simulate_outputs_enhanced": sql(["enhanced"], "SELECT * FROM enhanced"),
        "top_recommendation": sql(["top"], "SELECT * FROM top"),
        "thin_history_estimate": sql(["top"], _thin("top")),
        "prediction_summary": sql(["summary"], "SELECT * FROM summary"),
        "best_case_waste": sql(["summary"], f"""
            SELECT request_id, best_output, {r('total_input_bf - best_output_bf', 2)} AS waste_bf,
                   {r('100.0::DOUBLE - best_yield_pct', 2)} AS waste_pct FROM summary"""),
        "fallback_predictions": sql(["scored_lines"], """
            SELECT request_id, line_no, 'Predicted Output' AS Output_Material,
                   predicted_yield_pct AS Predicted_Yield_Pct, predicted_output_bf AS Predicted_Output_BF,
                   predicted_yield_pct AS Historical_Yield_Pct, 0::BIGINT AS Historical_Orders,
                   'Single-Input' AS Model_Type, 'LOW' AS Confidence_Level, 'HIGH' AS Risk_Level,
                   30 AS Confidence_Score FROM scored_lines"""),
        "deduplicated_input": sql(["history"], """
            SELECT Input_Material, sum(bf) AS Total_Input_BF
            FROM (SELECT DISTINCT Input_Material, MANUFACTURINGORDER, Total_Input_BF AS bf FROM history) GROUP BY 1"""),
        "forward_confidence": sql(["confident"], f"""
            SELECT * EXCLUDE (required_output_bf, safety_margin_pct),
                   {r('Total_Input_BF * predicted_yield_pct / 100.0::DOUBLE', 2)} AS expected_output_bf,
                   {r('Total_Input_BF * lower_bound_pct / 100.0::DOUBLE', 2)} AS pessimistic_output_bf,
                   {r('Total_Input_BF * upper_bound_pct / 100.0::DOUBLE', 2)} AS optimistic_output_bf FROM confident"""),
        "forward_predict_lines": sql(["scored_lines"], "SELECT * EXCLUDE (predicted) FROM scored_lines"),
        "reverse_plan": sql(["confident"], f"""
            SELECT * EXCLUDE (needed), {r('needed * (1.0::DOUBLE + safety_margin_pct / 100.0::DOUBLE)', 2)}
                   AS required_input_bf,
                   {r('''CASE WHEN lower_bound_pct > 0 THEN required_output_bf / (lower_bound_pct / 100.0::DOUBLE)
                      ELSE needed * 1.2::DOUBLE END''', 2)} AS conservative_input_bf,
                   {r('''CASE WHEN upper_bound_pct > 0 THEN required_output_bf / (upper_bound_pct / 100.0::DOUBLE)
                      ELSE needed * 0.9::DOUBLE END''', 2)} AS optimistic_input_bf
            FROM (SELECT *, CASE WHEN predicted_yield_pct > 0
                            THEN required_output_bf / (predicted_yield_pct / 100.0::DOUBLE)
                            ELSE required_output_bf END AS needed FROM confident)"""),
        "reverse_predict": sql(["scored_materials"], f"""
            SELECT request_id, Input_Material, safe AS required_input_bf, {r('needed', 2)} AS required_input_no_safety_bf,
                   required_output_bf AS target_output_bf, pct AS predicted_yield_pct, safety_margin_pct,
                   {r('safe - required_output_bf', 2)} AS expected_waste_bf,
                   {r('100.0::DOUBLE - pct', 2)} AS expected_waste_pct
            FROM (SELECT *, {r('needed * (1.0::DOUBLE + safety_margin_pct / 100.0::DOUBLE)', 2)} AS safe
                  FROM (SELECT *, required_output_bf / (pct / 100.0::DOUBLE) AS needed
                        FROM (SELECT *, CASE WHEN predicted_yield_pct <= 0 THEN 70.0 ELSE predicted_yield_pct END AS pct
                              FROM scored_materials)))"""),
        "compare_materials": sql(["confident", "stats"], f"""
            SELECT c.request_id, c.Input_Material AS Material, predicted_yield_pct AS Predicted_Yield_Pct,
                   lower_bound_pct AS Yield_Lower_Pct, upper_bound_pct AS Yield_Upper_Pct, price AS Price_Per_BF_Input,
                   {r('price / (predicted_yield_pct / 100.0::DOUBLE)', 4)} AS Effective_Cost_Per_BF_Output,
                   s.n AS Historical_Orders, {r('s.mean', 2)} AS Historical_Mean_Yield
            FROM confident c LEFT JOIN stats s USING (Input_Material)
            LEFT JOIN (SELECT p_brand, {r('avg(p_retailprice)', 2)} AS price FROM part GROUP BY 1) p
                 ON p.p_brand = c.Input_Material"""),
        "waste_estimate": sql(["scored_materials"], f"""
            SELECT request_id, predicted_yield_pct, {r('o', 2)} AS output_bf, {r('Total_Input_BF - o', 2)} AS waste_bf,
                   {r('100.0::DOUBLE - predicted_yield_pct', 2)} AS waste_pct
            FROM (SELECT *, Total_Input_BF * predicted_yield_pct / 100.0::DOUBLE AS o FROM scored_materials)"""),
        "anomaly_orders": sql(["full_history", "means", "stats"], f"""
            SELECT MANUFACTURINGORDER, Input_Material, Output_Material, is_anomaly, anomaly_type,
                   p AS predicted_yield_pct, {r('dev', 2)} AS deviation_pct, {r('dev_std', 2)} AS deviation_std,
                   2.0::DOUBLE AS threshold_std,
                   CASE WHEN anomaly_type IS NULL THEN ''
                        WHEN anomaly_type = 'LOW_YIELD' AND abs(dev_std) > 3
                             THEN {_quoted([CRITICAL_CAUSE, *LOW_YIELD_CAUSES])}
                        WHEN anomaly_type = 'LOW_YIELD' THEN {_quoted(LOW_YIELD_CAUSES)}
                        ELSE {_quoted(HIGH_YIELD_CAUSES)} END AS possible_causes
            FROM (SELECT *, CASE WHEN is_anomaly THEN CASE WHEN dev < 0 THEN 'LOW_YIELD' ELSE 'HIGH_YIELD' END END
                         AS anomaly_type
                  FROM (SELECT *, abs(dev_std) > 2.0 AS is_anomaly
                        FROM (SELECT *, CASE WHEN sd > 0 THEN dev / sd ELSE 0 END AS dev_std
                              FROM (SELECT h.*, p, Yield_Percentage - p AS dev, coalesce(s.std, 5.0) AS sd
                                    FROM full_history h
                                    JOIN (SELECT Input_Material, Input_Plant, {r(clip('m'), 2)} AS p FROM means) m
                                         USING (Input_Material, Input_Plant)
                                    LEFT JOIN stats s USING (Input_Material)))))"""),
        "model_test_results": sql(["tested"], f"""
            SELECT MANUFACTURINGORDER, Output_Material, {r('Actual', 6)} AS Actual, Predicted, {r('Error', 6)} AS Error,
                   {r('Error_Pct', 6)} AS Error_Pct FROM tested"""),
        "regression_metrics": sql(["tested"], f"""
            SELECT count(*) AS rows, {r('1.0::DOUBLE - sum(Error * Error) / (var_pop(Actual) * count(*))', 6)} AS r2,
                   {r('avg(abs(Error))', 6)} AS mae, {r('sqrt(sum(Error * Error) / count(*))', 6)} AS rmse,
                   {r('avg(abs(Error / Actual)) FILTER (Actual > 0) * 100.0::DOUBLE', 6)} AS mape FROM tested"""),
        "error_histogram": sql(["tested"], f"""
            SELECT b.bin, coalesce(rows, 0) AS rows, {r('low + width * b.bin', 4)} AS bin_from,
                   {r('low + width * (b.bin + 1)', 4)} AS bin_to, {r('mean', 4)} AS mean_error
            FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b
            CROSS JOIN (SELECT min(Error) AS low, (max(Error) - min(Error)) / 50.0::DOUBLE AS width, avg(Error) AS mean
                        FROM tested)
            LEFT JOIN (SELECT CAST(least(floor((Error - low) / width), 49) AS INTEGER) AS bin, count(*) AS rows
                       FROM tested CROSS JOIN (SELECT min(Error) AS low, (max(Error) - min(Error)) / 50.0::DOUBLE AS width
                                               FROM tested) GROUP BY 1) c ON c.bin = b.bin"""),
        "test_row_sample": sql(["tested"], f"""
            SELECT MANUFACTURINGORDER, Output_Material, {r('Actual', 6)} AS Actual, Predicted, {r('Error', 6)} AS Error,
                   {r('Error_Pct', 6)} AS Error_Pct
            FROM tested ORDER BY md5(MANUFACTURINGORDER || '|' || Output_Material || '|42') LIMIT 500"""),
        "kd_distribution_by_thickness": sql(["history"], f"""
            SELECT material, thickness, grade, species, plant, Output_Material, Output_Grade, BF_Output, Order_Count,
                   {r('BF_Output / sum(BF_Output) OVER (PARTITION BY material, thickness, grade, species, plant) * 100.0::DOUBLE', 2)} AS Percentage
            FROM (SELECT q.*, h.Output_Material, h.Output_Grade, {r('sum(h.Total_Output_BF)', 2)} AS BF_Output, count(*) AS Order_Count
                  FROM (SELECT DISTINCT Input_Material AS material, CASE WHEN p & 1 > 0 THEN Input_Thickness END AS thickness,
                               CASE WHEN p & 2 > 0 THEN Input_Grade END AS grade, CASE WHEN p & 4 > 0 THEN Input_Specie END AS species,
                               CASE WHEN p & 8 > 0 THEN Input_Plant END AS plant
                        FROM (SELECT *, (CAST(floor(Input_Thickness) AS INTEGER) + length(Input_Plant)) % 16 AS p FROM history)) q
                  JOIN history h ON h.Input_Material = q.material AND (q.thickness IS NULL OR h.Input_Thickness = q.thickness)
                       AND (q.grade IS NULL OR h.Input_Grade = q.grade) AND (q.species IS NULL OR h.Input_Specie = q.species)
                       AND (q.plant IS NULL OR h.Input_Plant = q.plant)
                  GROUP BY ALL)"""),
        "forward_by_contribution": sql(["forward"], """
            SELECT request_id, kd AS KD_Material, share AS Contribution_Pct FROM forward WHERE status = 'ok'"""),
        "allocation_by_expected_volume": sql(["kd_alloc"], "SELECT request_id, Output_Material, Output_Grade, Expected_Output_BF FROM kd_alloc"),
        "forward_statuses": sql(["pair_in", "pair_orders", "raw101"], f"""
            , few AS (
                SELECT p.ks, p.plant, o.MATERIAL AS kd, sum(BFOUT) AS bf, count(DISTINCT o.MANUFACTURINGORDER) AS orders,
                       CASE WHEN CAST(substr(p.ks, 7) AS INTEGER) % 2 = 0 THEN 0 ELSE 5 END AS least_
                FROM pair_orders p JOIN raw101 o ON o.MANUFACTURINGORDER = p.MANUFACTURINGORDER
                WHERE CAST(o.MANUFACTURINGORDER AS BIGINT) % 16 = 0 GROUP BY 1, 2, 3)
            SELECT i.ks || '|' || i.plant AS request_id,
                   CASE WHEN t.bf IS NULL THEN 'no output history' WHEN k.kd IS NULL THEN 'no output above threshold' ELSE 'ok' END AS status,
                   i.orders AS total_orders, coalesce(t.n, 0) AS kd_materials_count, k.kd AS KD_Material, k.orders AS Order_Count,
                   {r('k.bf / t.kept * 100.0::DOUBLE', 2)} AS Contribution_Pct
            FROM pair_in i
            LEFT JOIN (SELECT ks, plant, sum(bf) AS bf, sum(bf) FILTER (orders > least_) AS kept, count(*) FILTER (orders > least_) AS n
                       FROM few GROUP BY 1, 2) t ON t.ks = i.ks AND t.plant = i.plant
            LEFT JOIN (SELECT * FROM few WHERE orders > least_) k ON k.ks = i.ks AND k.plant = i.plant
            UNION ALL SELECT DISTINCT 'unused|' || plant, 'no input history', NULL, 0, NULL, NULL, NULL FROM pair_in"""),
        "default_ledgers": sql(["raw261", "raw101"], " UNION ALL ".join(f"""
            SELECT MATERIAL, CAST(IS_DELETED AS VARCHAR) AS IS_DELETED, sum({volume}) AS volume, count(*) AS rows,
                   count(DISTINCT MANUFACTURINGORDER) AS orders, '{kind}' AS ledger FROM raw{kind} GROUP BY 1, 2"""
            for kind, volume in (("261", "BFIN"), ("101", "BFOUT")))),
        "history_sources": sql(["history", "trim_out"], " UNION ALL ".join(f"""
            SELECT Input_Material, CAST(count(*) AS BIGINT) AS rows, {r('avg(Yield_Percentage)', 6)} AS mean_yield, '{source}' AS source
            FROM {rows} GROUP BY 1""" for rows, source in (("trim_out", "ledgers"), ("history", "summary")))),
        "exported_distribution": sql(["forward"], f"""
            SELECT kd AS KD_Material, {r('kd_bf', 2)} AS Historical_BF_Output, kd_orders AS Order_Count, share AS Contribution_Pct,
                   {r('10000.0::DOUBLE * (hist_yield / 100.0::DOUBLE) * share / 100.0::DOUBLE', 2)} AS Expected_BF_Output,
                   ks_material AS KS_Material, plant AS Plant, input_bf AS Input_BF,
                   {r('10000.0::DOUBLE * (hist_yield / 100.0::DOUBLE)', 2)} AS Predicted_Total_Output_BF, {r('hist_yield', 2)} AS Yield_Pct
            FROM forward WHERE status = 'ok'"""),
        "exported_results": sql(["enhanced"], """
            SELECT 'all plants' AS run, Output_Material AS output_material, Confidence_Level AS confidence, Confidence_Score AS score,
                   Historical_Orders AS orders, Predicted_Yield_Pct AS yield_pct, Recommendation_Score AS recommendation FROM enhanced"""),
        "prepared_features": sql(["inputs"], """
            SELECT MANUFACTURINGORDER, Total_Input_BF,
                   CASE WHEN Input_Length <= 40 THEN Input_Length ELSE
                        (SELECT quantile_cont(Input_Length, 0.5) FROM inputs WHERE Input_Length <= 40) END AS Input_Length,
                   'Total_Input_BF,Input_Length' AS used, CASE WHEN Input_Length <= 40 THEN Input_Length ELSE 0 END AS Scoring_Length,
                   0.0::DOUBLE AS Input_Absent FROM inputs"""),
        "order_lines": sql(["raw261", "raw101"], " UNION ALL ".join(
            f"SELECT MANUFACTURINGORDER, MATERIAL, PLANT, {volume} AS bf, '{volume}' AS side FROM raw{kind} WHERE MANUFACTURINGORDER = '7'"
            for kind, volume in (("261", "BFIN"), ("101", "BFOUT")))),
        "preview_lines": sql(["raw261"], """
            SELECT MANUFACTURINGORDER, MATERIAL, PLANT, BFIN FROM raw261 ORDER BY CAST(MANUFACTURINGORDER AS BIGINT), ln, pk, sk LIMIT 25"""),
        "predictions_with_fallback": sql(["candidates", "scored_lines"], f"""
            SELECT request_id, Output_Material, {r('w * hist + (1.0::DOUBLE - w) * model', 2)} AS Predicted_Yield_Pct,
                   {r('Input_BF * (w * hist + (1.0::DOUBLE - w) * model) / 100.0::DOUBLE', 2)} AS Predicted_Output_BF,
                   {r('hist', 2)} AS Historical_Yield_Pct, n AS Historical_Orders,
                   CASE WHEN lines > 1 THEN 'Multi-Input' ELSE 'Single-Input' END AS Model_Type, NULL AS Confidence_Level, NULL AS Risk_Level,
                   CAST(NULL AS INTEGER) AS Confidence_Score
            FROM candidates WHERE Input_Material NOT LIKE 'New-%'
            UNION ALL
            SELECT request_id, 'Predicted Output', predicted_yield_pct, predicted_output_bf, predicted_yield_pct, 0, 'Single-Input', 'LOW',
                   'HIGH', 30 FROM scored_lines WHERE Input_Material LIKE 'New-%'"""),
        "varied_confidence": sql(["varied_enhanced"], """
            SELECT request_id, Output_Material, Predicted_Yield_Pct, Yield_Min_Pct, Yield_Max_Pct, Yield_Std, Confidence_Score,
                   Confidence_Level, Risk_Level, Historical_Orders, Recommendation_Score FROM varied_enhanced"""),
        "varied_recommendations": sql(["varied_top"], """
            SELECT request_id, strength, output_material, expected_yield, confidence_level, risk_level, historical_orders, message
            FROM varied_top"""),
        "varied_thin_history": sql(["varied_top"], _thin("varied_top")),
        "stored_models": sql(["full_trim_out"], "").rstrip() + "," + _ridge() + f"""
            SELECT year, year AS trained_years, 'Ridge' AS best_model, CAST({len(FEATURE_COLUMNS)} AS INTEGER) AS num_features, feature, weight
            FROM ({_ridge_model()}) CROSS JOIN (
                SELECT CAST(year AS VARCHAR) AS year FROM (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem WHERE l_linestatus = 'F'
                    INTERSECT SELECT year(l_shipdate) FROM lineitem WHERE l_linestatus = 'O') ORDER BY 1 DESC LIMIT 2)
            WHERE feature <> '(intercept)'""",
        "stored_test_results": sql(["full_trim_out"], "").rstrip() + "," + _ridge() + f"""
            SELECT {r('y', 4)} AS Actual, {r('p', 4)} AS Predicted, {r('y - p', 4)} AS Error, {r('(y - p) / y * 100.0::DOUBLE', 4)} AS Error_Pct
            FROM scored WHERE fit = -1 AND is_test""",
        "ridge_model": sql(["full_trim_out"], "").rstrip() + "," + _ridge() + _ridge_model(),
        "ridge_scores": sql(["full_trim_out"], "").rstrip() + "," + _ridge() + _ridge_scores(),
        "split_and_folds": sql(["history"], f"""
            SELECT Input_Material, {bucket(SPLIT_KEY, 42, 100)} < 20 AS is_test, {bucket(SPLIT_KEY, 43, 5)} AS fold,
                   count(*) AS rows FROM history h GROUP BY 1, 2, 3"""),
        "stratified_split": sql(["history"], """
            SELECT Output_Material, count(*) AS rows, CAST(floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT)
                   AS held_out FROM history GROUP BY 1"""),
        "class_weights": sql(["history"], f"""
            SELECT Output_Material, n AS rows,
                   {r('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)', 8)} AS weight
            FROM (SELECT Output_Material, count(*) AS n FROM history GROUP BY 1)"""),
    }
    return found | {"saved_option_lists": found["option_lists"]}
