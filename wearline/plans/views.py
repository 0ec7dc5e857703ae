"""Named SQL sub-queries that mirror the table mappings of `wearline.sources.tables`."""

from wearline.plans.catalog import VIEWS

VIEWS["v_readings"] = """
SELECT condition_id, unit_id, acquisition_number, ts, event_type, horizontal, vertical, sequence_index, total_acquisitions,
       CAST(sequence_index AS DOUBLE) AS elapsed_minutes, CAST(total_acquisitions - 1 - sequence_index AS DOUBLE) AS rul_minutes
FROM (SELECT user_id % 3 + 1 AS condition_id, user_id AS unit_id, event_id AS acquisition_number, ts, event_type, value AS horizontal,
             CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS vertical,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_index,
             count(*) OVER (PARTITION BY user_id) AS total_acquisitions FROM events)
"""
VIEWS["v_long"] = """
SELECT condition_id, unit_id, sequence_index, total_acquisitions, 'horizontal' AS feature, horizontal AS value FROM v_readings
UNION ALL SELECT condition_id, unit_id, sequence_index, total_acquisitions, 'vertical' AS feature, vertical AS value FROM v_readings
"""
VIEWS["v_signals"] = """
SELECT label % 3 + 1 AS condition_id, CAST(label AS BIGINT) AS unit_id, vec_id AS acquisition_number, embedding AS signal,
       embedding[1:32] AS horizontal, embedding[33:64] AS vertical,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sequence_index,
       count(*) OVER (PARTITION BY label) AS total_acquisitions FROM embeddings
"""
VIEWS["v_units"] = "SELECT condition_id, unit_id, count(*) AS n FROM v_readings GROUP BY ALL"
VIEWS["v_folds"] = """
SELECT CAST(f.fold AS INTEGER) AS fold, u.condition_id, u.unit_id, u.n,
       CASE WHEN (u.pos - f.fold + 5) % 5 = 0 THEN 'test' WHEN (u.pos - f.fold + 5) % 5 = 1 THEN 'validation' ELSE 'train' END AS subset
FROM (SELECT *, (row_number() OVER (PARTITION BY condition_id ORDER BY unit_id) - 1) % 5 AS pos FROM v_units) u, range(5) f(fold)
"""
