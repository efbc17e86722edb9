"""The registered queries as SQL over the same tables (DuckDB dialect)."""

SPECTRA = """
spectra AS (
  SELECT 'run=' || o_custkey AS run_id, o_orderkey AS scan_index, 'scan=' || o_orderkey AS id,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS TINYINT) AS ms_level,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS FLOAT) AS rt,
         CAST(nullif((o_orderkey % 8) * 0.25, 0) AS FLOAT) AS ion_mobility
  FROM orders)"""

PEAKS = SPECTRA + """,
peaks AS (
  SELECT s.*, CAST(l_extendedprice AS FLOAT) AS mz, CAST(l_quantity AS FLOAT) AS intensity,
         l_extendedprice AS mz64, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                            CAST(l_quantity AS FLOAT)) - 1 AS peak_index
  FROM spectra s JOIN lineitem ON l_orderkey = scan_index)"""

POINTS = """
points AS (
  SELECT 'user=' || user_id AS run_id, event_type || '_' || user_id AS id,
         CAST(user_id + 0.25 AS FLOAT) AS precursor_mz, CAST(user_id + 0.5 AS FLOAT) AS product_mz,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS time,
         CAST(value AS FLOAT) AS intensity,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS peak_index
  FROM events)"""

LONG = f"""{PEAKS}, {POINTS},
long_table AS (
  SELECT run_id, id, 'spectrum' AS data_type, ms_level, rt, mz, intensity, ion_mobility FROM peaks
  UNION ALL
  SELECT run_id, id, 'chromatogram', CAST(NULL AS TINYINT), CAST(time AS FLOAT), product_mz, intensity,
         CAST(NULL AS FLOAT) FROM points)"""

BOXES = """
boxes AS (
  SELECT i AS box_id, CAST(i % 3 + 1 AS TINYINT) AS box_level,
         CAST(1000.0 + (i * 7919) % 100000 - 50.0 AS FLOAT) AS mz_lo,
         CAST(1000.0 + (i * 7919) % 100000 + 50.0 AS FLOAT) AS mz_hi,
         CAST((i * 104729) % 2400 - 60.0 AS FLOAT) AS rt_lo,
         CAST((i * 104729) % 2400 + 60.0 AS FLOAT) AS rt_hi
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(100)))"""

# Spectra with the times that their XML gives, and the time of the spectrum that a precursor names or of the last one a level below.
TIMED = SPECTRA + """,
timed AS (SELECT *, CAST(rt AS DOUBLE) * CASE WHEN scan_index % 2 = 1 THEN 60 ELSE 1 END AS seconds FROM spectra),
before AS (
  SELECT *, last_value(CASE WHEN ms_level = 1 THEN scan_index END IGNORE NULLS) OVER w AS last1,
         last_value(CASE WHEN ms_level = 2 THEN scan_index END IGNORE NULLS) OVER w AS last2,
         row_number() OVER (PARTITION BY run_id ORDER BY scan_index) AS place
  FROM timed
  WINDOW w AS (PARTITION BY run_id ORDER BY scan_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
records AS (
  SELECT b.*, o_custkey AS cust,
         CASE WHEN b.ms_level > 1 THEN coalesce(named.seconds, below.seconds) END AS precursor_rt
  FROM before b JOIN orders ON o_orderkey = b.scan_index
  LEFT JOIN timed named ON b.scan_index % 7 = 0 AND named.scan_index = b.scan_index - 1 AND named.run_id = b.run_id
  LEFT JOIN timed below ON below.scan_index = CASE b.ms_level WHEN 2 THEN b.last1 WHEN 3 THEN b.last2 END)"""

MZ_RANGE = "mz BETWEEN CAST(20000 AS FLOAT) AND CAST(25000 AS FLOAT)"
RT_RANGE = "rt BETWEEN CAST(100 AS FLOAT) AND CAST(400 AS FLOAT)"
MEASURES = "CAST(rt AS DOUBLE) AS rt, CAST(mz AS DOUBLE) AS mz, CAST(intensity AS DOUBLE) AS intensity"


def _summary(source: str, where: str) -> str:
    return f"""
SELECT ms_level, count(*) AS n_rows, count(DISTINCT id) AS n_spectra, CAST(min(mz) AS DOUBLE) AS mz_lo,
       CAST(max(mz) AS DOUBLE) AS mz_hi, sum(CAST(intensity AS DOUBLE)) AS sum_intensity
FROM {source} WHERE {where} GROUP BY ms_level"""


# The made XML documents, relationally.
ITEMS = """
items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_returnflag AS tag, l_linenumber AS line, l_partkey AS part,
         l_suppkey AS supp, l_linestatus AS status,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' < & ' || l_linenumber AS body,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            CAST(l_quantity AS INTEGER), l_returnflag, l_linestatus) AS pos,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey,
                            CAST(l_quantity AS INTEGER), l_linestatus) - 1 AS idx
  FROM lineitem),
docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS prio, o_orderstatus AS status FROM orders)"""

FLAT = ITEMS + """,
flat AS (
  SELECT doc_id, 'run:@status' AS path, status AS value FROM docs
  UNION ALL SELECT doc_id, 'run:@prio', prio FROM docs
  UNION ALL SELECT doc_id, 'run:note[0]:#text', '"' || prio || '"' FROM docs
  UNION ALL SELECT doc_id, 'run:' || tag || '[' || idx || ']:@supp', CAST(supp AS VARCHAR) FROM items
  UNION ALL SELECT doc_id, 'run:' || tag || '[' || idx || ']:@part', CAST(part AS VARCHAR) FROM items
  UNION ALL SELECT doc_id, 'run:' || tag || '[' || idx || ']:#text', body FROM items WHERE status = 'O')"""

KEYS = """
keys AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         CASE WHEN l_orderkey % 100 < 3 AND l_linenumber % 2 = 0 THEN 'other' ELSE 'run' END AS root,
         CASE WHEN l_partkey % 10 = 0 THEN 'peak' ELSE 'peak[' || l_linenumber || ']' END AS middle,
         CASE l_partkey % 3 WHEN 0 THEN '@p' || l_partkey WHEN 1 THEN '#text'
              ELSE 'sub[' || l_suppkey % 5 || ']' END AS last,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value
  FROM lineitem)"""

SEGMENTS = KEYS + """,
segments AS (
  SELECT 0 AS "at", root AS segment FROM keys
  UNION ALL SELECT 1, middle FROM keys
  UNION ALL SELECT 2, last FROM keys)"""

NAMED_PEAKS = KEYS + """,
named AS (SELECT DISTINCT doc_id, root, line FROM keys WHERE part % 10 <> 0),
ends AS (SELECT doc_id, root, max(line) AS top FROM named GROUP BY doc_id, root),
every AS (SELECT doc_id, root, CAST(unnest(range(top + 1)) AS BIGINT) AS idx FROM ends)"""

ORDER_PAIRS = """
WITH pairs AS (
  SELECT 'doc/' || l_orderkey % 32 AS doc_id, 'run:o' || l_orderkey || '[0]:' AS o, l_linenumber AS line, l_partkey AS part,
         l_returnflag || ' > & < é' || chr(10) || l_partkey AS text, l_linestatus AS status, l_orderkey
  FROM lineitem),
every AS (
  SELECT doc_id, o || '#text' AS path, 'order ' || l_orderkey AS value FROM pairs
  UNION ALL SELECT doc_id, o || 'line[' || line || ']:@part', '"' || part FROM pairs
  UNION ALL SELECT doc_id, o || 'line[' || line || ']:#text', text FROM pairs WHERE status = 'O')
SELECT doc_id, path, max(value) AS value FROM every GROUP BY doc_id, path"""

ORACLE = {
    "tree_document_files": ORDER_PAIRS,
    "flat_json_files": ORDER_PAIRS,
    "extract_box": f"""
WITH {PEAKS}
SELECT run_id, id, ms_level, {MEASURES} FROM peaks WHERE {MZ_RANGE} AND {RT_RANGE}""",
    "extract_box_wide": f"""
WITH {PEAKS}
SELECT run_id, id, ms_level, {MEASURES} FROM peaks WHERE {MZ_RANGE} AND {RT_RANGE} AND ms_level = 1""",
    "wide_has_mz": """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n FROM embeddings
WHERE list_bool_or(list_transform(embedding, lambda x: x BETWEEN CAST(0.30 AS FLOAT) AND CAST(0.31 AS FLOAT)))""",
    "wide_spectra_with_mz": f"""
WITH {PEAKS}
SELECT id, ms_level, CAST(count(*) AS INTEGER) AS n_peaks, min(mz64) AS mz_min, max(mz64) AS mz_max
FROM peaks WHERE {RT_RANGE} AND ms_level = 2
GROUP BY id, ms_level HAVING bool_or(mz64 BETWEEN 20000 AND 25000)""",
    "extract_boxes_batch": f"""
WITH {PEAKS}, {BOXES}
SELECT box_id, id, ms_level, {MEASURES}
FROM peaks JOIN boxes ON ms_level = box_level AND mz BETWEEN mz_lo AND mz_hi AND rt BETWEEN rt_lo AND rt_hi""",
    "box_mean_hits": f"""
WITH {PEAKS}, {BOXES},
per_box AS (
  SELECT box_id, box_level, count(id) AS n_hits
  FROM boxes LEFT JOIN peaks
    ON ms_level = box_level AND mz BETWEEN mz_lo AND mz_hi AND rt BETWEEN rt_lo AND rt_hi
  GROUP BY box_id, box_level)
SELECT box_level AS ms_level, count(*) AS n_boxes, CAST(sum(n_hits) AS BIGINT) AS n_hits,
       round(avg(n_hits), 6) AS mean_hits
FROM per_box GROUP BY box_level""",
    "filter_data_type": f"""
WITH {LONG}
SELECT data_type, count(*) AS n_rows, sum(CAST(intensity AS DOUBLE)) AS sum_intensity
FROM long_table WHERE data_type = 'spectrum' GROUP BY data_type""",
    "rt_window": f"WITH {PEAKS} {_summary('peaks', RT_RANGE)}",
    "mz_window": f"WITH {PEAKS} {_summary('peaks', MZ_RANGE)}",
    "ms_level_filter": f"WITH {LONG} {_summary('long_table', 'ms_level = 2')}",
    "fetch_by_ids": f"""
WITH {PEAKS}
SELECT id, ms_level, {MEASURES} FROM peaks
WHERE id IN ('scan=0', 'scan=1', 'scan=7', 'scan=42', 'scan=100', 'scan=333', 'scan=999', 'scan=1234')""",
    "fetch_sampled": f"""
WITH {PEAKS},
sample AS (SELECT id FROM spectra ORDER BY (scan_index * 7919 + 13) % 1000003, id LIMIT 100)
SELECT id, ms_level, {MEASURES} FROM peaks WHERE id IN (SELECT id FROM sample)""",
    "distinct_ids": f"WITH {PEAKS} SELECT DISTINCT run_id, id FROM peaks",
    "count_spectra": f"""
WITH {PEAKS} SELECT count(*) AS n_spectra, count(*) >= 100 AS enough FROM (SELECT DISTINCT run_id, id FROM peaks)""",
    "wide_to_long": f"""
WITH {PEAKS}
SELECT id, 'spectrum' AS data_type, ms_level, CAST(peak_index AS INTEGER) AS peak_index, {MEASURES},
       CAST(ion_mobility AS DOUBLE) AS ion_mobility
FROM peaks""",
    "long_to_wide": f"""
WITH {PEAKS}
SELECT s.id, s.ms_level, CAST(s.rt AS DOUBLE) AS rt, CAST(count(p.id) AS INTEGER) AS n_peaks,
       first(mz64 ORDER BY peak_index) AS mz_first, last(mz64 ORDER BY peak_index) AS mz_last,
       min(mz64) AS mz_min, max(mz64) AS mz_max,
       coalesce(sum(CAST(intensity AS DOUBLE)), 0) AS sum_intensity,
       coalesce(CAST(sum(CAST(round(mz64 * 100) AS BIGINT) * (peak_index + 1)) AS BIGINT), 0) AS mz_weighted,
       coalesce(CAST(sum(CAST(round(CAST(intensity AS DOUBLE)) AS BIGINT) * (peak_index + 1)) AS BIGINT), 0) AS intensity_weighted
FROM spectra s LEFT JOIN peaks p ON p.scan_index = s.scan_index
GROUP BY s.id, s.ms_level, s.rt""",
    "chrom_wide": f"""
WITH {POINTS}
SELECT run_id, id, 'chromatogram' AS data_type, CAST(precursor_mz AS DOUBLE) AS precursor_mz,
       CAST(product_mz AS DOUBLE) AS product_mz, CAST(count(*) AS INTEGER) AS n_points,
       first(time ORDER BY peak_index) AS time_first, last(time ORDER BY peak_index) AS time_last,
       CAST(first(intensity ORDER BY peak_index) AS DOUBLE) AS intensity_first,
       CAST(last(intensity ORDER BY peak_index) AS DOUBLE) AS intensity_last,
       CAST(sum(CAST(round(time * 1000000) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS time_weighted,
       CAST(sum(CAST(round(CAST(intensity AS DOUBLE) * 1000) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS intensity_weighted
FROM points GROUP BY run_id, id, precursor_mz, product_mz""",
    "chrom_to_long": f"""
WITH {POINTS}
SELECT id, 'chromatogram' AS data_type, CAST(NULL AS TINYINT) AS ms_level,
       CAST(peak_index AS INTEGER) AS peak_index, CAST(CAST(time AS FLOAT) AS DOUBLE) AS rt,
       CAST(product_mz AS DOUBLE) AS mz, CAST(intensity AS DOUBLE) AS intensity,
       CAST(NULL AS DOUBLE) AS ion_mobility
FROM points""",
    "long_union": f"""
WITH {LONG}
SELECT data_type, ms_level, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(ion_mobility) AS n_mobility,
       CAST(min(mz) AS DOUBLE) AS mz_lo, CAST(max(mz) AS DOUBLE) AS mz_hi
FROM long_table GROUP BY data_type, ms_level""",
    "empty_spectra": f"""
WITH {SPECTRA}
SELECT id, ms_level, CAST(rt AS DOUBLE) AS rt, 0 AS n_peaks FROM spectra
WHERE scan_index NOT IN (SELECT l_orderkey FROM lineitem)""",
    "zip_truncate": """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(embedding[pos + 1] AS DOUBLE) AS a,
       CAST(embedding[pos + 1] AS DOUBLE) AS b
FROM (SELECT vec_id, embedding, unnest(range(least(len(embedding), label * 5 + 3))) AS pos FROM embeddings)""",
    "array_stats": """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(list_min(embedding) AS DOUBLE) AS lo,
       CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(embedding[1] AS DOUBLE) AS first,
       CAST(embedding[-1] AS DOUBLE) AS last,
       CAST(list_sum(list_transform(embedding, lambda x, i: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) * i)) AS BIGINT) AS weighted
FROM embeddings""",
    "narrow_casts": """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS TINYINT) AS line,
       CAST(l_quantity AS TINYINT) AS qty, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price,
       TRY_CAST(l_partkey AS TINYINT) AS part
FROM lineitem""",
    "null_if_zero": """
SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_tax, 0)) AS n_taxed,
       round(avg(nullif(l_tax, 0)), 8) AS mean_tax
FROM lineitem GROUP BY l_returnflag""",
    "unit_normalize": """
SELECT event_id, event_type, value * CAST(CASE event_type WHEN 'click' THEN 60 ELSE 1 END AS DOUBLE) AS seconds
FROM events""",
    "array_codec_roundtrip": """
SELECT vec_id, CASE WHEN label % 2 = 0 THEN 32 ELSE 64 END AS bits, CAST(len(embedding) AS INTEGER) AS n,
       CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, true AS same
FROM embeddings""",
    "parquet_roundtrip_long": f"""
WITH {LONG}
SELECT data_type, ms_level, count(*) AS n_rows, count(DISTINCT id) AS n_ids, CAST(min(mz) AS DOUBLE) AS mz_lo,
       CAST(max(mz) AS DOUBLE) AS mz_hi,
       CAST(CAST(sum(CAST(intensity AS DOUBLE)) AS DECIMAL(20, 2)) AS DOUBLE) AS sum_intensity
FROM long_table GROUP BY data_type, ms_level""",
    "store_add_runs": f"""
WITH {LONG}
SELECT run_id, data_type, count(*) AS n_rows, count(DISTINCT id) AS n_ids,
       CAST(CAST(sum(CAST(mz AS DOUBLE)) AS DECIMAL(20, 2)) AS DOUBLE) AS sum_mz,
       CAST(CAST(sum(CAST(intensity AS DOUBLE)) AS DECIMAL(20, 2)) AS DOUBLE) AS sum_intensity
FROM long_table GROUP BY run_id, data_type""",
    "store_fetch_indexed": f"""
WITH {PEAKS},
indexed AS (SELECT DISTINCT run_id, id, scan_index FROM peaks),
sample AS (SELECT run_id, id FROM indexed ORDER BY (scan_index * 7919 + 13) % 1000003, run_id, id LIMIT 100)
SELECT run_id, id, ms_level, {MEASURES}, (SELECT count(*) FROM indexed) AS n_indexed
FROM peaks WHERE (run_id, id) IN (SELECT (run_id, id) FROM sample)""",
    "parquet_roundtrip_wide": f"""
WITH {PEAKS}, {POINTS}
SELECT 'spectrum' AS data_type, (SELECT count(*) FROM orders) AS n_ids, count(*) AS n_points,
       CAST(sum(CAST(round(mz64 * 100) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS x_weighted,
       CAST(sum(CAST(round(CAST(intensity AS DOUBLE)) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS y_weighted
FROM peaks
UNION ALL
SELECT 'chromatogram', count(DISTINCT id), count(*), CAST(sum(CAST(round(time * 1000) AS BIGINT) * (peak_index + 1)) AS BIGINT),
       CAST(sum(CAST(round(CAST(intensity AS DOUBLE) * 100) AS BIGINT) * (peak_index + 1)) AS BIGINT)
FROM points""",
    "precursor_asof": f"""
WITH {SPECTRA},
seen AS (
  SELECT *, last_value(CASE WHEN ms_level = 1 THEN scan_index END IGNORE NULLS) OVER w AS last1,
         last_value(CASE WHEN ms_level = 2 THEN scan_index END IGNORE NULLS) OVER w AS last2
  FROM spectra
  WINDOW w AS (PARTITION BY run_id ORDER BY scan_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (
  SELECT run_id, scan_index, ms_level, CASE ms_level WHEN 2 THEN last1 WHEN 3 THEN last2 END AS precursor_index
  FROM seen)
SELECT f.run_id, f.scan_index, f.ms_level, precursor_index, CAST(s.rt AS DOUBLE) AS precursor_rt
FROM found f LEFT JOIN spectra s ON s.scan_index = precursor_index""",
    "scan_index": f"""
WITH {SPECTRA}
SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY scan_index) - 1 AS number FROM spectra""",
    "precursor_fields": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS mz, CAST(l_partkey % 4 AS INTEGER) AS charge,
       l_tax AS intensity, l_extendedprice AS selected_ion_mz,
       nullif(CAST(l_partkey % 4 AS INTEGER), 0) AS selected_ion_charge,
       nullif(l_tax, 0) AS selected_ion_intensity, l_extendedprice AS isolation_window_target
FROM lineitem""",
    "enum_labels": """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'POSITIVE' WHEN '2-HIGH' THEN 'NEGATIVE'
       ELSE 'UNKNOWN' END AS label
FROM orders""",
    "tree_nodes": f"""
WITH {ITEMS}
SELECT 'run' AS tag, 0 AS depth, count(*) AS n_nodes, 2 * count(*) AS n_attrs, CAST(0 AS BIGINT) AS sum_pos FROM docs
UNION ALL SELECT 'note', 1, count(*), 0, 0 FROM docs
UNION ALL SELECT tag, 1, count(*), 2 * count(*), CAST(sum(pos) AS BIGINT) FROM items GROUP BY tag""",
    "sibling_index": f"""
WITH {ITEMS}
SELECT doc_id, 'note' AS tag, 1 AS depth, 0 AS pos, CAST(0 AS BIGINT) AS sibling_index FROM docs
UNION ALL SELECT doc_id, 'run', 0, 0, 0 FROM docs
UNION ALL SELECT doc_id, tag, 1, CAST(pos AS INTEGER), idx FROM items""",
    "tree_flatten": f"WITH {FLAT} SELECT doc_id, path, value FROM flat",
    "tree_item_counts": f"WITH {FLAT} SELECT doc_id, count(*) AS n_items FROM flat GROUP BY doc_id",
    "clean_tag": "SELECT o_orderkey, o_orderpriority AS tag FROM orders",
    "key_parse": f"""
WITH {SEGMENTS}
SELECT segment, count(*) AS n, regexp_extract(segment, '^(.*)\\[(\\d+)\\]$', 1) AS tag,
       TRY_CAST(nullif(regexp_extract(segment, '^(.*)\\[(\\d+)\\]$', 2), '') AS BIGINT) AS idx
FROM segments GROUP BY segment""",
    "key_classify": f"""
WITH {SEGMENTS}
SELECT CAST("at" AS INTEGER) AS "at", CASE WHEN "at" = 0 THEN 'root' WHEN segment LIKE '@%' THEN 'attribute'
       WHEN segment = '#text' THEN 'text' WHEN segment LIKE '%]' THEN 'element' ELSE 'malformed' END AS kind,
       count(*) AS n
FROM segments GROUP BY ALL""",
    "key_malformed": f"""
WITH {KEYS}
SELECT doc_id, root || ':' || middle || ':' || last AS path, value FROM keys WHERE middle = 'peak'""",
    "tree_root_check": f"""
WITH {KEYS}
SELECT doc_id, CASE WHEN count(DISTINCT root) = 1 THEN min(root) END AS root,
       CASE WHEN count(DISTINCT root) = 1 THEN 'ok' ELSE 'multiple_roots' END AS status
FROM keys GROUP BY doc_id""",
    "tree_gap_fill": f"""
WITH {NAMED_PEAKS},
subs AS (
  SELECT DISTINCT doc_id, root, line, CAST(regexp_extract(last, '\\[(\\d+)\\]', 1) AS BIGINT) AS idx FROM keys
  WHERE part % 10 <> 0 AND part % 3 = 2),
sub_every AS (
  SELECT doc_id, root, line, CAST(unnest(range(top + 1)) AS BIGINT) AS idx
  FROM (SELECT doc_id, root, line, max(idx) AS top FROM subs GROUP BY doc_id, root, line))
SELECT doc_id, 'peak' AS tag, count(*) AS n_missing, min(idx) AS first_missing, max(idx) AS last_missing
FROM every WHERE (doc_id, root, idx) NOT IN (SELECT (doc_id, root, line) FROM named)
GROUP BY doc_id
UNION ALL SELECT doc_id, 'sub', count(*), min(idx), max(idx) FROM sub_every ANTI JOIN subs USING (doc_id, root, line, idx)
GROUP BY doc_id""",
    "tree_reconstruct": f"""
WITH {ITEMS},
children AS (
  SELECT doc_id, string_agg(
           '<' || tag || ' part="' || part || '" supp="' || supp || '"' ||
           CASE WHEN status = 'O' THEN '>' || replace(replace(body, '&', '&amp;'), '<', '&lt;') || '</' || tag || '>'
                ELSE ' />' END, '' ORDER BY tag, idx) AS xml
  FROM items GROUP BY doc_id)
SELECT d.doc_id, '<run xmlns="urn:doc" prio="' || prio || '" status="' || status || '">' || coalesce(xml, '') ||
       '<note>"' || prio || '"</note></run>' AS xml
FROM docs d LEFT JOIN children c ON c.doc_id = d.doc_id""",
    "tree_reconstruct_gaps": f"""
WITH {NAMED_PEAKS},
good AS (SELECT doc_id, min(root) AS root FROM keys GROUP BY doc_id HAVING count(DISTINCT root) = 1),
pairs AS (
  SELECT doc_id, line, last, part % 3 AS kind, min(value) AS value FROM keys WHERE part % 10 <> 0
  GROUP BY doc_id, line, last, part % 3),
attrs AS (
  SELECT doc_id, line, string_agg(' ' || substr(last, 2) || '="' || value || '"', '' ORDER BY last) AS attrs
  FROM pairs WHERE kind = 0 GROUP BY doc_id, line),
texts AS (SELECT doc_id, line, min(value) AS text FROM pairs WHERE kind = 1 GROUP BY doc_id, line),
subs AS (
  SELECT doc_id, line, repeat('<sub />', max(CAST(regexp_extract(last, '[0-9]+') AS INTEGER)) + 1) AS subs
  FROM pairs WHERE kind = 2 GROUP BY doc_id, line),
elements AS (
  SELECT e.doc_id, idx, '<peak' || coalesce(attrs, '') ||
         CASE WHEN text IS NULL AND subs IS NULL THEN ' />'
              ELSE '>' || coalesce(text, '') || coalesce(subs, '') || '</peak>' END AS xml
  FROM every e
  LEFT JOIN attrs a ON a.doc_id = e.doc_id AND a.line = idx
  LEFT JOIN texts t ON t.doc_id = e.doc_id AND t.line = idx
  LEFT JOIN subs s ON s.doc_id = e.doc_id AND s.line = idx),
bodies AS (SELECT doc_id, string_agg(xml, '' ORDER BY idx) AS body FROM elements GROUP BY doc_id)
SELECT g.doc_id, CASE WHEN body IS NULL THEN '<' || root || ' />'
       ELSE '<' || root || '>' || body || '</' || root || '>' END AS xml
FROM good g LEFT JOIN bodies b ON b.doc_id = g.doc_id""",
    "tree_roundtrip": f"WITH {FLAT} SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_different FROM flat",
    "tree_quarantine": """
SELECT 'parsed' AS status, count(*) AS n_docs FROM orders
UNION ALL SELECT 'quarantined', count(*) FROM pages""",
    "flat_json_explode": """
SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events""",
    "flat_to_json": """
SELECT 'user=' || user_id AS doc_id, CAST(count(*) AS INTEGER) AS n_items,
       '{' || string_agg('"event[' || lpad(CAST(event_id AS VARCHAR), 10, '0') || ']:@type":"' || event_type ||
                         '-\\u00E9"', ',' ORDER BY event_id) || '}' AS json
FROM events GROUP BY user_id""",
    "meta_map": """
SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n_keys,
       CAST(max(last) FILTER (event_type = 'click') AS VARCHAR) AS click,
       string_agg(event_type || '=' || last, '|' ORDER BY event_type) AS entries
FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
    "meta_merge": """
SELECT event_id, 2 AS n_keys, json_extract_string(props, '$.k') AS k, event_type AS type FROM events""",
    "run_metadata_doc": f"""
WITH {SPECTRA},
numbered AS (
  SELECT s.*, o_orderpriority AS priority, o_custkey,
         row_number() OVER (PARTITION BY run_id ORDER BY scan_index) AS n
  FROM spectra s JOIN orders ON o_orderkey = scan_index),
per_run AS (
  SELECT a.run_id, (SELECT count(*) FROM spectra s WHERE s.run_id = a.run_id) AS n_spectra, a.id AS first_id,
         a.priority AS first_priority, CASE WHEN a.ms_level > 1 THEN a.o_custkey % 3 END AS first_charge,
         CASE WHEN b.ms_level = a.ms_level + 1 THEN CAST(a.rt AS DOUBLE) END AS second_precursor_rt
  FROM numbered a LEFT JOIN numbered b ON b.run_id = a.run_id AND b.n = 2
  WHERE a.n = 1),
chroms AS (
  SELECT 'run=' || user_id AS run_id, count(*) AS n, first(event_type ORDER BY event_id) AS first_chromatogram
  FROM events GROUP BY user_id),
runs AS (
  SELECT 'run=' || c_custkey AS run_id, c_name, c_mktsegment, c_nationkey FROM customer)
SELECT run_id, c_name AS instrument, c_mktsegment AS file,
       CAST(c_nationkey AS VARCHAR) AS nation, CAST(coalesce(n_spectra, 0) AS INTEGER) AS n_spectra,
       CAST(coalesce(n, 0) AS INTEGER) AS n_chromatograms, first_id, first_priority,
       CAST(first_charge AS INTEGER) AS first_charge, CAST(nullif(first_charge, 0) AS INTEGER) AS first_ion_charge,
       second_precursor_rt, first_chromatogram
FROM runs FULL JOIN per_run USING (run_id) FULL JOIN chroms USING (run_id)""",
    "mzml_spectra": f"""
WITH {PEAKS},
packed AS (
  SELECT scan_index, count(*) AS n, min(mz64) AS lo, max(mz64) AS hi,
         CAST(sum(CAST(round(mz64 * 100) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS mz_weighted,
         CAST(sum(CAST(round(CAST(intensity AS DOUBLE)) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS intensity_weighted
  FROM peaks GROUP BY scan_index)
SELECT run_id, id, s.scan_index, ms_level,
       CAST(CAST(rt AS DOUBLE) * CASE WHEN s.scan_index % 2 = 1 THEN 60 ELSE 1 END AS DOUBLE) AS rt,
       CAST(ion_mobility AS DOUBLE) AS ion_mobility, CAST(coalesce(n, 0) AS INTEGER) AS n_peaks, lo AS mz_min, hi AS mz_max,
       coalesce(mz_weighted, 0) AS mz_weighted, coalesce(intensity_weighted, 0) AS intensity_weighted
FROM spectra s LEFT JOIN packed p ON p.scan_index = s.scan_index""",
    "mzml_file_ranges": f"""
WITH {PEAKS},
packed AS (
  SELECT scan_index, count(*) AS n, min(mz64) AS lo, max(mz64) AS hi,
         CAST(sum(CAST(round(mz64 * 100) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS mz_weighted,
         CAST(sum(CAST(round(CAST(intensity AS DOUBLE)) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS intensity_weighted
  FROM peaks GROUP BY scan_index)
SELECT id, s.scan_index, ms_level,
       CAST(CAST(rt AS DOUBLE) * CASE WHEN s.scan_index % 2 = 1 THEN 60 ELSE 1 END AS DOUBLE) AS rt,
       CAST(ion_mobility AS DOUBLE) AS ion_mobility, CAST(coalesce(n, 0) AS INTEGER) AS n_peaks, lo AS mz_min, hi AS mz_max,
       coalesce(mz_weighted, 0) AS mz_weighted, coalesce(intensity_weighted, 0) AS intensity_weighted
FROM spectra s LEFT JOIN packed p ON p.scan_index = s.scan_index""",
    "mzml_spectrum_meta": f"""
WITH {SPECTRA},
full_ AS (
  SELECT s.*, o_custkey AS cust, scan_index AS k, o_orderpriority AS priority, ms_level > 1 AS has_precursor, ms_level = 3 AS has_product
  FROM spectra s JOIN orders ON o_orderkey = scan_index)
SELECT run_id, id, CAST(rt AS DOUBLE) * CASE WHEN k % 2 = 1 THEN 60 ELSE 1 END AS rt,
       '{{"preset":"p' || (k % 4) || '","priority":"' || priority || '"}}' AS meta_values,
       CASE WHEN has_precursor AND k % 7 = 0 THEN 'scan=' || (k - 1) END AS precursor_spectrum_ref,
       CASE WHEN has_precursor THEN cust + CASE WHEN k % 11 <> 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS precursor_mz,
       CASE WHEN has_precursor THEN CAST(cust % 3 AS INTEGER) END AS precursor_charge,
       CASE WHEN has_precursor THEN CAST(k % 100 AS DOUBLE) END AS precursor_intensity,
       CASE WHEN has_precursor THEN 0.5::DOUBLE END AS precursor_isolation_window_lower_offset,
       CASE WHEN has_precursor THEN 0.75::DOUBLE END AS precursor_isolation_window_upper_offset,
       CASE WHEN has_precursor THEN CAST(cust % 40 AS DOUBLE) END AS precursor_activation_energy,
       CASE WHEN has_precursor THEN 'collision-induced dissociation' END AS activation_methods,
       CASE WHEN has_product THEN cust + 0.125::DOUBLE END AS product_mz,
       CASE WHEN has_product THEN 1.0::DOUBLE END AS product_isolation_window_lower_offset,
       CASE WHEN has_product THEN 2.0::DOUBLE END AS product_isolation_window_upper_offset
FROM full_""",
    "mzml_chromatograms": f"""
WITH {POINTS}
SELECT run_id, id, CAST(substr(run_id, 6) AS BIGINT) AS chromatogram_index, 'chromatogram' AS data_type,
       CAST(precursor_mz AS DOUBLE) AS precursor_mz,
       CASE WHEN CAST(substr(run_id, 6) AS BIGINT) % 3 <> 0 THEN CAST(product_mz AS DOUBLE) END AS product_mz,
       CAST(count(*) AS INTEGER) AS n_points,
       CAST(sum(CAST(round(time * 1000000) AS BIGINT) * (peak_index + 1)) AS BIGINT) AS time_weighted,
       CAST(first(intensity ORDER BY peak_index) AS DOUBLE) AS intensity_first,
       CAST(last(intensity ORDER BY peak_index) AS DOUBLE) AS intensity_last
FROM points GROUP BY run_id, id, precursor_mz, product_mz""",
    "mzml_chromatogram_meta": """
SELECT DISTINCT 'user=' || user_id AS run_id, CAST(user_id AS BIGINT) AS chromatogram_index, event_type || '_' || user_id AS native_id,
       'total ion current chromatogram' AS terms, user_id + 0.25::DOUBLE AS precursor_mz,
       CASE WHEN user_id % 3 <> 0 THEN user_id + 0.5::DOUBLE END AS product_mz
FROM events""",
    "mzml_headers": """
SELECT 'run=' || c_custkey AS run_id, 'Model ' || c_nationkey AS instrument,
       CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE '' END AS customizations, 'UNKNOWN' AS ion_optics,
       'Xcalibur' AS software, c_nationkey || '.1' AS version, 1 AS source_order,
       CASE WHEN c_custkey % 3 = 0 THEN 'POSITIVE' ELSE 'UNKNOWN' END AS polarity,
       CASE WHEN c_custkey % 2 = 0 THEN 'ESI' ELSE 'MALDI' END AS ionization_method, 'NANOSPRAY' AS inlet_type,
       CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS n_analyzers,
       CASE WHEN c_custkey % 2 = 0 THEN 'ORBITRAP' ELSE 'TOF' END || CASE WHEN c_custkey % 4 = 0 THEN '|QUADRUPOLE' ELSE '' END AS analyzers,
       CAST(c_nationkey * 1000 AS DOUBLE) AS resolution, 'UNKNOWN' AS scan_law, 'inductive detector' AS detector,
       CAST(c_nationkey AS DOUBLE) AS sampling, 'UNKNOWN' AS acquisition_mode, c_name || '.raw' AS name_of_file,
       'file:///' || c_mktsegment AS path_to_file, 'Thermo RAW format' AS file_type, CAST(c_custkey AS VARCHAR) AS checksum,
       CASE WHEN c_custkey % 2 = 0 THEN 'SHA1' ELSE 'MD5' END AS checksum_type, 'Thermo nativeID format' AS native_id_type,
       'MS:1000768' AS native_id_type_accession, '{"segment":"' || c_mktsegment || '"}' AS experiment_meta
FROM customer""",
    "mzml_quarantine": f"""
WITH {SPECTRA}
SELECT run_id, 'not well-formed' AS error, count(*) FILTER (scan_index % 10 = 0) AS n_broken,
       count(*) FILTER (scan_index % 10 <> 0) AS n_read
FROM spectra GROUP BY run_id HAVING count(*) FILTER (scan_index % 10 = 0) > 0""",
    "json_quarantine": """
SELECT DISTINCT 'user=' || user_id AS doc_id, 'not a JSON object' AS error FROM events WHERE user_id % 3 = 0""",
    "metadata_attached": f"""
WITH {TIMED},
s AS (
  SELECT run_id, CAST(count(*) AS INTEGER) AS n_spectra, CAST(sum(place * scan_index) * 1000 AS BIGINT) AS ids,
         CAST(sum(place * seconds) * 1000 AS BIGINT) AS times,
         CAST(coalesce(sum(place * precursor_rt), 0) * 1000 AS BIGINT) AS precursor_times,
         CAST(sum(CASE WHEN ms_level > 1 THEN place * (cust % 3) ELSE 0 END) * 1000 AS BIGINT) AS precursor_charges,
         CAST(sum(CASE WHEN ms_level = 3 THEN place * (cust * 1000 + 125) ELSE 0 END) AS BIGINT) AS product_mzs
  FROM records GROUP BY run_id),
p AS (SELECT run_id, count(*) AS n_peaks FROM spectra JOIN lineitem ON l_orderkey = scan_index GROUP BY run_id),
e AS (
  SELECT 'run=' || user_id AS run_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n_chromatograms, count(*) AS n_points,
         min(user_id) + 0.25::DOUBLE AS precursor_mz
  FROM events GROUP BY user_id),
h AS (
  SELECT 'run=' || c_custkey AS run_id, 'Model ' || c_nationkey AS instrument, CAST(c_custkey AS VARCHAR) AS checksum
  FROM customer)
SELECT run_id, instrument, checksum, coalesce(n_spectra, 0) AS n_spectra, coalesce(n_chromatograms, 0) AS n_chromatograms,
       coalesce(ids, 0) AS ids, coalesce(times, 0) AS times, coalesce(precursor_times, 0) AS precursor_times,
       coalesce(precursor_charges, 0) AS precursor_charges, coalesce(product_mzs, 0) AS product_mzs, precursor_mz, true AS same,
       coalesce(n_peaks, 0) AS n_peaks, coalesce(n_points, 0) AS n_points, CAST(coalesce(n_spectra, 0) AS BIGINT) AS n_wide
FROM h FULL JOIN s USING (run_id) FULL JOIN e USING (run_id) LEFT JOIN p USING (run_id)""",
    "precursor_by_reference": f"""
WITH {TIMED}
SELECT run_id, scan_index, id AS native_id, ms_level, seconds AS rt, precursor_rt,
       CASE WHEN ms_level > 1 THEN cust + CASE WHEN scan_index % 11 <> 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS precursor_mz,
       CASE WHEN ms_level > 1 THEN CAST(cust % 3 AS DOUBLE) END AS precursor_charge,
       CASE WHEN ms_level > 1 THEN CAST(scan_index % 100 AS DOUBLE) END AS precursor_intensity,
       CASE WHEN ms_level > 1 THEN cust + CASE WHEN scan_index % 11 <> 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS precursor_selected_ion_mz,
       CASE WHEN ms_level > 1 THEN nullif(CAST(cust % 3 AS DOUBLE), 0) END AS precursor_selected_ion_charge,
       CASE WHEN ms_level > 1 THEN nullif(CAST(scan_index % 100 AS DOUBLE), 0) END AS precursor_selected_ion_intensity,
       CASE WHEN ms_level = 3 THEN cust + 0.125::DOUBLE END AS product_mz
FROM records""",
    "random_boxes": f"""
WITH {PEAKS},
shares AS (
  SELECT i AS box_id, CAST(CAST('0x' || substr(md5('42:0:' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496::DOUBLE AS a,
         CAST(CAST('0x' || substr(md5('42:1:' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496::DOUBLE AS b
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(200))),
drawn AS (SELECT box_id, 1000::DOUBLE + a * 99000::DOUBLE AS mz, b * 2400::DOUBLE AS rt FROM shares)
SELECT box_id, CAST(2 AS TINYINT) AS ms_level, d.mz, d.rt, count(p.id) AS n_hits
FROM drawn d LEFT JOIN peaks p
  ON p.ms_level = 2 AND p.mz BETWEEN CAST(d.mz - 500 AS FLOAT) AND CAST(d.mz + 500 AS FLOAT)
     AND p.rt BETWEEN CAST(d.rt - 60 AS FLOAT) AND CAST(d.rt + 60 AS FLOAT)
GROUP BY box_id, d.mz, d.rt""",
}
