"""Queries over sources and parsers (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.functions import tle
from zenithal.plans.registry import query
from zenithal.session import materialize, shared_dir
from zenithal.sources import catalogues, documents, journal, loaders, registry
from zenithal.sources import tle as tle_source

_CHECK = "list_sum(list_transform(string_split(regexp_replace(substr({0}, 1, 68), '[^0-9-]', '', 'g'), ''), lambda c: CASE WHEN c = '-' THEN 1 ELSE CAST(c AS INTEGER) END)) % 10"


@query("a1_tle_file", """
WITH RECURSIVE l AS (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY place) AS i, count(*) OVER (PARTITION BY file) AS n FROM tle_lines WHERE line <> '' AND line NOT LIKE '#%'),
w AS (SELECT file, CAST(1 AS BIGINT) AS i FROM l WHERE i = 1 UNION ALL SELECT w.file, w.i + CASE WHEN w.i + 2 <= l.n AND substr(l.line, 1, 2) NOT IN ('1 ', '2 ') THEN 3 WHEN w.i + 1 <= l.n AND substr(l.line, 1, 2) = '1 ' THEN 2 ELSE 1 END FROM w JOIN l ON l.file = w.file AND l.i = w.i)
SELECT a.file, CASE WHEN substr(a.line, 1, 2) = '1 ' THEN 'NORAD-' || trim(substr(a.line, 3, 5)) ELSE a.line END AS name, CASE WHEN substr(a.line, 1, 2) = '1 ' THEN a.line ELSE b.line END AS line1, CASE WHEN substr(a.line, 1, 2) = '1 ' THEN b.line ELSE c.line END AS line2
FROM w JOIN l a ON a.file = w.file AND a.i = w.i LEFT JOIN l b ON b.file = w.file AND b.i = w.i + 1 LEFT JOIN l c ON c.file = w.file AND c.i = w.i + 2
WHERE (substr(a.line, 1, 2) NOT IN ('1 ', '2 ') AND c.line IS NOT NULL) OR (substr(a.line, 1, 2) = '1 ' AND b.line IS NOT NULL)""")
def a1(t):
    return tle_source.sets(t.tle_lines)


@query("a2_tle_file_strict", """
WITH l AS (SELECT file, line AS name, lead(line, 1) OVER w AS line1, lead(line, 2) OVER w AS line2 FROM tle_lines WHERE line <> '' AND line NOT LIKE '#%' WINDOW w AS (PARTITION BY file ORDER BY place))
SELECT * FROM l WHERE line1 LIKE '1 %' AND line2 LIKE '2 %' AND name NOT LIKE '1 %' AND name NOT LIKE '2 %'""")
def a2(t):
    return tle_source.strict_sets(t.tle_lines)


@query("a3_tle_checksum", f"SELECT set_id, k, CAST({_CHECK.format('line1')} AS INTEGER) AS c1, CAST({_CHECK.format('line2')} AS INTEGER) AS c2 FROM tle_sets")
def a3(t):
    return t.tle_sets.select("set_id", "k", tle.checksum(F.col("line1")).alias("c1"), tle.checksum(F.col("line2")).alias("c2"))


@query("a4_packed_decimal", """
WITH f AS (SELECT set_id, k, CASE set_id % 4 WHEN 0 THEN 'junk' ELSE substr(line1, 54, 8) END AS f FROM tle_sets)
SELECT set_id, k, CASE WHEN regexp_matches(trim(f), '^[+-]*[0-9]+[+-][0-9]+$') THEN round(CASE WHEN trim(f) LIKE '-%' THEN -1 ELSE 1 END * CAST('0.' || regexp_extract(trim(f), '^[+-]*([0-9]+)', 1) AS DOUBLE) * pow(10e0, CAST(regexp_extract(trim(f), '([+-][0-9]+)$', 1) AS DOUBLE)), 12) ELSE 0e0 END AS value FROM f""")
def a4(t):
    field = F.when(F.col("set_id") % 4 == 0, "junk").otherwise(F.substring("line1", 54, 8))
    return t.tle_sets.select("set_id", "k", F.round(tle.packed_decimal(field), 12).alias("value"))


_YEAR = "CAST(substr(line1, 19, 2) AS INTEGER)"
_EPOCH = f"to_microseconds(CAST(round((CAST(substr(line1, 21, 12) AS DOUBLE) - 1) * 86400000000) AS BIGINT)) + make_timestamp({_YEAR} + CASE WHEN {_YEAR} < 57 THEN 2000 ELSE 1900 END, 1, 1, 0, 0, 0)"


@query("a5_tle_epoch", f"SELECT set_id, k, {_EPOCH} AS epoch FROM tle_sets")
def a5(t):
    f = tle.fields()
    return t.tle_sets.select("set_id", "k", tle.epoch(f["epoch_year"], f["epoch_day"]).alias("epoch"))


@query("a6_parse_tle", f"""
WITH p AS (SELECT set_id, k, line1, line2, CAST(trim(substr(line1, 3, 5)) AS INTEGER) AS id1, CAST(trim(substr(line2, 3, 5)) AS INTEGER) AS id2, CAST(trim(substr(line2, 9, 8)) AS DOUBLE) AS i, CAST('0.' || trim(substr(line2, 27, 7)) AS DOUBLE) AS e, CAST(trim(substr(line2, 53, 11)) AS DOUBLE) AS n FROM tle_sets),
a AS (SELECT *, pow(398600.4418e0 / pow(n * (2 * pi() / 86400), 2), 1e0 / 3) AS a FROM p)
SELECT set_id, k, id1 AS norad_id, i AS inclination_deg, e AS eccentricity, n AS mean_motion_rev_day, round(a, 6) AS semi_major_axis_km, round(a * (1 - e) - 6378.137e0, 6) AS perigee_km, round(a * (1 + e) - 6378.137e0, 6) AS apogee_km, round(1440 / n, 6) AS period_min,
  concat_ws(';', CASE WHEN {_CHECK.format('line1')} <> CAST(substr(line1, 69, 1) AS INTEGER) THEN 'checksum 1' END, CASE WHEN {_CHECK.format('line2')} <> CAST(substr(line2, 69, 1) AS INTEGER) THEN 'checksum 2' END, CASE WHEN id1 <> id2 THEN 'norad mismatch' END, CASE WHEN i > 180 THEN 'inclination' END) AS errors FROM a""")
def a6(t):
    f = tle.fields()
    plain, rounded = ["norad_id", "inclination_deg", "eccentricity", "mean_motion_rev_day"], ["semi_major_axis_km", "perigee_km", "apogee_km", "period_min"]
    return t.tle_sets.select("set_id", "k", *[f[c].alias(c) for c in plain], *[F.round(f[c], 6).alias(c) for c in rounded], F.array_join(tle.errors(), ";").alias("errors"))


_CSV = "concat_ws(',', CAST(CASE WHEN c_custkey % 50 = 49 THEN -c_custkey ELSE c_custkey END AS {s}), 'X' || CAST(c_custkey AS {s}), c_name, CASE WHEN c_custkey % 4 = 0 THEN 'DEB' ELSE 'PAY' END, CASE WHEN c_custkey % 3 = 0 THEN '+' ELSE 'D' END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'USA' END, '20' || lpad(CAST(10 + c_custkey % 15 AS {s}), 2, '0') || CASE WHEN c_custkey % 6 = 0 THEN '-13-40' ELSE '-02-03' END, CASE WHEN c_custkey % 20 = 7 THEN 'bad' ELSE CAST(400 + c_custkey AS {s}) END, '51.6')"


@query("a7_satcat_csv", """
SELECT c_custkey AS norad_id, 'X' || CAST(c_custkey AS VARCHAR) AS cospar_id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'DEB' ELSE 'PAY' END AS object_type, CASE WHEN c_custkey % 6 <> 0 THEN CAST('20' || CAST(10 + c_custkey % 15 AS VARCHAR) || '-02-03' AS DATE) END AS launch_date,
  CASE WHEN c_custkey % 5 = 0 THEN 'XX' ELSE 'US' END AS country_code, CASE WHEN c_custkey % 3 = 0 THEN 'operational' ELSE 'defunct' END AS status, CAST(400 + c_custkey AS DOUBLE) AS altitude_km, 51.6e0 AS inclination FROM customer WHERE c_custkey > 0 AND c_custkey % 50 <> 49 AND c_custkey % 20 <> 7""")
def a7(t):
    lines = t.customer.select(F.expr(_CSV.format(s="STRING")).alias("line"))
    return catalogues.satellites(catalogues.parse_csv(lines))


def _raw(t):
    i = F.col("c_custkey")
    pairs = {
        "NORAD_CAT_ID": F.when(i % 40 != 0, i.cast("string")).otherwise(""), "SATNAME": F.col("c_name"), "OBJECT_TYPE": F.when(i % 3 == 0, "DEBRIS").otherwise("ROCKET BODY"),
        "COUNTRY": F.when(i % 4 == 0, "N/A").otherwise("FR"), "APOGEE": F.concat(F.lit(" "), i.cast("string")), "UNKNOWN_COLUMN": F.lit("x"),
    }
    return t.customer.select(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("raw"))


_RECORD = """SELECT 'celestrak-' || CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 3 = 0 THEN 'DEBRIS' ELSE 'SATELLITE' END AS entity_class, c_name AS name,
  '{"altitude_km":"' || CAST(c_custkey AS VARCHAR) || '"' || CASE WHEN c_custkey % 4 <> 0 THEN ',"country_code":"FR"' ELSE '' END || ',"display_name":"' || c_name || '","norad_id":"' || CAST(c_custkey AS VARCHAR) || '","object_type":"' || CASE WHEN c_custkey % 3 = 0 THEN 'DEBRIS' ELSE 'ROCKET BODY' END || '"}' AS fields, CASE WHEN c_custkey % 3 = 0 THEN 'celestrak,debris' ELSE 'celestrak,rocket_body' END AS tags FROM customer WHERE c_custkey % 40 <> 0"""


@query("a8_registry_records", _RECORD)
def a8(t):
    out = catalogues.records(_raw(t), "raw", "celestrak")
    return out.select("source_id", "entity_class", "name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("fields"), F.array_join("tags", ",").alias("tags"))


@query("a9_satcat_json", "SELECT 'celestrak-' || CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE 'FR' END AS launched_by, CAST(c_custkey // 500 AS INTEGER) AS range FROM customer WHERE c_custkey % 40 <> 0")
def a9(t):
    text = _raw(t).select(F.to_json("raw").alias("line"))
    raw = text.select(F.from_json("line", "map<string,string>").alias("raw"))
    return catalogues.records(raw, "raw", "celestrak").select("source_id", "launched_by", F.floor(F.regexp_extract("source_id", "([0-9]+)$", 1).cast("int") / 500).cast("int").alias("range"))


@query("a10_cdm_json", "SELECT conjunction_id, tca, pc, primary_norad FROM conjunctions WHERE conjunction_id % 10 <> 0")
def a10(t):
    """Messages as JSON text, every tenth one damaged: what can't be read is dropped."""
    doc = F.to_json(F.struct(F.col("conjunction_id").alias("CDM_ID"), F.col("tca").alias("TCA"), F.col("pc").alias("PC"), F.col("primary_norad").alias("SAT_1_ID")))
    text = t.conjunctions.select(F.when(F.col("conjunction_id") % 10 == 0, F.lit('{"CDM_ID": "broken')).otherwise(doc).alias("line"))
    r = F.from_json("line", "CDM_ID long, TCA timestamp_ntz, PC double, SAT_1_ID long")
    return text.select(r.alias("r")).where("r.CDM_ID is not null").select(F.col("r.CDM_ID").alias("conjunction_id"), F.col("r.TCA").alias("tca"), F.col("r.PC").alias("pc"), F.col("r.SAT_1_ID").alias("primary_norad"))


@query("a12_seed_registry", "SELECT * FROM (VALUES ('un-sputnik-1', 'Sputnik 1', 'SU', 1957), ('un-vanguard-1', 'Vanguard 1', 'US', 1958)) v(source_id, name, country, year)")
def a12(t):
    rows, error = registry.run(t.spark, "un_registry", rows=[{"name": "Sputnik 1", "country": "SU", "year": 1957}, {"name": "Vanguard 1", "country": "US", "year": 1958}])
    assert error is None
    return rows


@query("a13_content_hash", f"SELECT source_id, sha256(entity_class || chr(31) || name || chr(31) || fields) AS hash FROM ({_RECORD})")
def a13(t):
    return catalogues.records(_raw(t), "raw", "celestrak").select("source_id", "hash")


@query("a14_range_source", "SELECT i AS norad_id, CAST((i - 1) // 400 AS INTEGER) AS range FROM range(1, 1501) r(i)")
def a14(t):
    registry.add_formats(t.spark)
    return t.spark.read.format("id_ranges").options(first=1, last=1500, size=400).load()


@query("a16_html_sections")
def a16(t):
    return documents.load_html(t.pages, "page_id", "html").select(F.col("key").alias("page_id"), F.size("sections").alias("n_sections"), "content", "hash")


@query("a17_latex_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || CAST(doc_id AS VARCHAR) ELSE '' END || lang || '  x_1  bold  end' AS text, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || CAST(doc_id AS VARCHAR) ELSE '' END AS headings FROM documents")
def a17(t):
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\section{Part "), "doc_id", F.lit("}"))).otherwise(""), "lang", F.lit(" $x_1$ \\textbf{bold} \\alpha end"))
    return t.documents.select("doc_id", documents.latex_text(raw).alias("text"), F.array_join(documents.latex_headings(raw), ",").alias("headings"))


@query("a18_documents_as_files", r"""
WITH k AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'docx' WHEN doc_id % 3 = 1 AND NOT regexp_matches(text, '[\\{}$]') THEN 'latex' ELSE 'html' END AS loader, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS words FROM documents)
SELECT doc_id, loader, sha256(CASE WHEN loader = 'html' AND length(trim(text)) <= 20 THEN '' ELSE words END) AS digest FROM k""")
def a18(t):
    """Every document written as DOCX, LaTeX or HTML, read back from a folder of files whose names don't tell which, and its words."""
    kind = F.when((F.col("doc_id") % 3 == 0) & ~F.col("text").rlike(loaders.REFUSED["docx"]), "docx").when((F.col("doc_id") % 3 == 1) & ~F.col("text").rlike(r"[\\{}$]"), "latex").otherwise("html")
    folder = shared_dir(t.spark, "files")
    written = materialize(loaders.export(t.documents, "doc_id", "text", kind, folder), "files-manifest")
    body = F.array_join(F.transform("sections", lambda s: s["body"]), " ")
    words = F.array_join(F.filter(F.split(body, r"\s+"), lambda w: w != ""), " ")
    got = loaders.load(loaders.read_files(written, "name", folder)).select(F.col("path").alias("name"), "loader", F.sha2(words, 256).alias("digest"))
    return written.join(got, "name").select(F.col("key").alias("doc_id"), "loader", "digest")


@query("a19_loader_routing", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'latex' WHEN 3 THEN 'docx' END AS loader FROM documents")
def a19(t):
    i = F.col("doc_id") % 5
    path = F.when(i == 0, "a.PDF").when(i == 1, "http://x/y").when(i == 2, "b.tex").when(i == 3, "c.docx").otherwise("d.bin")
    return t.documents.select("doc_id", documents.loader_for(path).alias("loader"))


@query("a20_html_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def a20(t):
    return t.pages.select("page_id", documents.html_text(F.col("html")).alias("text"))


@query("a21_last_reading", "SELECT event_type, arg_max(value, event_time) AS last_value, count(*) FILTER (value > 100) AS strong FROM orbital_events GROUP BY 1")
def a21(t):
    return t.orbital_events.groupBy("event_type").agg(F.max_by("value", "event_time").alias("last_value"), F.count_if(F.col("value") > 100).alias("strong"))


@query("a22_jsonl_records", """SELECT item_id, '{"id":' || CAST(item_id AS VARCHAR) || ',"domain":"benchmark","words":' || CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS VARCHAR) || '}' AS line FROM benchmark""")
def a22(t):
    from zenithal.functions.text import words

    return t.benchmark.select("item_id", F.to_json(F.struct(F.col("item_id").alias("id"), F.lit("benchmark").alias("domain"), F.size(words(F.col("text"))).alias("words"))).alias("line"))


@query("a23_journal_reads", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id >= 100 AND event_type IN ('error', 'signup') AND user_id < 100")
def a23(t):
    """Events in a journal of four commits, read with filters that the source takes over."""
    journal.add_journal(t.spark)
    path, rows = shared_dir(t.spark, "journal"), t.events.select("event_id", "user_id", "event_type", "value")
    for i in range(4):
        rows.where(F.pmod(F.floor(F.col("event_id") / 250), F.lit(4)) == i).write.format("journal").mode("append").save(path)
    return journal.read(t.spark, path, "event_id >= 100 and event_type in ('error', 'signup') and user_id < 100")


@query("p1_journal_stream", "SELECT event_id, event_type, value * 2 AS value FROM events WHERE value > 20")
def p1(t):
    """A journal streamed into another one, commit by commit."""
    journal.add_journal(t.spark)
    source, goal, marks = (shared_dir(t.spark, f"journal-{n}") for n in ("source", "goal", "marks"))
    t.events.select("event_id", "event_type", "value").repartition(4).write.format("journal").mode("append").save(source)
    rows = t.spark.readStream.format("journal").load(source).where("value > 20").select("event_id", "event_type", (F.col("value") * 2).alias("value"))
    rows.writeStream.format("journal").option("checkpointLocation", marks).trigger(availableNow=True).start(goal).awaitTermination()
    return t.spark.read.format("journal").load(goal)


@query("a24_geojson_track", """SELECT norad_id, '{"type":"LineString","coordinates":[' || string_agg('[' || CAST(event_id AS VARCHAR) || ',' || CAST(value AS VARCHAR) || ']', ',' ORDER BY event_time) || ']}' AS track FROM orbital_events GROUP BY 1""")
def a24(t):
    """A track is the points of one object in a window of time, in order."""
    points = F.array_sort(F.collect_list(F.struct("event_time", F.array(F.col("event_id").cast("string"), F.col("value").cast("string")).alias("p"))))
    inner = F.array_join(F.transform(points, lambda s: F.concat(F.lit("["), F.array_join(s["p"], ","), F.lit("]"))), ",")
    return t.orbital_events.groupBy("norad_id").agg(F.concat(F.lit('{"type":"LineString","coordinates":['), inner, F.lit("]}")).alias("track"))


@query("a25_name_refresh", "SELECT c.norad_id, CASE WHEN c.norad_id % 4 = 0 THEN 'NEW-' || CAST(c.norad_id AS VARCHAR) ELSE c.name END AS name, CASE WHEN c.norad_id % 4 = 0 THEN CASE c.norad_id % 3 WHEN 0 THEN 'payload' WHEN 1 THEN 'rocket_body' ELSE 'debris' END ELSE c.object_type END AS object_type FROM catalog c")
def a25(t):
    i = F.col("norad_id")
    new = t.catalog.where(i % 4 == 0).select("norad_id", F.concat(F.lit("NEW-"), "norad_id").alias("OBJECT_NAME"), F.when(i % 3 == 0, "PAY").when(i % 3 == 1, "R/B").otherwise("DEB").alias("t"))
    kind = F.when(F.col("t") == "PAY", "payload").when(F.col("t") == "R/B", "rocket_body").when(F.col("t") == "DEB", "debris")
    return t.catalog.join(new, "norad_id", "left").select("norad_id", F.coalesce("OBJECT_NAME", "name").alias("name"), F.coalesce(kind, "object_type").alias("object_type"))
