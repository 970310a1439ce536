"""Queries over strings (T) and the retrieval layer (R)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.functions import text as T
from zenithal.functions.stem import stem_sql
from zenithal.operators import fulltext, retrieval, trigrams
from zenithal.plans.registry import query
from zenithal.session import materialize

_W = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"
_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("t1_token_estimate", f"SELECT doc_id, CAST(floor(len({_W.format('text')}) / 0.75e0) AS BIGINT) AS tokens FROM documents")
def t1(t):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_H = retrieval.HEADING
_SPLIT = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_H}') AS h, regexp_split_to_array(text, '{_H}') AS b FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, h, b FROM d WHERE len(h) > 0),
c AS (SELECT doc_id, i, trim(h[i]) AS heading, regexp_replace(b[i + 1], '^\s+|\s+$', '', 'g') AS body FROM s),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section, heading, body FROM c WHERE len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) >= 10)
SELECT doc_id, CAST(section AS INTEGER) AS section, heading, body FROM k WHERE NOT regexp_matches(lower(heading), 'references|bibliography') UNION ALL SELECT doc_id, 0, 'Document', text FROM d WHERE len(h) = 0"""


@query("t2_section_split", _SPLIT)
def t2(t):
    return retrieval.sections(t.documents, "doc_id", "text").select(F.col("key").alias("doc_id"), "section", "heading", "body")


@query("t4_sentence_split", f"SELECT doc_id, len({_SENT.format('text')}) AS n, list_aggregate({_SENT.format('text')}, 'max') AS last FROM documents")
def t4(t):
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(s).alias("last"))


@query("t3_protected_sentences")
def t3(t):
    return t.documents.select("doc_id", F.size(T.protected_sentences(F.col("text"))).alias("n"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3)))))"


@query("t5_trigram_search", f"""
WITH s AS (SELECT p_partkey, p_name, len(list_intersect({_TRI.format('p_name')}, {_TRI.format("'red widgets'")})) / len(list_distinct(list_concat({_TRI.format('p_name')}, {_TRI.format("'red widgets'")}))) AS s FROM part)
SELECT p_partkey, p_name, round(s, 6) AS similarity FROM s WHERE s > 0.3""")
def t5(t):
    s = T.similarity(T.trigrams(F.col("p_name")), T.trigrams(F.lit("red widgets")))
    return t.part.select("p_partkey", "p_name", s.alias("s")).where("s > 0.3").select("p_partkey", "p_name", F.round("s", 6).alias("similarity"))


def _alike(table: str, key: str, name: str) -> str:
    return f"n AS (SELECT {name} AS name, count(*) AS members, {_TRI.format(name)} AS g FROM {table} GROUP BY 1), q AS (SELECT DISTINCT {name} AS query, {_TRI.format(name)} AS h FROM {table} WHERE {key} % 100 = 0), s AS (SELECT query, name, members, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS s FROM n, q)"


@query("t5_trigram_join", f"WITH {_alike('part', 'p_partkey', 'p_name')} SELECT query, name, members, round(s, 6) AS similarity FROM s WHERE s >= 0.3")
def t5_join(t):
    """The names of all parts whose id is divisible by 100 against the names of all parts, by the index; and how many parts have each."""
    index = trigrams.build(t.part, "p_name", 0.3)
    found = trigrams.search(index, t.part.where("p_partkey % 100 = 0").select(F.col("p_name").alias("query")))
    sizes = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return found.join(sizes, "name").select("query", "name", "members", F.round("similarity", 6).alias("similarity"))


@query("t5_fuzzy_names", f"WITH {_alike('customer', 'c_custkey', 'c_name')} SELECT query, name, round(s, 6) AS similarity FROM s WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, name) <= 20")
def t5_fuzzy(t):
    """The 20 most similar names for the customers whose id is divisible by 100; half of their trigrams are in all names."""
    index = trigrams.build(t.customer, "c_name", 0.8)
    found = trigrams.best_matches(index, t.customer.where("c_custkey % 100 = 0").select(F.col("c_name").alias("query")))
    return found.select("query", "name", F.round("similarity", 6).alias("similarity"))


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_FULL = f"""
WITH stop(word) AS (SELECT unnest([{", ".join(repr(w) for w in fulltext.STOP)}])), d AS (SELECT doc_id AS key, {_TOK.format('text')} AS w FROM documents), p AS (SELECT key, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
o AS (SELECT item_id AS query, {_TOK.format('text')} AS w FROM benchmark), q0 AS (SELECT query * 2 AS query, unnest(w[1:3]) AS word FROM o UNION ALL SELECT query * 2 + 1, w[4] FROM o),
q1 AS (SELECT DISTINCT query, word FROM q0 WHERE word IS NOT NULL AND word NOT IN (SELECT word FROM stop)), lex AS MATERIALIZED ({stem_sql("SELECT DISTINCT word FROM p WHERE word NOT IN (SELECT word FROM stop) UNION SELECT word FROM q1")}),
q AS (SELECT DISTINCT query, stem FROM q1 JOIN lex USING (word)), n AS (SELECT query, count(*) AS terms FROM q GROUP BY 1), h AS (SELECT DISTINCT q.query, key, stem, pos FROM p JOIN lex USING (word) JOIN q USING (stem)),
m AS (SELECT query, key, terms FROM h JOIN n USING (query) GROUP BY ALL HAVING count(DISTINCT stem) = terms), g AS (SELECT h.*, terms FROM h JOIN m USING (query, key)),
a AS (SELECT query, key, 0.1e0 * list_sum(list_transform(range(1, count(*) + 1), lambda i: 1 / (i * i))) / 1.64493406685e0 AS score FROM g WHERE terms = 1 GROUP BY 1, 2),
b AS (SELECT x.query, x.key, abs(x.pos - y.pos) AS d, count(*) AS n FROM g x JOIN g y ON x.query = y.query AND x.key = y.key AND x.stem < y.stem AND abs(x.pos - y.pos) BETWEEN 1 AND 100 GROUP BY ALL),
c AS (SELECT query, key, 1 - exp(CAST(sum(CAST(n * ln(1 - 0.1e0 * sqrt(1 / (1.005e0 + 0.05e0 * exp(d / 1.5e0 - 2)))) AS DECIMAL(30, 15))) AS DOUBLE)) AS score FROM b GROUP BY 1, 2),
r AS (SELECT query, key, score FROM a UNION ALL SELECT query, key, coalesce(score, 1e-20) FROM m LEFT JOIN c USING (query, key) WHERE terms > 1)
SELECT query, key AS doc_id, round(score, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS k FROM r) WHERE k <= 20"""


@query("t6_full_text", _FULL)
def t6(t):
    """An index of all documents; of each benchmark item the first three words together, and the fourth alone, are queries."""
    words = t.benchmark.select("item_id", fulltext.tokens(F.col("text")).alias("w"))
    asked = words.select((F.col("item_id") * 2).alias("query"), F.array_join(F.slice("w", 1, 3), " ").alias("text")).unionByName(words.select((F.col("item_id") * 2 + 1).alias("query"), F.get("w", F.lit(3)).alias("text")))
    found = fulltext.search(fulltext.build(t.documents, "doc_id", "text"), asked)
    return found.select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("rank"))


_BM = f"""
WITH d AS (SELECT doc_id, {_W.format('lower(text)')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
f AS (SELECT doc_id, len(w) AS l, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN ('orbit', 'the', 'und', 'les') GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
q(query, term) AS (VALUES (1, 'the'), (1, 'orbit'), (2, 'und'), (2, 'les')),
r AS (SELECT q.query, f.doc_id, CAST(sum(CAST(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / m)) AS DECIMAL(30, 12))) AS DOUBLE) AS score FROM f JOIN g USING (term) JOIN q USING (term), s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM r) SELECT CAST(query AS INTEGER) AS query, doc_id, round(score, 6) AS score FROM k WHERE k <= 20"""


@query("t7_ranked_text_search", _BM)
def t7(t):
    queries = t.spark.createDataFrame([(1, "the"), (1, "orbit"), (2, "und"), (2, "les")], "query int, term string")
    return retrieval.bm25(t.documents, queries, "doc_id", "text", 20).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _expanded(text: str) -> str:
    for k, v in T.ACRONYMS.items():
        text = f"regexp_replace({text}, '\\b{k}\\b', '{k} ({v})')"  # the first one only
    return text


_TALK = "text || ' LEO and LEO, Pc by SGP4 for ' || lang || ' TCA'"


@query("t8_acronym_expansion", f"SELECT doc_id, {_expanded(_TALK)} AS text FROM documents")
def t8(t):
    """Whole texts, with a remark behind each that has acronyms."""
    return t.documents.select("doc_id", T.expand_acronyms(F.concat("text", F.lit(" LEO and LEO, Pc by SGP4 for "), "lang", F.lit(" TCA"))).alias("text"))


_SEEN = "text || ' NASA saw Starlink-' || CAST(doc_id AS VARCHAR) || ' near ISS at 550 km LEO after Falcon 9 and Apollo 11, says SpaceX. NASA.'"


def _entities(kind: str) -> str:
    pattern, most = T.ENTITIES[kind]
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({_SEEN}, '{pattern}')))[1:{most}], ',')"


def _seen():
    return F.concat("text", F.lit(" NASA saw Starlink-"), "doc_id", F.lit(" near ISS at 550 km LEO after Falcon 9 and Apollo 11, says SpaceX. NASA."))


@query("t9_entities", "SELECT doc_id, " + ", ".join(f"{_entities(k)} AS {k}" for k in T.ENTITIES) + " FROM documents")
def t9(t):
    """Whole texts, with a remark behind each that names some entities."""
    return t.documents.select("doc_id", *[F.array_join(T.entities(_seen(), k), ",").alias(k) for k in T.ENTITIES])


@query("t10_topic_tags", "WITH d AS (SELECT doc_id, lower(text) AS x FROM documents) SELECT doc_id, concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{k}')" for k in keys if k == k.lower()) + f" THEN '{n}' END" for n, keys in T.TOPICS.items()) + ") AS topics FROM d")
def t10(t):
    return t.documents.select("doc_id", F.array_join(T.topics(F.col("text")), ",").alias("topics"))


def _first(text: str, rules: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '" + "|".join(f"(?:{T.either_case(p)})" for p in ps) + f"') THEN '{n}'" for n, ps in rules.items()) + f" ELSE '{otherwise}' END"


_BY = "CASE doc_id % 9 WHEN 0 THEN 'by nasa flight report ' WHEN 1 THEN 'of the European Space Agency technical  memorandum ' WHEN 2 THEN 'VSSC lab ISO 27852 ' WHEN 3 THEN 'Japan Aerospace letter ' WHEN 4 THEN 'CNSA ' ELSE '' END || text"


@query("t11_agency_and_kind", f"SELECT doc_id, {_first(f'substr({_BY}, 1, 2000)', T.AGENCIES, 'OTHER')} AS agency, {_first(f'substr({_BY}, 1, 3000)', T.KINDS, 'unknown')} AS kind FROM documents WHERE text IS NOT NULL")
def t11(t):
    """Whole documents, some with a head that names an agency and a kind."""
    heads = F.array(*[F.lit(x) for x in ("by nasa flight report ", "of the European Space Agency technical  memorandum ", "VSSC lab ISO 27852 ", "Japan Aerospace letter ", "CNSA ", "", "", "", "")])
    text = F.concat(F.element_at(heads, (F.col("doc_id") % 9 + 1).cast("int")), "text")
    return t.documents.where("text is not null").select("doc_id", T.agency(text).alias("agency"), T.document_kind(text).alias("kind"))


#: Words of intents, in order.
INTENTS = {
    "collision_risk": ["collision", "conjunction", "pc", "cdm", "risk"], "debris_analysis": ["debris", "fragment", "breakup", "kessler"], "orbital_decay": ["decay", "reentry", "re-entry", "deorbit"],
    "maneuver_planning": ["maneuver", "delta-v", "burn", "avoid"], "space_weather": ["weather", "storm", "kp", "f10.7", "solar"], "satellite_profile": ["operator", "isro", "nasa", "esa", "spacex"],
    "research_question": ["explain", "summarize", "what is", "describe", "mission", "artemis", "chandrayaan", "launch"],
}


@query("t12_intent", "WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations) SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in INTENTS.items()) + " ELSE 'general_ssa' END AS intent FROM c")
def t12(t):
    q, out = F.lower("text"), F.lit("general_ssa")
    for name, keys in reversed(INTENTS.items()):
        hit = F.lit(False)
        for k in keys:
            hit = hit | q.contains(k)
        out = F.when(hit, name).otherwise(out)
    return t.conversations.select("conv_id", "turn", out.alias("intent"))


@query("t13_relationship_type", "SELECT src, dst, CASE WHEN type IN ('OPERATED_BY', 'LOCATED_IN', 'SUBSIDIARY_OF') THEN type END AS type FROM edges")
def t13(t):
    """The types of all edges as a text may say them; those that are not known give null."""
    raw = F.concat(F.lit(" "), F.initcap(F.replace("type", F.lit("_"), F.lit("  "))), F.lit(" "))
    return t.edges.select("src", "dst", T.relationship_type(raw, ["OPERATED_BY", "LOCATED_IN", "SUBSIDIARY_OF"]).alias("type"))


@query("t14_citations", """
SELECT p_partkey, '[1] A; B; C' || CASE WHEN p_partkey % 2 = 0 THEN ' et al.' ELSE '' END || ', "' || p_name || '," ' || p_brand || ', ' || CASE WHEN p_partkey % 5 = 0 THEN 'n.d.' ELSE CAST(1990 + p_size AS VARCHAR) END || '.' || CASE WHEN p_partkey % 3 = 0 THEN ' DOI: 10.1/x.' ELSE ' http://u.' END AS ieee,
  'A, B, C' || CASE WHEN p_partkey % 2 = 0 THEN ', et al.' ELSE '' END || ' (' || CASE WHEN p_partkey % 5 = 0 THEN 'n.d.' ELSE CAST(1990 + p_size AS VARCHAR) END || '). *' || p_name || '*. ' || p_brand || '.' || CASE WHEN p_partkey % 3 = 0 THEN ' https://doi.org/10.1/x' ELSE '' END AS apa FROM part""")
def t14(t):
    i = F.col("p_partkey")
    authors = F.when(i % 2 == 0, F.array(*[F.lit(x) for x in "ABCD"])).otherwise(F.array(*[F.lit(x) for x in "ABC"]))
    year, doi, none = F.when(i % 5 != 0, 1990 + F.col("p_size")), F.when(i % 3 == 0, "10.1/x"), F.lit(None).cast("string")
    return t.part.select("p_partkey", T.ieee(F.lit("[1]"), authors, F.col("p_name"), F.col("p_brand"), year, none, doi, F.lit("http://u")).alias("ieee"), T.apa(authors, F.col("p_name"), F.col("p_brand"), year, doi).alias("apa"))


@query("t15_context_budget", f"""
WITH c AS (SELECT agency, chunk_id, publication_year, text, row_number() OVER (PARTITION BY agency ORDER BY chunk_id) AS i, sum(CAST(floor(len({_W.format('text')}) / 0.75e0) AS BIGINT)) OVER (PARTITION BY agency ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS s FROM chunks)
SELECT agency, count(*) AS n_sources, sha256(string_agg('SOURCE ' || CAST(chunk_id AS VARCHAR) || ' | ' || CAST(publication_year AS VARCHAR) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_id)) AS digest FROM c WHERE 32000 - s >= 2000 GROUP BY 1""")
def t15(t):
    header = F.concat(F.lit("SOURCE "), "chunk_id", F.lit(" | "), "publication_year")
    return retrieval.context(t.chunks, "agency", "chunk_id", header, "text").select("agency", "n_sources", F.sha2("context", 256).alias("digest"))


@query("t16_templated_answers", "SELECT norad_id, 'What are the orbital characteristics of the satellite ' || name || '?' AS instruction, name || ' (NORAD ' || CAST(norad_id AS VARCHAR) || ') is registered in ' || country || '.' AS output FROM catalog")
def t16(t):
    return t.catalog.select("norad_id", F.format_string("What are the orbital characteristics of the satellite %s?", "name").alias("instruction"), F.format_string("%s (NORAD %d) is registered in %s.", "name", "norad_id", "country").alias("output"))


@query("t17_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def t17(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("t18_tag_union", "SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'x', lang])), ',') AS tags FROM documents")
def t18(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_union(F.array("lang", "source"), F.array(F.lit("x"), F.col("lang")))), ",").alias("tags"))


@query("r1_section_chunks")
def r1(t):
    """Section by section: abstracts and conclusions whole, tables and formulas with their context, sentences packed."""
    return retrieval.section_chunks(t.documents, "doc_id", retrieval.section_array(F.col("text"))).select(F.col("key").alias("doc_id"), "chunk", "heading", "kind", F.sha2("body", 256).alias("digest"))


@query("r2_word_windows", rf"""
WITH d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 700)) AS a FROM d), c AS (SELECT doc_id, CAST(a // 700 AS INTEGER) AS chunk, array_to_string(w[a + 1 : a + 800], ' ') AS body FROM s)
SELECT doc_id, chunk, sha256(body) AS digest FROM c WHERE length(body) > 50""")
def r2(t):
    return retrieval.word_windows(t.documents, "doc_id", "text").select(F.col("key").alias("doc_id"), "chunk", F.sha2("body", 256).alias("digest"))


_TAGS = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys if k == k.lower()) + f" THEN '{n}' END" for n, keys in T.TOPICS.items())


@query("r3_enrichment", f"SELECT doc_id, {_entities('satellites')} AS satellites, {_entities('numbers')} AS numbers, array_to_string(list_sort(list_distinct(list_filter([{_TAGS}, lang, source], lambda x: x IS NOT NULL))), ',') AS tags FROM documents")
def r3(t):
    """Entities of each whole text, and its topics joined with the tags it has already."""
    tags = F.array_sort(F.array_union(T.topics(F.col("text")), F.array_compact(F.array("lang", "source"))))
    return t.documents.select("doc_id", *[F.array_join(T.entities(_seen(), k), ",").alias(k) for k in ("satellites", "numbers")], F.array_join(tags, ",").alias("tags"))


@query("r4_sparse_weights", f"""
WITH n AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_W.format('lower(text)')}) AS term FROM benchmark) GROUP BY ALL) SELECT item_id, term, round(n / max(n) OVER (PARTITION BY item_id), 9) AS weight FROM n""")
def r4(t):
    return retrieval.term_weights(t.benchmark, "item_id", "text").select(F.col("key").alias("item_id"), "term", F.round("weight", 9).alias("weight"))


_COS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query, e AS f FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id AS key, list_inner_product(e, f) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(f, f)) AS score FROM v, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) - 1 AS rank FROM s {where})"""


def _queries(t):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query("r5_dense_search", _COS.format(where="WHERE score >= 0.3") + " SELECT query, key AS vec_id, round(score, 6) AS score FROM k WHERE rank < 20")
def r5(t):
    """Queries are the vectors whose id is divisible by 100, against all."""
    found = retrieval.dense_search(t.embeddings, _queries(t), "vec_id", "embedding", 20, least=0.3)
    return found.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


_SPARSE = f"""
WITH n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_W.format('lower(text)')}) AS term FROM documents) GROUP BY ALL), w AS (SELECT doc_id, term, n / max(n) OVER (PARTITION BY doc_id) AS weight FROM n),
s AS (SELECT q.doc_id AS query, d.doc_id AS key, CAST(sum(CAST(d.weight * q.weight AS DECIMAL(30, 12))) AS DOUBLE) AS score FROM w d JOIN w q USING (term) WHERE q.doc_id % 100 = 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) - 1 AS rank FROM s)"""


@query("r6_sparse_search", _SPARSE + " SELECT query, key AS doc_id, round(score, 6) AS score FROM k WHERE rank < 20")
def r6(t):
    queries = retrieval.term_weights(t.documents.where("doc_id % 100 = 0"), "doc_id", "text").select(F.col("key").alias("query"), "term", "weight")
    queries = materialize(queries, "sparse-queries")
    return retrieval.sparse_search(t.documents, "doc_id", "text", queries, 20).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _ranked(t, order):
    """Two top lists of 50 for each language, as a dense and a sparse search would give them."""
    # A plain limit on row_number is applied in each task before the shuffle.
    w = W.partitionBy("lang").orderBy(*order)
    best = t.documents.select(F.col("lang").alias("query"), F.col("doc_id").alias("key"), F.row_number().over(w).alias("k")).where("k <= 50")
    return best.select("query", "key", (F.col("k") - 1).alias("rank"))


@query("r7_rank_fusion", """
WITH a AS (SELECT lang AS query, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 50), b AS (SELECT lang AS query, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97, doc_id) - 1 AS r FROM documents QUALIFY r < 50),
f AS (SELECT query, key, 0.7e0 * coalesce(1 / (61e0 + a.r), 0) + (1 - 0.7e0) * coalesce(1 / (61e0 + b.r), 0) AS score FROM a FULL JOIN b USING (query, key)), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS k FROM f) SELECT query, key, round(score, 9) AS score FROM k WHERE k <= 20""")
def r7(t):
    fused = retrieval.fuse(_ranked(t, [F.desc("n_chars"), "doc_id"]), _ranked(t, [F.col("n_chars") % 97, F.col("doc_id")]))
    return fused.select("query", "key", F.round("score", 9).alias("score"))


@query("r8_dense_top_k", _COS.format(where="") + " SELECT query, key AS vec_id, rank FROM k WHERE rank < 8")
def r8(t):
    found = retrieval.dense_search(t.embeddings, _queries(t), "vec_id", "embedding", 8)
    return found.select("query", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query("r9_graph_vector_search", _COS.format(where="WHERE score > 0.75") + ", h AS (SELECT query, key FROM k WHERE rank < 8) SELECT h.query, h.key AS vec_id, e.dst, e.type FROM h JOIN edges e ON e.src = 'sat-' || CAST(h.key AS VARCHAR)")
def r9(t):
    """Near vectors, and the neighbours of their nodes."""
    found = retrieval.dense_search(t.embeddings, _queries(t), "vec_id", "embedding", 8, least=0.75).select("query", F.col("key").alias("vec_id"), F.concat(F.lit("sat-"), "key").alias("src"))
    return t.edges.join(found, "src").select("query", "vec_id", "dst", "type")


def _candidates(t):
    ranked = _ranked(t, [F.desc("n_chars"), F.col("doc_id")])
    c = t.chunks.select(F.col("chunk_id").alias("key"), "doc", F.col("section_title").alias("section"), "agency", F.col("publication_year").alias("year"), "text")
    return ranked.join(c, "key").withColumn("score", 1.0 / (F.col("rank") + 1))


@query("r10_rerank_fallback", "SELECT lang AS query, doc_id AS key FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 10")
def r10(t):
    """Without a model the first rows of the list stay: the contract of the reranker."""
    return _ranked(t, [F.desc("n_chars"), F.col("doc_id")]).where("rank < 10").select("query", "key")


@query("r11_diverse_selection")
def r11(t):
    return retrieval.diverse(_candidates(t))


@query("r12_compression")
def r12(t):
    return retrieval.compress(t.chunks.select("chunk_id", "text"), "text", F.lit("the orbit of und les satellites"))


@query("r13_retrieval_pipeline")
def r13(t):
    """Expansion, sparse search, diversity and compression, one after the other, for every benchmark item as a query."""
    items = t.benchmark.select("item_id", T.expand_acronyms(F.col("text")).alias("text"))
    queries = retrieval.term_weights(items, "item_id", "text").select(F.col("key").alias("query"), "term", "weight")
    queries = materialize(queries, "sparse-queries")
    found = materialize(retrieval.sparse_search(t.chunks, "chunk_id", "text", queries, 20), "pipeline-found")
    c = t.chunks.select(F.col("chunk_id").alias("key"), "doc", F.col("section_title").alias("section"), "agency", F.col("publication_year").alias("year"), "text")
    # Texts meet the lists once; only what is in a list goes on.
    listed = materialize(c.join(retrieval.bounded(found, 1_000_000), "key"), "pipeline-listed")
    out = retrieval.diverse(listed.drop("rank")).join(listed.select("query", "key", "text"), ["query", "key"]).join(items.withColumnRenamed("text", "q"), F.col("query") == F.col("item_id"))
    return retrieval.compress(out.select("query", "key", "place", "text", "q"), "text", F.col("q")).drop("q")


_A, _Q = "(SELECT text FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1)", "c.text"


def _turns(t):
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("q"), nxt.alias("a")).where("a is not null")


_TURNS = "WITH x AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), y AS (SELECT * FROM x WHERE a IS NOT NULL)"


@query("r14_keyword_overlap", f"{_TURNS} SELECT conv_id, turn, round(CASE WHEN len({_SET.format('q')}) = 0 THEN 1 ELSE len(list_intersect({_SET.format('q')}, {_SET.format('a')})) / len({_SET.format('q')}) END, 6) AS relevancy FROM y")
def r14(t):
    return _turns(t).select("conv_id", "turn", F.round(T.overlap(F.col("q"), F.col("a")), 6).alias("relevancy"))


@query("r15_entity_recall", "SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) + CAST(contains(lower(text), lower(lang)) AS INTEGER)) / 3e0, 6) AS recall FROM documents")
def r15(t):
    keys = F.array(F.lit("the"), F.lit("und"), F.col("lang"))
    found = F.filter(keys, lambda k: F.contains(F.lower("text"), F.lower(k)))
    return t.documents.select("doc_id", F.round(F.size(found) / F.size(keys), 6).alias("recall"))


_NUM = "list_distinct(list_transform(regexp_extract_all({0}, '([0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1), lambda x: CAST(x AS DOUBLE)))"


@query("r16_numeric_accuracy", f"""
WITH p AS (SELECT p_partkey, 'a ' || CAST(p_size AS VARCHAR) || ' b ' || CAST(p_retailprice AS VARCHAR) || ' c 0' AS g, 'x ' || CAST(p_size + p_partkey % 3 AS VARCHAR) || ' y ' || CAST(p_retailprice * 1.05e0 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN ' z 0.0' ELSE '' END AS a FROM part)
SELECT p_partkey, round(len(list_filter({_NUM.format('g')}, lambda v: len(list_filter({_NUM.format('a')}, lambda w: CASE WHEN v = 0 THEN w = 0 ELSE abs(w - v) <= 0.1 * abs(v) END)) > 0)) / len({_NUM.format('g')}), 6) AS accuracy FROM p""")
def r16(t):
    truth = F.concat(F.lit("a "), "p_size", F.lit(" b "), "p_retailprice", F.lit(" c 0"))
    answer = F.concat(F.lit("x "), F.col("p_size") + F.col("p_partkey") % 3, F.lit(" y "), F.col("p_retailprice") * 1.05, F.when(F.col("p_partkey") % 2 == 0, " z 0.0").otherwise(""))
    return t.part.select("p_partkey", F.round(T.numeric_accuracy(truth, answer), 6).alias("accuracy"))


@query("r17_citation_accuracy")
def r17(t):
    """Sentences that cite [n], each against the text of source n: a citation holds if it shares over 15 % of the words.

    Every conversation's answers cite the benchmark items by their place in a list."""
    n = t.benchmark.select((F.col("item_id") % 7).alias("n"), "text").groupBy("n").agg(F.min("text").alias("source"))
    sents = _turns(t).select("conv_id", "turn", F.explode(T.sentences(F.concat("a", F.lit(" See [3]. Also [5]!")))).alias("s"))
    cites = sents.select("conv_id", "turn", "s", F.explode(F.regexp_extract_all("s", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("n")).withColumn("n", F.col("n").cast("long"))
    held = cites.join(F.broadcast(n), "n").withColumn("ok", T.overlap(F.col("s"), F.col("source")) > 0.15)
    rates = held.groupBy("conv_id", "turn").agg(F.avg(F.col("ok").cast("int")).alias("rate"))
    return _turns(t).select("conv_id", "turn").join(rates, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("rate", F.lit(1.0)).alias("accuracy"))


@query("r18_faithfulness_fallback", f"{_TURNS} SELECT conv_id, turn, 1e0 AS faithfulness FROM y")
def r18(t):
    """Without an entailment model every answer counts as supported: the contract's fallback."""
    return _turns(t).select("conv_id", "turn", F.lit(1.0).alias("faithfulness"))


@query("r19_numeric_verification", """
WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_size + p_partkey % 4 AS DOUBLE) AS a, CAST(p_size * 2 AS DOUBLE) AS b FROM part) SELECT p_partkey, x AS claim, CASE WHEN abs(a - x) <= abs(b - x) THEN a ELSE b END AS closest FROM v WHERE abs(CASE WHEN abs(a - x) <= abs(b - x) THEN a ELSE b END - x) > 0.1 * abs(CASE WHEN abs(a - x) <= abs(b - x) THEN a ELSE b END)""")
def r19(t):
    """Claims (value, unit) against the nearest source value of the same unit: those off by over 10 % are suspicious."""
    pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(km/s|km|m/s|kg|kN|yr|days?|%|s\b)")
    i = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.concat(F.lit("It flew "), "p_size", F.lit(" km")).alias("answer"), F.concat(F.lit("at "), F.col("p_size") + i % 4, F.lit(" KM or "), F.col("p_size") * 2, F.lit(" km, "), F.col("p_size"), F.lit(" kg")).alias("source"))
    pull = lambda c: F.zip_with(F.regexp_extract_all(F.lower(c), pattern, F.lit(1)), F.regexp_extract_all(F.lower(c), pattern, F.lit(2)), lambda v, u: F.struct(v.cast("double").alias("value"), u.alias("unit")))
    claims = rows.select("p_partkey", F.explode(pull("answer")).alias("c"), pull("source").alias("s"))
    same = F.filter("s", lambda x: x["unit"] == F.col("c.unit"))
    nearest = F.array_min(F.transform(same, lambda x: F.struct(F.abs(x["value"] - F.col("c.value")).alias("gap"), x["value"].alias("value"))))["value"]
    found = claims.select("p_partkey", F.col("c.value").alias("claim"), nearest.alias("closest"))
    return found.where((F.col("closest") != 0) & (F.abs(F.col("closest") - F.col("claim")) > 0.1 * F.abs("closest")))


@query("r20_uncertainty_flags", f"""WITH s AS (SELECT conv_id, turn, unnest({_SENT.format("text || ' It may be so. Certain. [UNCERTAIN] x!'")}) AS s FROM conversations) SELECT conv_id, turn, count(DISTINCT s) AS flags FROM s WHERE regexp_matches(s, '(?i)approximately|roughly|about|around|may be|might be|could be|possibly|typically|generally|usually|often|it is believed|it has been suggested|further analysis is needed|insufficient data') OR contains(s, '[UNCERTAIN]') GROUP BY 1, 2""")
def r20(t):
    return t.conversations.select("conv_id", "turn", F.size(T.hedged(F.concat("text", F.lit(" It may be so. Certain. [UNCERTAIN] x!")))).cast("long").alias("flags")).where("flags > 0")


@query("r21_answer_confidence", "SELECT mission_id, round(0.3e0 * least(1, (mission_id % 100) / 100e0 * 2) + 0.5e0 * (satellite_count / 50e0) + 0.2e0 * greatest(0, 1 - (mission_id % 9) * 0.15e0), 3) AS confidence FROM missions")
def r21(t):
    i = F.col("mission_id")
    c = 0.3 * F.least(F.lit(1.0), i % 100 / 100.0 * 2) + 0.5 * (F.col("satellite_count") / 50.0) + 0.2 * F.greatest(F.lit(0.0), 1 - i % 9 * 0.15)
    return t.missions.select("mission_id", F.round(c, 3).alias("confidence"))


@query("r22_bridge_confidence", "SELECT mission_id, round(0.4e0 * CASE WHEN mission_id % 2 = 0 THEN 0.9e0 ELSE 0.3e0 END + 0.2e0 * CASE WHEN mission_id % 3 = 0 THEN 0.8e0 ELSE 0.4e0 END + 0.4e0 * least(1, (mission_id % 7) * 0.1e0 + (mission_id % 5) * 0.05e0), 3) AS confidence FROM missions")
def r22(t):
    i = F.col("mission_id")
    c = 0.4 * F.when(i % 2 == 0, 0.9).otherwise(0.3) + 0.2 * F.when(i % 3 == 0, 0.8).otherwise(0.4) + 0.4 * F.least(F.lit(1.0), i % 7 * 0.1 + i % 5 * 0.05)
    return t.missions.select("mission_id", F.round(c, 3).alias("confidence"))


@query("r23_graph_context", """
WITH o AS (SELECT 1 AS part, dst AS name, count(*) AS n FROM edges WHERE type = 'OPERATED_BY' GROUP BY 2 ORDER BY n DESC, name LIMIT 3), c AS (SELECT 2 AS part, CAST(conjunction_id AS VARCHAR) AS name, primary_norad AS n FROM conjunctions ORDER BY pc DESC, conjunction_id LIMIT 5), r AS (SELECT 3 AS part, country AS name, count(*) AS n FROM catalog GROUP BY 2 ORDER BY n DESC, name LIMIT 4)
SELECT CAST(part AS INTEGER) AS part, name, n FROM (SELECT * FROM o UNION ALL SELECT * FROM c UNION ALL SELECT * FROM r)""")
def r23(t):
    """The best of each section (3, 5, 4): what a prompt shows of the graph."""
    lit = lambda i: F.lit(i).alias("part")
    n = F.count(F.lit(1)).alias("n")
    orgs = t.edges.where("type = 'OPERATED_BY'").groupBy(F.col("dst").alias("name")).agg(n).orderBy(F.desc("n"), "name").limit(3)
    risks = t.conjunctions.orderBy(F.desc("pc"), "conjunction_id").limit(5).select(F.col("conjunction_id").cast("string").alias("name"), F.col("primary_norad").alias("n"))
    lands = t.catalog.groupBy(F.col("country").alias("name")).agg(n).orderBy(F.desc("n"), "name").limit(4)
    return orgs.select(lit(1), "name", "n").unionByName(risks.select(lit(2), "name", "n")).unionByName(lands.select(lit(3), "name", "n"))


@query("r24_document_ingest")
def r24(t):
    """Load, detect, chunk, filter, enrich: pages as HTML to chunks with their entities."""
    from zenithal.operators.filters import good_chunk
    from zenithal.sources.documents import load_html

    docs = load_html(t.pages, "page_id", "html")
    chunks = retrieval.section_chunks(docs, "key", F.col("sections"))
    kept = chunks.where(good_chunk(F.col("body"), T.token_estimate(F.col("body"))))
    return kept.select(F.col("key").alias("page_id"), "chunk", T.agency(F.col("body")).alias("agency"), F.array_join(T.topics(F.col("body")), ",").alias("topics"), F.sha2("body", 256).alias("digest"))


@query("r25_task_score", f"{_TURNS}, m AS (SELECT conv_id, turn, CASE WHEN len({_SET.format('q')}) = 0 THEN 1 ELSE len(list_intersect({_SET.format('q')}, {_SET.format('a')})) / len({_SET.format('q')}) END AS r, CASE WHEN contains(lower(a), 'the') THEN 1 ELSE 0 END AS e FROM y) SELECT conv_id, turn, round(0.35e0 * e + 0.25e0 + 0.2e0 * r + 0.2e0 * r, 6) AS score FROM m")
def r25(t):
    r = T.overlap(F.col("q"), F.col("a"))
    return _turns(t).select("conv_id", "turn", F.round(0.35 * F.when(F.lower("a").contains("the"), 1).otherwise(0) + 0.25 + 0.2 * r + 0.2 * r, 6).alias("score"))


@query("r26_training_set", """
WITH s AS (SELECT norad_id AS id, 'Describe ' || name || '.' AS instruction FROM catalog), a AS (SELECT id, v, CASE v WHEN 0 THEN instruction WHEN 1 THEN 'Please: ' || instruction ELSE instruction || ' Be brief.' END AS instruction FROM s, range(0, 3) r(v))
SELECT id, CAST(v AS INTEGER) AS variant, instruction, CASE WHEN (id * 7919 + v) % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM a""")
def r26(t):
    """Records from templates, their variants, and a split by a rule on the id: the same in every run, without a shuffle."""
    base = t.catalog.select(F.col("norad_id").alias("id"), F.format_string("Describe %s.", "name").alias("instruction"))
    v = base.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    text = F.when(F.col("variant") == 0, F.col("instruction")).when(F.col("variant") == 1, F.concat(F.lit("Please: "), "instruction")).otherwise(F.concat("instruction", F.lit(" Be brief.")))
    return v.select("id", "variant", text.alias("instruction"), F.when((F.col("id") * 7919 + F.col("variant")) % 10 == 0, "validation").otherwise("train").alias("split"))


@query("r27_embedding_backfill", "SELECT norad_id, concat_ws(' ', name, mission_type, object_type) AS text, CAST(norad_id // 100 AS BIGINT) AS batch FROM catalog WHERE tle_line1 IS NULL AND name IS NOT NULL")
def r27(t):
    """The rows that still need a vector, their text, and the batch that they would be encoded in."""
    return t.catalog.where("tle_line1 is null and name is not null").select("norad_id", F.concat_ws(" ", "name", "mission_type", "object_type").alias("text"), F.floor(F.col("norad_id") / 100).alias("batch"))
