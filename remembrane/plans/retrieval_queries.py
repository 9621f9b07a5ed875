"""Retrieval over documents and vectors."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import CONTROL, INJECTION_FORMS, NEUTRALIZED, chunk_documents, identifiers, mask_pii, neutralize, normalize_placeholders, pii_counts
from ..functions.values import cosine, recency_bonus, token_estimate
from ..functions.ontology import Catalog, parse_pack
from ..functions.stems import ENGLISH_KEPT, ENGLISH_STOP, ENGLISH_WHOLE, STEP_2, STEP_3, STEP_4
from ..operators import context, extract, fulltext, retrieval, vector_index
from ..sources.tables import observations, read
from ..storage import new_path
from .registry import query

WORDS = ("the", "tion", "with", "das", "que")
NOW = "2024-01-31 00:00:00"


def query_vector(spark, d):
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def word_counts(spark, d):
    """From the postings of plain words, which the session's first call writes."""
    index = fulltext.indexed(read(spark, d, "documents"), "doc_id", "text", reader="words")
    return fulltext.counted(index, WORDS).select(F.col("id").alias("doc_id"), "matched", "tf")


def lexical(spark, d):
    scored = word_counts(spark, d)
    return retrieval.ranked(scored, F.desc("matched"), F.desc("tf"), F.col("doc_id"), limit=50).select("doc_id", "rank")


def vector(spark, d):
    found = retrieval.vector_search(read(spark, d, "embeddings"), query_vector(spark, d), 50, "vec_id")
    return found.select(F.col("vec_id").alias("doc_id"), "rank")


LEXICAL_SQL = """
words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents),
tok AS (SELECT doc_id, count(DISTINCT w) AS matched, count(*) AS tf FROM words WHERE w IN ('the','tion','with','das','que') GROUP BY doc_id),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY matched DESC, tf DESC, doc_id) AS rank FROM tok QUALIFY rank <= 50)"""
VECTOR_SQL = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), q.v) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(q.v, q.v)) DESC, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 50)"""


@query(f"""WITH {LEXICAL_SQL}, {VECTOR_SQL},
f AS (SELECT doc_id, round(sum(1.0 / (60.0 + rank)), 6) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY doc_id)
SELECT doc_id, CAST(rrf AS DOUBLE) AS rrf, row_number() OVER (ORDER BY rrf DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def recall_hybrid(spark, d):
    fused = retrieval.fuse({"lexical": lexical(spark, d), "vector": vector(spark, d)}, "doc_id")
    return retrieval.ranked(fused, F.desc("rrf"), F.col("doc_id"), limit=20)


TOP_SQL = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_inner_product(CAST(embedding AS DOUBLE[]), q.v) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(q.v, q.v)) AS s FROM embeddings, q)
"""


@query(TOP_SQL + "SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 20")
def vector_topk(spark, d):
    return retrieval.vector_search(read(spark, d, "embeddings"), query_vector(spark, d), 20, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(TOP_SQL + "SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM s WHERE label IN (1, 2, 3) QUALIFY rank <= 20")
def vector_topk_filtered(spark, d):
    rows = read(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3))
    return retrieval.vector_search(rows, query_vector(spark, d), 20, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(TOP_SQL + "SELECT label, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 3")
def vector_knn_per_label(spark, d):
    q = F.array(*(F.lit(x) for x in query_vector(spark, d)))
    scored = read(spark, d, "embeddings").select("label", "vec_id", cosine(F.col("embedding"), q).alias("s"))
    return retrieval.top_per_group(scored, ["label"], F.desc("s"), F.col("vec_id"), limit=3).select("label", "vec_id", F.round("s", 6).alias("similarity"), "rank")


def near_queries(spark, d):
    """Every hundredth vector asks, against all rows."""
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


NOTICES = {
    "name": "notices", "version": 1, "kinds": [
        {"kind": "license", "idPatterns": ["CC BY-[A-Z]+ [0-9][.][0-9]", "(?:MIT|Apache|General Public) License"]},
        {"kind": "person", "idPatterns": ["Customer#[0-9]{9}"]}, {"kind": "firm", "idPatterns": ["Supplier#[0-9]+"]},
    ],
}


@query("""WITH f AS (SELECT doc_id, list_concat(regexp_extract_all(text, 'CC BY-[A-Z]+ [0-9][.][0-9]'), regexp_extract_all(text, '(?:MIT|Apache|General Public) License')) AS ids FROM documents)
SELECT DISTINCT doc_id, 'license' AS kind, unnest(ids) AS id FROM f""")
def catalog_ids(spark, d):
    """Ids of a catalogue's kinds in whole texts."""
    return Catalog.build([parse_pack(NOTICES)]).ids_in(read(spark, d, "documents"), "doc_id", "text")


@query("""WITH t AS (SELECT c_name AS token FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part)
SELECT token, CASE WHEN regexp_full_match(trim(token), 'Customer#[0-9]{9}') THEN 'person' WHEN regexp_full_match(trim(token), 'Supplier#[0-9]+') THEN 'firm' END AS kind FROM t""")
def catalog_kinds(spark, d):
    """The kind that a whole token is an id of."""
    names = [read(spark, d, t).select(F.col(c).alias("token")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    rows = names[0].unionAll(names[1]).unionAll(names[2])
    return rows.select("token", Catalog.build([parse_pack(NOTICES)]).kind_of(F.col("token")).alias("kind"))


MAIL = "[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+"


def plain_model(instructions, text):
    """Stands in for a model: addresses are people, the first word is an organisation, and texts with a license get no JSON."""
    if "License" in text:
        return "I can't help with licenses."
    nodes = [{"id": m, "label": m.split("@")[0], "type": "person", "email": m} for m in dict.fromkeys(re.findall(MAIL, text))]
    word = re.search("[A-Za-z]+", text)
    nodes += [{"id": word[0].lower(), "label": word[0], "type": "org"}] if word else []
    return f"Here you are: {json.dumps({'nodes': nodes, 'edges': []})}"


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE NOT contains(text, 'License') AND length(trim(text)) > 0),
m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{MAIL}'))) AS m FROM d)
SELECT CAST(doc_id AS VARCHAR) AS src, 'person:' || m AS natural_key, split_part(m, '@', 1) AS title, m AS email FROM m
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'org:' || lower(regexp_extract(text, '[A-Za-z]+')), regexp_extract(text, '[A-Za-z]+'), NULL FROM d WHERE regexp_matches(text, '[A-Za-z]')""")
def extracted_mentions(spark, d):
    """What a stand-in for a model finds in whole texts, through the checks and the cache of answers."""
    found = extract.fragments(read(spark, d, "documents"), "doc_id", "text", plain_model, "plain", new_path(spark, "answers"), most=None)
    return extract.mentions(found).select("src", "natural_key", "title", "email")


@query("SELECT doc_id, 'no JSON object of nodes' AS error FROM documents WHERE contains(text, 'License') AND length(trim(text)) > 0")
def extraction_errors(spark, d):
    """Documents whose answer did not pass the checks, and why."""
    found = extract.fragments(read(spark, d, "documents"), "doc_id", "text", plain_model, "plain", new_path(spark, "answers"), most=None)
    return found.where("size(errors) > 0").select(F.col("key").alias("doc_id"), F.array_join("errors", "; ").alias("error"))


@query()
def vector_ann(spark, d):
    """Twenty neighbours by as many lists and candidates as find 95 % of the true ones of 64 queries."""
    index, ask = vector_index.vector_index(read(spark, d, "embeddings"), "vec_id"), near_queries(spark, d)
    probes, refine = vector_index.effort_for(index, ask, 20)
    found = vector_index.search(index, ask, 20, probes, exclude_own=True, refine=refine)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_ann_recall(spark, d):
    """Whether the index finds nine of ten true neighbours of all queries."""
    index, ask = vector_index.vector_index(read(spark, d, "embeddings"), "vec_id"), near_queries(spark, d)
    probes, refine = vector_index.effort_for(index, ask, 20)
    found = vector_index.search(index, ask, 20, probes, exclude_own=True, refine=refine)
    share = vector_index.recall(found, vector_index.exact_neighbours(index, ask, 20, exclude_own=True))
    return ask.agg(F.count("*").alias("queries")).withColumn("reached", F.lit(share >= 0.9))


@query("""WITH w AS (SELECT doc_id, text, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t IN ('the', 'with', 'das'))) AS f FROM documents),
s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'http') OR contains(lower(text), 'idiot') THEN 1.0 ELSE len(f) / 6.0 END AS score FROM w)
SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY CAST(score AS DOUBLE) DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50""")
def lexical_identifier(spark, d):
    found = retrieval.lexical_search(read(spark, d, "documents"), ["the", "with", "das"], ["http", "idiot"], 50, "doc_id")
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {LEXICAL_SQL} SELECT doc_id, matched, tf FROM tok")
def fts_token_score(spark, d):
    return word_counts(spark, d)


def sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


def sql_map(pairs):
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in pairs.items())}}}"


def sql_ending(endings):
    return f"coalesce(regexp_extract(w, '({'|'.join(endings)})$'), '')"


REGION_SQL = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_SQL = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
#: lex(word, lexeme): the stems of all words of documents, step by step. Words that are not of ASCII letters stay as they are.
STEMS_SQL = f"""
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents)),
v0 AS (SELECT DISTINCT word FROM places WHERE word NOT IN ({sql_list(sorted(ENGLISH_STOP))})),
v1 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM v0 WHERE regexp_full_match(word, '[a-z]{{3,}}')),
v2 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, '{REGION_SQL}') THEN length(regexp_extract(w, '{REGION_SQL}')) ELSE length(w) END AS r1 FROM v1),
v3 AS (SELECT word, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{REGION_SQL}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION_SQL}')) ELSE length(w) END AS r2,
  CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w FROM v2),
v4 AS (SELECT *, {sql_ending(["eedly", "eed", "edly", "ed", "ingly", "ing"])} AS e FROM v3),
v5 AS (SELECT word, r1, r2, w, e, left(w, length(w) - length(e)) AS s FROM v4),
v6 AS (SELECT word, r1, r2, CASE WHEN w IN ({sql_list(sorted(ENGLISH_KEPT))}) OR e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(s) >= r1 THEN s || 'ee' ELSE w END
  WHEN NOT regexp_matches(s, '[aeiouy]') THEN w WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN regexp_matches(s, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(s, length(s) - 1)
  WHEN length(s) <= r1 AND regexp_matches(s, '{SHORT_SQL}') THEN s || 'e' ELSE s END AS w FROM v5),
v7 AS (SELECT word, r1, r2, CASE WHEN w NOT IN ({sql_list(sorted(ENGLISH_KEPT))}) AND regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM v6),
v8 AS (SELECT *, {sql_ending(STEP_2)} AS e FROM v7),
v9 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(w) - length(e) < r1 OR e = 'ogi' AND w NOT LIKE '%logi' OR e = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$') THEN w ELSE left(w, length(w) - length(e)) || ({sql_map(STEP_2)})[e] END AS w FROM v8),
v10 AS (SELECT *, {sql_ending(STEP_3)} AS e FROM v9),
v11 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(w) - length(e) < r1 OR e = 'ative' AND length(w) - 5 < r2 THEN w ELSE left(w, length(w) - length(e)) || ({sql_map(STEP_3)})[e] END AS w FROM v10),
v12 AS (SELECT *, {sql_ending(STEP_4)} AS e FROM v11),
v13 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(w) - length(e) < r2 OR e = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE left(w, length(w) - length(e)) END AS w FROM v12),
v14 AS (SELECT word, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT_SQL}')) OR w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM v13),
lex AS (SELECT word, CASE WHEN word IN ({sql_list(ENGLISH_WHOLE)}) THEN ({sql_map(ENGLISH_WHOLE)})[word] WHEN word IN ({sql_list(sorted(ENGLISH_KEPT))}) THEN word ELSE coalesce(replace(w, 'Y', 'y'), word) END AS lexeme FROM v0 LEFT JOIN v14 USING (word))"""

QUESTION = "Was the nation's relation, and relating things, of anded stations?"
#: The question's lexemes are those of its words, found by the same steps on a document that holds it alone.
RANKED_SQL = f"""
hits AS (SELECT doc_id, lexeme, least(count(*) FILTER (place < 16383) + CASE WHEN max(place) >= 16383 THEN 1 ELSE 0 END, 255) AS n, count(*) AS tf FROM places JOIN lex USING (word) WHERE lexeme IN ('nation', 'relat', 'thing', 'and', 'station') GROUP BY ALL),
fts AS (SELECT doc_id, round(sum(0.1 * list_sum(list_transform(range(1, n + 1), lambda j: 1.0 / (j * j)::DOUBLE)) / 1.64493406685) / 5, 9) AS score, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM hits GROUP BY doc_id)"""


def stem_index(spark, d):
    return fulltext.indexed(read(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {STEMS_SQL}, {RANKED_SQL} SELECT doc_id, score, matched, tf FROM fts")
def fts_rank(spark, d):
    """Every document with a lexeme of the question, and its rank."""
    return fulltext.search(stem_index(spark, d), QUESTION).withColumnRenamed("id", "doc_id")


@query(f"WITH {STEMS_SQL}, {RANKED_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fts QUALIFY rank <= 50")
def fts_stemmed_topk(spark, d):
    found = fulltext.search(stem_index(spark, d), QUESTION).withColumnRenamed("id", "doc_id")
    return retrieval.ranked(found.select("doc_id", "score"), F.desc("score"), F.col("doc_id"), limit=50)


@query(f"WITH {STEMS_SQL} SELECT lexeme AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM places JOIN lex USING (word) GROUP BY ALL")
def fts_terms(spark, d):
    """All lexemes of the documents with how many documents and places they have, from the postings."""
    return stem_index(spark, d).groupBy("term").agg(F.count_distinct("id").alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH {STEMS_SQL}, l AS (SELECT doc_id, place, lexeme FROM places JOIN lex USING (word))
SELECT a.doc_id, a.place AS at FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.place = a.place + 3 AND b.lexeme = 'mit' JOIN l c ON c.doc_id = a.doc_id AND c.place = a.place + 4 AND c.lexeme = 'licens' WHERE a.lexeme = 'releas'""")
def fts_phrase(spark, d):
    """Where a licence line stands: its lexemes as far apart as in the phrase, whatever stop words lie between."""
    return fulltext.phrase_rows(stem_index(spark, d), "releases under the MIT licenses").withColumnRenamed("id", "doc_id")


@query(f"WITH {STEMS_SQL}, {RANKED_SQL}, s AS (SELECT d.doc_id, CASE WHEN contains(lower(text), 'http') THEN 1.0 ELSE coalesce(score, 0) END AS score FROM documents d LEFT JOIN fts USING (doc_id)) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 80")
def text_search_identifiers(spark, d):
    """Identifiers before words, from texts and postings."""
    docs = read(spark, d, "documents")
    return fulltext.text_search(docs, QUESTION, ["http"], 80, "doc_id", "text", index=stem_index(spark, d))


@query(f"""WITH {LEXICAL_SQL}, {VECTOR_SQL},
c AS (SELECT doc_id, 1.0 AS w, rank FROM lex UNION ALL SELECT doc_id, 0.7, rank FROM vec),
b AS (SELECT c.doc_id, sum(w / (60.0 + rank)) AS s, max(CASE WHEN coalesce(l.quality, 0) = 1 THEN 0.004 ELSE 0.0 END) AS bonus FROM c LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON c.doc_id = l.doc_id GROUP BY c.doc_id)
SELECT doc_id AS id, round(CAST(s + bonus AS DOUBLE), 6) AS score FROM b""")
def rrf_weighted_bonus(spark, d):
    both = lexical(spark, d).withColumn("channel", F.lit("lexical")).unionByName(vector(spark, d).withColumn("channel", F.lit("graph")))
    good = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = both.join(good, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return context.score(rows, F.when(F.coalesce("quality", F.lit(0)) == 1, 0.004).otherwise(0.0))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def meta_containment(spark, d):
    from ..functions.predicates import contains_meta

    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.where(contains_meta(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), {"lang": "en", "source": "src3"}))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, d):
    return read(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("""SELECT doc_id, array_to_string(ids, '|') AS ids FROM (
SELECT doc_id, list_filter(regexp_extract_all(text, '\\b[A-Za-z]+_[A-Za-z0-9_]+\\b'), lambda t: length(t) >= 3) AS ids FROM documents) WHERE len(ids) > 0""")
def identifiers_underscore(spark, d):
    """Names with an underscore only: the part of the identifier forms that has the same meaning in both engines."""
    found = F.filter(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z]+_[A-Za-z0-9_]+)\b"), F.lit(1)), lambda t: F.length(t) >= 3)
    return read(spark, d, "documents").select("doc_id", found.alias("ids")).where("size(ids) > 0").select("doc_id", F.array_join("ids", "|").alias("ids"))


@query()
def identifiers_extract(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(identifiers(F.col("text")), "|").alias("ids")).where("ids <> ''")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[0-9]+', '{id}', 'g'), '\\{[^{}\\s]*\\}', '{}', 'g') AS path FROM pages")
def placeholders_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", normalize_placeholders(F.regexp_replace("url", "[0-9]+", "{id}")).alias("path"))


def neutralize_sql(column: str) -> str:
    """The same replacements in the other engine's regular expressions, whose \\w is ASCII only."""
    out = f"regexp_replace(regexp_replace(coalesce({column}, ''), '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{2069}}\\x{{feff}}]', '', 'g'), '{CONTROL}', '', 'g')"
    for form in INJECTION_FORMS:
        out = f"regexp_replace({out}, '{form.replace(chr(92) + 'w', '[' + chr(92) + 'pL' + chr(92) + 'pN_]')}', '{NEUTRALIZED}', 'gi')"
    return out


@query(f"SELECT conv_id, turn, role, {neutralize_sql('text')} AS text FROM conversations")
def injection_neutralize(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", "role", neutralize(F.col("text")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')) AS n FROM documents WHERE regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')")
def pii_email_counts(spark, d):
    mail = F.regexp_count("text", F.lit(r"[\w.+-]+@[\w-]+\.[\w.-]+")).cast("long")
    return read(spark, d, "documents").select("doc_id", mail.alias("n")).where("n > 0")


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', '[ПДн:email]', 'g')) AS masked_sha256 FROM documents WHERE regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')")
def pii_mask_email(spark, d):
    form = r"[\w.+-]+@[\w-]+\.[\w.-]+"
    return read(spark, d, "documents").where(F.col("text").rlike(form)).select("doc_id", F.sha2(F.regexp_replace("text", form, "[ПДн:email]"), 256).alias("masked_sha256"))


@query()
def pii_kinds(spark, d):
    rows = read(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in pii_counts(F.col("text")).items()))
    return rows.where("card + phone + snils + passport_rf + inn + email > 0")


@query()
def pii_masked(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", mask_pii(F.col("text")).alias("masked"))
    return rows.where("masked <> text").select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.0) AS BIGINT)) END AS tokens FROM documents")
def token_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT event_id, round(0.005 * pow(0.5, greatest(0.0, epoch_us(TIMESTAMP '{NOW}' - ts) / 86400000000.0) / 14.0), 9) AS bonus FROM events")
def recency_bonuses(spark, d):
    return read(spark, d, "events").select("event_id", F.round(recency_bonus(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")), 9).alias("bonus"))


VISIBLE_SQL = """o AS (SELECT event_id, event_type AS kind, CASE WHEN user_id % 3 = 0 THEN ['workspace:w' || CAST(user_id % 5 AS VARCHAR)] WHEN user_id % 3 = 1 THEN ['team:t' || CAST(user_id % 4 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS scopes FROM events),
v AS (SELECT *, len(list_filter(scopes, lambda s: starts_with(s, 'workspace:') OR starts_with(s, 'principal:'))) > 0 AS restricted FROM o)"""


@query(f"WITH {VISIBLE_SQL} SELECT event_id, kind FROM v WHERE NOT restricted OR list_has_any(scopes, ['workspace:w1', 'workspace:w2'])")
def visible_events(spark, d):
    from ..functions.predicates import visible

    return observations(spark, d).where(visible(F.col("scopes"), ["workspace:w1", "workspace:w2"])).select("event_id", "kind")


@query(f"WITH {VISIBLE_SQL} SELECT event_id, kind FROM v WHERE NOT restricted OR list_has_any(scopes, list_intersect(['workspace:w1', 'workspace:w2'], ['workspace:w2', 'workspace:w3']))")
def visibility_narrowing(spark, d):
    from ..functions.predicates import has_visibility_scope
    from ..functions.predicates import strings as values
    from ..functions.values import narrow

    allowed = narrow(values(["workspace:w1", "workspace:w2"]), values(["workspace:w2", "workspace:w3"]))
    rows = observations(spark, d)
    return rows.where(~has_visibility_scope(F.col("scopes")) | F.arrays_overlap("scopes", allowed)).select("event_id", "kind")


@query(f"WITH {VISIBLE_SQL} SELECT kind, count(*) AS n FROM v WHERE NOT restricted GROUP BY kind")
def status_counts_visible(spark, d):
    from ..functions.predicates import visible

    return observations(spark, d).where(visible(F.col("scopes"), [])).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def chunk_documents_query(spark, d):
    return chunk_documents(read(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, sha256(string_agg(line, chr(10) ORDER BY n)) AS text_sha256 FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY doc_id""")
def source_reconstruct(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sha2(F.array_join(ordered, "\n"), 256).alias("text_sha256"))


ITEMS_SQL = """i AS (SELECT doc_id // 40 AS request, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY length(text), doc_id) AS r, text, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.0) AS BIGINT)) END AS t FROM documents),
s AS (SELECT *, CASE WHEN r <= 3 THEN 'current' WHEN r <= 20 THEN 'facts' ELSE 'documents' END AS section FROM i)"""


def pack_items(spark, d):
    """A request for each forty documents in a row, with all of them as items, the shortest first."""
    docs = read(spark, d, "documents").withColumn("request", F.floor(F.col("doc_id") / 40).cast("long"))
    items = docs.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.length("text"), "doc_id")).cast("long"))
    section = F.when(F.col("rank") <= 3, "current").when(F.col("rank") <= 20, "facts").otherwise("documents")
    return items.select("request", F.col("doc_id").cast("string").alias("id"), section.alias("section"), F.col("rank").alias("position"), (1.0 / F.col("rank")).alias("score"), "text")


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT request, section, CASE section WHEN 'current' THEN 1 WHEN 'facts' THEN 2 ELSE 3 END AS place, string_agg(text, chr(10) ORDER BY r) AS body FROM s GROUP BY ALL)
SELECT request, sha256(string_agg('## ' || section || chr(10) || body, chr(10) || chr(10) ORDER BY place)) AS text_sha256 FROM p GROUP BY request""")
def context_sections(spark, d):
    """All items of each request in sections, as one text."""
    return context.render(pack_items(spark, d), "request").select("request", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH RECURSIVE {ITEMS_SQL},
f AS (SELECT request, id, section, r, CASE WHEN t <= 2000 THEN t ELSE 2000 END AS tokens, true AS kept, 2000 - CASE WHEN t <= 2000 THEN t ELSE 2000 END AS remaining FROM s WHERE r = 1
UNION ALL SELECT s.request, s.id, s.section, s.r, CASE WHEN s.t <= remaining OR NOT (s.section = 'current' AND remaining > 0) THEN s.t ELSE remaining END, s.t <= remaining OR (s.section = 'current' AND remaining > 0),
remaining - CASE WHEN s.t <= remaining THEN s.t WHEN s.section = 'current' THEN remaining ELSE 0 END FROM f JOIN s ON s.request = f.request AND s.r = f.r + 1)
SELECT request, id, section, tokens, kept FROM f""")
def context_budget(spark, d):
    """A pack of 2000 tokens for each request."""
    return context.apply_budget(pack_items(spark, d), "request", 2000)
