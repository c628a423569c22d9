"""Queries G01-G08 (graphs) and T01-T06 (text)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import graphs, joins, narratives, text_index, windows
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.registry import query
from purselake.plans.scalars import _STOP_SQL, TOKENS_SQL

# Lineage edges: pairs of part keys by a modular rule.
_EDGES_SQL = "ed AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b, CASE p_size % 4 WHEN 0 THEN 'rename' WHEN 1 THEN 'split' ELSE 'transfer' END AS relation, CAST(2017 + p_partkey % 9 AS INTEGER) AS fiscal_year FROM part WHERE p_partkey % 7 < 4 AND p_partkey + 1 + p_size % 3 IN (SELECT p_partkey FROM part))"


def lineage(lake):
    p = lake.part
    rel = F.when(F.col("p_size") % 4 == 0, "rename").when(F.col("p_size") % 4 == 1, "split").otherwise("transfer")
    e = p.filter("p_partkey % 7 < 4").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("b"), rel.alias("relation"), (2017 + F.col("p_partkey") % 9).cast("int").alias("fiscal_year"))
    return e.join(p.select(F.col("p_partkey").alias("b")), "b", "left_semi").select("a", "b", "relation", "fiscal_year")


@query("G01_connected_components", f"""WITH RECURSIVE {_EDGES_SQL}, u AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def g01(spark, sf):
    return graphs.components(lineage(Lake(spark, sf)), "a", "b")


_STEP_SQL = "st AS (SELECT a, min(b) AS b FROM ed WHERE relation <> 'split' GROUP BY 1 HAVING count(*) = 1), nx AS (SELECT a, b FROM st WHERE b IN (SELECT b FROM ed WHERE relation <> 'split' GROUP BY 1 HAVING count(*) = 1))"


@query("G02_one_to_one_chain", f"WITH RECURSIVE {_EDGES_SQL}, {_STEP_SQL}, r(start, node, steps) AS (SELECT a, b, 1 FROM nx UNION ALL SELECT start, b, steps + 1 FROM r JOIN nx ON node = a) SELECT start, arg_max(node, steps) AS \"end\", CAST(max(steps) AS BIGINT) AS steps FROM r GROUP BY 1")
def g02(spark, sf):
    return graphs.chain_ends(lineage(Lake(spark, sf)).filter("relation <> 'split'"), "a", "b")


@query("G03_longest_path_steps", f"WITH RECURSIVE {_EDGES_SQL}, n AS (SELECT a AS node FROM ed UNION SELECT b FROM ed), r(node, depth) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT b FROM ed) UNION SELECT b, depth + 1 FROM r JOIN ed ON node = a) SELECT node, CAST(max(depth) AS INTEGER) AS depth, FALSE AS cyclic FROM r GROUP BY 1")
def g03(spark, sf):
    return graphs.longest_path_depth(lineage(Lake(spark, sf)), "a", "b")


_CLAUSE_SQL = """cl AS (SELECT doc_id, k AS clause_no, c AS clause FROM (SELECT doc_id, unnest(string_split_regex(text, '[.;\\n]+')) AS c, generate_subscripts(string_split_regex(text, '[.;\\n]+'), 1) AS k FROM documents))"""


def clauses(lake):
    d = lake.documents
    return d.select("doc_id", F.posexplode(F.split("text", "[.;\\n]+"))).select("doc_id", (F.col("pos") + 1).alias("clause_no"), F.col("col").alias("clause"))


_PE = f"(?:pe|program element)\\s+({narratives.CODE})"
_CUES = [("s", i, rel, f"(?i){cue}\\s+{_PE}") for i, (cue, rel) in enumerate(narratives.FROM_CUES)] + [("t", i, rel, f"(?i){cue}\\s+{_PE}") for i, (cue, rel) in enumerate(narratives.TO_CUES)]
_CUE_SQL = " UNION ALL ".join(
    f"SELECT narrative_id, clause_no, '{side}' AS side, {i} AS rule, '{rel}' AS relation, unnest(regexp_extract_all(clause, '{rx}', 1)) AS code, generate_subscripts(regexp_extract_all(clause, '{rx}', 1), 1) AS place FROM nc" for side, i, rel, rx in _CUES
)
_NEG = "|".join(narratives.NEGATIONS)


@query("G04_extract_stated_edges", with_sql("nv nc", f""", sj AS (SELECT narrative_id, clause_no, unnest(xs) AS x, generate_subscripts(xs, 1) AS place FROM (SELECT narrative_id, clause_no,
    regexp_extract_all(regexp_extract(clause, '(?is)^(.*)(?:transferred?|realign\\w*)\\s+to\\s+(?:pe|program element)\\s+[0-9]', 1), '(?i)(?:(?:to|from)\\s+)?{_PE}', 0) AS xs FROM nc)),
h AS ({_CUE_SQL} UNION ALL SELECT narrative_id, clause_no, 's', 9, 'realigned', regexp_extract(x, '({narratives.CODE})$', 1), place FROM sj WHERE NOT regexp_matches(x, '(?i)^(?:to|from)\\s')),
f AS (SELECT narrative_id, clause_no, side, code, arg_min(relation, rule * 1000 + place) AS relation, min(rule * 1000 + place) AS ord FROM h GROUP BY ALL),
b AS (SELECT narrative_id, clause_no, s.code AS a, t.code AS b, CASE WHEN s.relation <> 'renamed' THEN s.relation ELSE t.relation END AS relation, s.ord * 1000000 + t.ord AS pos FROM f s JOIN f t USING (narrative_id, clause_no) WHERE s.side = 's' AND t.side = 't' AND s.code <> t.code),
o AS (SELECT narrative_id, clause_no, CASE side WHEN 's' THEN code ELSE pe_code END AS a, CASE side WHEN 's' THEN pe_code ELSE code END AS b, relation, CASE side WHEN 's' THEN 0 ELSE 100000 END + ord AS pos FROM f JOIN nv USING (narrative_id) WHERE code <> pe_code AND (narrative_id, clause_no) NOT IN (SELECT (narrative_id, clause_no) FROM b)),
e AS (SELECT x.*, n.fiscal_year, regexp_replace(n.clause, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS evidence FROM (SELECT * FROM b UNION ALL SELECT * FROM o) x JOIN nc n USING (narrative_id, clause_no)
  WHERE NOT regexp_matches(lower(n.clause), '{_NEG}') AND NOT (regexp_matches(lower(coalesce(n."after", '')), '{_NEG}') AND list_has_any(string_split_regex(coalesce(n."after", ''), '[^A-Za-z0-9]+'), [x.a, x.b]))),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY fiscal_year DESC, narrative_id, clause_no, pos) AS r FROM e)
SELECT a AS from_code, b AS to_code, relation, fiscal_year, narrative_id, clause_no, left(sha256(concat_ws('|', a, b, fiscal_year, relation, evidence)), 16) AS edge_id, evidence FROM r WHERE r = 1"""))
def g04(spark, sf):
    """Rules in order, pairs that a clause names itself, retractions, latest edition first."""
    return narratives.stated_edges(Lake(spark, sf).narratives(), "narrative_id", "pe_code", "fiscal_year", "body")


@query("G05_drop_superseded_edges", f"WITH {_EDGES_SQL} SELECT a, b, fiscal_year FROM ed e WHERE NOT EXISTS (SELECT 1 FROM ed l WHERE l.a = e.b AND l.fiscal_year > e.fiscal_year AND l.relation = 'rename')")
def g05(spark, sf):
    e = lineage(Lake(spark, sf))
    later = e.filter("relation = 'rename'").select(F.col("a").alias("b"), F.col("fiscal_year").alias("later"))
    latest = later.groupBy("b").agg(F.max("later").alias("later"))
    return e.join(latest, "b", "left").filter("later IS NULL OR later <= fiscal_year").select("a", "b", "fiscal_year")


@query("G06_infer_maturation_edges", with_sql("ln", """, t AS (SELECT title, account, pe_bli, CAST(substr(pe_bli, 7) AS INTEGER) AS step, edition_year, sum(amount_thousands) AS v FROM ln GROUP BY ALL)
SELECT a.title, a.account, a.pe_bli AS from_code, b.pe_bli AS to_code, min(b.edition_year) AS first_year FROM t a JOIN t b ON a.title = b.title AND a.account = b.account AND b.step = a.step + 1 AND b.edition_year = a.edition_year + 1 AND b.v > 0 GROUP BY 1, 2, 3, 4"""))
def g06(spark, sf):
    t = Lake(spark, sf).lines().withColumn("step", F.expr("cast(substr(pe_bli, 7) as int)")).groupBy("title", "account", "pe_bli", "step", "edition_year").agg(F.sum("amount_thousands").alias("v"))
    nxt = t.filter("v > 0").select("title", "account", F.col("pe_bli").alias("to_code"), (F.col("step") - 1).alias("step"), F.col("edition_year").alias("y"), (F.col("edition_year") - 1).alias("edition_year"))
    return t.join(nxt, ["title", "account", "step", "edition_year"]).groupBy("title", "account", F.col("pe_bli").alias("from_code"), "to_code").agg(F.min("y").alias("first_year"))


@query("G07_link_predecessors", with_sql("ln", ", t AS (SELECT pe_bli, account, edition_year, min(line_id) AS id FROM ln GROUP BY 1, 2, 3) SELECT pe_bli, account, edition_year, lag(id) OVER (PARTITION BY pe_bli, account ORDER BY edition_year) AS predecessor FROM t"))
def g07(spark, sf):
    t = Lake(spark, sf).lines().groupBy("pe_bli", "account", "edition_year").agg(F.min("line_id").alias("id"))
    return t.select("pe_bli", "account", "edition_year", F.lag("id").over(Window.partitionBy("pe_bli", "account").orderBy("edition_year")).alias("predecessor"))


@query("G08_predecessor_chain", f"WITH RECURSIVE {_EDGES_SQL}, {_STEP_SQL}, r(start, node) AS (SELECT a, b FROM nx UNION ALL SELECT start, b FROM r JOIN nx ON node = a) SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT start FROM r) AND p_partkey NOT IN (SELECT node FROM r)")
def g08(spark, sf):
    """Rows that no chain reaches."""
    lake = Lake(spark, sf)
    hops = graphs.chain_ends(lineage(lake).filter("relation <> 'split'"), "a", "b")
    direct = lineage(lake).filter("relation <> 'split'")
    inner = direct.join(hops.select(F.col("start").alias("a")), "a", "left_semi").select(F.col("b").alias("p_partkey"))
    on_chain = hops.select(F.col("start").alias("p_partkey")).union(hops.select("end")).union(inner)
    return lake.part.select("p_partkey").join(on_chain, "p_partkey", "left_anti")


# Text ----------------------------------------------------------------------------------

_TERMS_SQL = f"tm AS (SELECT term, min(pe_bli) AS pe_bli, count(DISTINCT pe_bli) AS n_codes FROM (SELECT DISTINCT p_brand AS pe_bli, unnest(string_split_regex(lower(concat(p_name, ' ', p_type)), '[^a-z0-9]+')) AS term FROM part) WHERE length(term) >= 4 AND term NOT IN ({_STOP_SQL}) GROUP BY 1)"


def terms(lake):
    words = lake.part.select(F.col("p_brand").alias("pe_bli"), F.explode(X.tokens(F.concat("p_name", F.lit(" "), "p_type"))).alias("term")).distinct()
    return words.groupBy("term").agg(F.min("pe_bli").alias("pe_bli"), F.countDistinct("pe_bli").alias("n_codes"))


@query("T01_program_terms", f"WITH {_TERMS_SQL} SELECT * FROM tm")
def t01(spark, sf):
    return terms(Lake(spark, sf))


# Programs of the text jobs: the benchmark's items. The longest word is a program's code, the
# next its alias, the words of its first sentence its title.
_WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_PROGRAM_SQL = f"""pg AS (SELECT item_id, regexp_extract(text, '^[^.\n]*') AS title, list_sort(list_distinct(list_transform(list_filter({_WORDS_SQL.format('text')}, lambda x: length(x) > 3), lambda x: concat(lpad(CAST(99 - length(x) AS VARCHAR), 2, '0'), x)))) AS ranked FROM benchmark),
mt AS (SELECT item_id, 0 AS rank, substr(ranked[1], 3) AS term FROM pg WHERE len(ranked) >= 1 UNION ALL SELECT item_id, 1, substr(ranked[2], 3) FROM pg WHERE len(ranked) >= 2 UNION ALL SELECT item_id, 2, unnest({TOKENS_SQL.format('title')}) FROM pg)"""
BROADCAST_TERMS = 100_000


def words(c):
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def programs(lake):
    """item_id, title, code, alias of each benchmark item."""
    long_first = F.array_sort(F.transform(F.array_distinct(F.filter(words(F.col("text")), lambda x: F.length(x) > 3)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    p = lake.benchmark.select("item_id", F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), long_first.alias("ranked"))
    return p.select("item_id", "title", F.try_element_at("ranked", F.lit(1))["w"].alias("code"), F.try_element_at("ranked", F.lit(2))["w"].alias("alias"))


def small(df, limit: int = BROADCAST_TERMS):
    """``df`` marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def index_of(lake):
    """The postings of ``documents``, built once a session: term, doc_id, n_chars, text_key, first, n."""
    docs = lake.documents.withColumn("text_key", text_index.text_key(F.col("text")))
    return text_index.written_postings(docs, "text", ["doc_id", "n_chars", "text_key"], f"{lake.folder}/documents.parquet")


@query("T02_find_mentions", f"""WITH {_PROGRAM_SQL}, w AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL.format('text')}) AS term FROM documents),
m AS (SELECT doc_id, item_id, min(rank) AS rank, arg_min(term, concat(rank, term)) AS matched_term, count(*) FILTER (WHERE rank = 2) AS n FROM w JOIN mt USING (term) GROUP BY 1, 2)
SELECT doc_id, item_id, matched_term, CASE rank WHEN 0 THEN 'code' WHEN 1 THEN 'alias' ELSE 'title_tokens' END AS evidence_kind, substr(text, greatest(strpos(lower(text), matched_term) - 40, 1), 120) AS snippet FROM m JOIN documents USING (doc_id) WHERE rank < 2 OR n >= 2""")
def t02(spark, sf):
    """Code beats alias beats two words of one title. Terms meet the written postings; a text
    is read again for its mentions alone, no further than the place the index gives. Rows of
    one doc_id are told apart by their texts; equal rows have the same mentions each."""
    lake = Lake(spark, sf)
    return mentions(lake.documents, index_of(lake), programs(lake))


def mentions(docs, index, p):
    """(doc_id, item_id, matched_term, evidence_kind, snippet) of programs ``p`` (item_id,
    title, code, alias) in ``docs``, through their postings."""
    kinds = [p.select("item_id", F.lit(rank).alias("rank"), F.col(c).alias("term")).filter("term IS NOT NULL") for rank, c in enumerate(("code", "alias"))]
    t = kinds[0].union(kinds[1]).union(p.select("item_id", F.lit(2).alias("rank"), F.explode(X.tokens(F.col("title"))).alias("term")))
    hits = text_index.term_hits(index.select("term", "doc_id", "text_key", "first"), t.distinct())
    best = F.min(F.struct("rank", "term", "first")).alias("best")
    n = F.size(F.collect_set(F.when(F.col("rank") == 2, F.col("term")))).alias("n")  # words of one title
    m = hits.groupBy("doc_id", "text_key", "item_id").agg(best, n).filter("best.rank < 2 OR n >= 2")
    kind = F.when(F.col("best.rank") == 0, "code").when(F.col("best.rank") == 1, "alias").otherwise("title_tokens")
    m = m.select("doc_id", "text_key", "item_id", F.col("best.term").alias("matched_term"), F.col("best.first").alias("first"), kind.alias("evidence_kind"))
    found = joins.null_safe(docs.select("doc_id", "text", text_index.text_key(F.col("text")).alias("text_key")), m, ["doc_id", "text_key"])
    place = F.expr("locate(matched_term, lower(substring(text, 1, first + length(matched_term))))")
    at = F.greatest(place - 40, F.lit(1))
    return found.select("doc_id", "item_id", "matched_term", "evidence_kind", F.substring("text", at, F.lit(120)).alias("snippet"))


NAME_WORDS = (2, 3, 4, 5)
_GRAMS_SQL = " UNION ".join(f"SELECT doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS name FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)" for n in NAME_WORDS)


@query("T03_name_index_match", f"""WITH w AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS ws FROM documents), g AS ({_GRAMS_SQL}),
nm AS (SELECT DISTINCT array_to_string(list_slice({_WORDS_SQL.format('text')}, 1, 2 + item_id % 4), ' ') AS name FROM benchmark) SELECT DISTINCT doc_id, name FROM g WHERE length(name) >= 3 AND name IN (SELECT name FROM nm)""")
def t03(spark, sf):
    """Names of two to five words as contiguous n-grams, one gram length for each."""
    lake = Lake(spark, sf)
    names = lake.benchmark.select(F.array_join(F.slice(words(F.col("text")), F.lit(1), (2 + F.col("item_id") % 4).cast("int")), " ").alias("name")).filter("length(name) >= 3").distinct()
    ws = lake.documents.select("doc_id", words(F.col("text")).alias("ws"))
    grams = F.flatten(F.array(*[F.expr(f"if(size(ws) >= {n}, transform(sequence(0, size(ws) - {n}), i -> array_join(slice(ws, i + 1, {n}), ' ')), cast(array() as array<string>))") for n in NAME_WORDS]))
    return ws.select("doc_id", F.explode(F.array_distinct(grams)).alias("name")).join(small(names), "name", "left_semi").select("doc_id", "name")


def _places_sql(text: str, rx: str, alias: str) -> str:
    """Matches ``alias``_f and the texts between them ``alias``_b of the plain text."""
    plain = f"regexp_replace({text}, '[^\\x00-\\x7F]', ' ', 'g')"
    return f"regexp_extract_all({plain}, '{rx}') AS {alias}_f, string_split_regex({plain}, '{rx}') AS {alias}_b"


_AT = "CAST(coalesce(list_sum([length(x) FOR x IN list_slice({0}_b, 1, i)]), 0) + coalesce(list_sum([length(x) FOR x IN list_slice({0}_f, 1, i - 1)]), 0) AS BIGINT)"
_AROUND = "substr(body, CAST(greatest(place - {1}, 0) AS BIGINT) + 1, CAST(place + length(f) + {1} - greatest(place - {1}, 0) AS BIGINT))"


@query("T04_lexicon_candidates", with_sql("nv", f""", d AS (SELECT narrative_id, lexicon_key, body, trim(coalesce(title, '')) AS t, {_places_sql("trim(coalesce(title, ''))", narratives.DESIGNATOR, 'dt')}, {_places_sql('body', narratives.ACRONYM, 'ac')}, {_places_sql('body', narratives.DESIGNATOR, 'db')} FROM nv WHERE lexicon_key IS NOT NULL AND NOT regexp_matches(lexicon_key, '{narratives.SYNTHETIC}')),
g AS (SELECT * FROM d WHERE t <> '' AND NOT regexp_matches(t, '{narratives.TITLE_JUNK}')),
a AS (SELECT narrative_id, lexicon_key, body, i, ac_f[i] AS f, {_AT.format('ac')} AS place FROM (SELECT *, unnest(range(1, len(ac_f) + 1)) AS i FROM d)),
b AS (SELECT narrative_id, lexicon_key, body, i, db_f[i] AS f, {_AT.format('db')} AS place FROM (SELECT *, unnest(range(1, len(db_f) + 1)) AS i FROM d)),
c AS (SELECT narrative_id, lexicon_key, t AS name, 'title' AS source, t AS quote, 0 AS pos FROM g
 UNION ALL SELECT narrative_id, lexicon_key, dt_f[i], 'designator-title', t, i FROM (SELECT *, unnest(range(1, len(dt_f) + 1)) AS i FROM g)
 UNION ALL SELECT narrative_id, lexicon_key, f, 'acronym-def', {_AROUND.format(0, 60)}, 100000 + 2 * i FROM a UNION ALL SELECT narrative_id, lexicon_key, regexp_extract(f, '\\(([A-Z0-9]+)\\)$', 1), 'acronym', {_AROUND.format(0, 60)}, 100001 + 2 * i FROM a
 UNION ALL SELECT narrative_id, lexicon_key, f, 'designator-body', {_AROUND.format(0, 90)}, 10000000 + i FROM b),
n AS (SELECT narrative_id, lexicon_key, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, source, quote, pos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY lexicon_key, lower(name) ORDER BY narrative_id, pos) AS n FROM n WHERE length(name) BETWEEN 3 AND 90)
SELECT lexicon_key, name, source, CAST(n AS INTEGER) AS n, left(quote, 220) AS quote, narrative_id FROM r WHERE n <= 3"""))
def t04(spark, sf):
    return narratives.lexicon_candidates(Lake(spark, sf).narratives(), "lexicon_key", "narrative_id", "title", "body")


_HEAD_SQL = "array_to_string(" + _WORDS_SQL + ", ' ')"


@query("T05_search_rank", f"""WITH {_PROGRAM_SQL}, q AS (SELECT item_id AS query_id, {_HEAD_SQL.format('title')} AS title, term, term = substr(ranked[1], 3) AS is_alias FROM (SELECT *, unnest(list_distinct(list_concat({TOKENS_SQL.format('title')}, [substr(ranked[1], 3)]))) AS term FROM pg WHERE len(ranked) >= 1)),
w AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS_SQL.format('text')}) AS t FROM documents) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, any_value(title) AS title, count(*) AS covered, sum(tf) + 5 * count(*) FILTER (WHERE is_alias) AS score FROM w JOIN q USING (term) GROUP BY 1, 2),
e AS (SELECT query_id, doc_id, covered, CAST(score AS BIGINT) AS score, title = {_HEAD_SQL.format("regexp_extract(text, '^[^.\n]*')")} AS exact, n_chars FROM s JOIN documents USING (doc_id))
SELECT query_id, doc_id, exact, covered, score, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, covered DESC, score // 5 DESC, n_chars DESC, doc_id) AS r FROM e) WHERE r <= 10""")
def t05(spark, sf):
    """Exact title, then covered terms, then score (an alias counts five more), scores of one
    band of five by size, then id. Each query is a program; its terms meet the written
    postings, exact titles the heads of the documents, and tasks keep what they can rank."""
    lake = Lake(spark, sf)
    return search(lake.documents, index_of(lake), programs(lake).filter("code IS NOT NULL"))


def search(docs, index, p, top: int = 10):
    """The ``top`` documents of each program by the rule of T05."""
    q = p.select(F.col("item_id").alias("query_id"), "code", F.explode(F.array_distinct(F.concat(X.tokens(F.col("title")), F.array("code")))).alias("term"))
    hits = text_index.term_hits(index.select("term", "doc_id", "text_key", "n_chars", "n"), q)
    score = (F.sum("n") + 5 * F.count_if(F.col("term") == F.col("code"))).cast("long")
    s = hits.groupBy("query_id", "doc_id", "text_key", "n_chars").agg(F.count(F.lit(1)).alias("covered"), score.alias("score"))
    joined = lambda c: F.array_join(words(c), " ")
    titles = p.select(F.col("item_id").alias("query_id"), joined(F.col("title")).alias("head"))
    heads = docs.select("doc_id", text_index.text_key(F.col("text")).alias("text_key"), joined(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("head"))
    exact = heads.join(small(titles), "head").select("query_id", "doc_id", "text_key", F.lit(True).alias("same")).distinct()
    s = joins.null_safe(s, exact, ["query_id", "doc_id", "text_key"], "left").withColumn("exact", F.coalesce("same", F.lit(False)))
    order = [F.col("exact").desc(), F.col("covered").desc(), F.floor(F.col("score") / 5).desc(), F.col("n_chars").desc(), F.col("doc_id")]
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("r") <= top).select("query_id", "doc_id", "exact", "covered", "score", "r")


@query("T06_clause_candidates", with_sql("nv nc", f""", k AS (SELECT *, list_sort(list_distinct([w FOR w IN regexp_extract_all(clause, '[A-Za-z0-9]+') IF regexp_full_match(w, '[0-9]{{7}}(?:[A-Z][A-Z0-9]{{0,3}})?')])) AS codes, regexp_replace(clause, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS t FROM nc WHERE regexp_matches(clause, '(?i)\\b(?:{"|".join(narratives.MOVES)})\\b')),
i AS (SELECT *, left(sha256(concat_ws('|', narrative_id, t)), 16) AS clause_id FROM k WHERE len(codes) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY narrative_id, clause_no) AS r FROM i)
SELECT clause_id, narrative_id, clause_no, t AS clause, coalesce(regexp_replace("before", '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '') AS "before", coalesce(regexp_replace("after", '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '') AS "after", array_to_string(codes, ',') AS codes FROM r WHERE r = 1"""))
def t06(spark, sf):
    return narratives.clause_candidates(Lake(spark, sf).narratives(), "narrative_id", "body")
